"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, materialise

#: A table of keys is broadcast up to this many rows (about 24 MB); beyond it Spark joins by a shuffle, with the same result.
MAX_BROADCAST_KEYS = 500_000
#: The same for keys of dropped rows, which carry a digest (about 25 MB).
MAX_BROADCAST_ROWS = 200_000

PAIR = ["norm_bytes", "prefix_hash"]


def _few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _signature(text: Column, prefix_chars: int) -> dict[str, Column]:
    """What the first two steps look at, and the normalised text, which only the third reads in full."""
    norm = F.regexp_replace(text, SPACE + "+", "")
    return {"n_code_points": F.length(text), "norm_bytes": F.octet_length(norm), "prefix_hash": F.xxhash64(F.substring(norm, 1, prefix_chars)), "norm": norm}


def _decided(docs: DataFrame, text_col: str, id_col: str, prefix_chars: int, digest_all: bool, max_broadcast_keys: int) -> DataFrame:
    """id, n_code_points, norm_bytes, prefix_hash, content_hash (null where never read), group_size and best (null for unique texts)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    signed = docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in _signature(text, prefix_chars).items()))
    digest = F.sha2("norm", 256).alias("content_hash")
    cheap = ["id", "n_code_points", *PAIR]
    marks = materialise(signed.select(*cheap, digest) if digest_all else signed.select(*cheap), "signatures")
    # (1) rows of a length of their own go no further
    lengths = materialise(marks.groupBy("norm_bytes").agg(F.count("*").alias("n")).filter("n > 1").select("norm_bytes"), "lengths")
    same_length = marks.join(_few(lengths, max_broadcast_keys), "norm_bytes", "left_semi")
    # (2) nor do those of a prefix of their own
    pairs = materialise(same_length.groupBy(*PAIR).agg(F.count("*").alias("n")).filter("n > 1").select(*PAIR), "prefixes")
    alike = _few(pairs, max_broadcast_keys)
    # (3) full content of the rows that are left
    left = (marks if digest_all else signed).join(alike, PAIR, "left_semi").select(*cheap, "content_hash" if digest_all else digest)
    unique = marks.join(alike, PAIR, "left_anti").select(*cheap, "content_hash" if digest_all else F.lit(None).cast("string").alias("content_hash"))
    left = materialise(left, "digests")
    best = F.min(F.struct((-F.col("n_code_points")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    groups = left.groupBy("content_hash").agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1")
    # a table of its own: a join straight on the aggregate would share its exchange, and a hot group couldn't be split
    groups = materialise(groups, "groups")
    return left.join(groups, "content_hash", "left").select(*cheap, "content_hash", "group_size", "best").unionByName(unique, allowMissingColumns=True)


def _kept() -> Column:
    return F.col("group_size").isNull() | (F.col("best.id").eqNullSafe(F.col("id")) & (-F.col("best.n") == F.col("n_code_points")))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", prefix_chars: int = 64, digest_all: bool = False, max_broadcast_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, n_code_points, norm_bytes, content_hash.

    Texts are equal when identical after deleting white space. Refinement, the same at every size: (1) normalised byte
    lengths are counted, and rows of a unique length are done; (2) of the others (length, hash of the first
    ``prefix_chars`` characters) is counted, and rows of a unique pair are done; (3) the full content of those left is
    hashed and grouped. The first two steps run on a small table of lengths and 8-byte hashes.

    Tables of repeated keys are broadcast while they are few; beyond ``max_broadcast_keys`` Spark plans a shuffle (behind
    a Bloom filter of the keys), which moves the surviving texts once. ``digest_all`` fills content_hash for unique texts
    too, in the first scan, and no text is moved at all then; by default it is null there, since their content is never
    read in full.

    Of a group the row with the most code points in its original text stays, then the smallest id. Null text counts as
    empty; empty texts are equal to each other. A null id sorts last; of rows that tie on (code points, id), all carry
    the same keep_id and are marked kept (``keep_one`` leaves one). Extra columns are ignored; an empty table gives an empty result.
    """
    return _decided(docs, text_col, id_col, prefix_chars, digest_all, max_broadcast_keys).select(
        F.col("id").alias(id_col), F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), _kept().alias("kept"), "n_code_points", "norm_bytes", "content_hash")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", prefix_chars: int = 64, max_broadcast_keys: int = MAX_BROADCAST_KEYS, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, all columns; of rows that tie in everything one stays.

    Rows to drop are known by (id, code points, length, prefix hash) and then by their full hash, which only rows that
    agree on all four are asked for. Their keys are broadcast while they are few, so no text is shuffled; beyond
    ``max_broadcast_rows`` texts are shuffled to them. Rows that share a kept key, if there are any, are taken out and
    told apart by themselves. Columns of ``docs`` may have any names.
    """
    decided = _decided(docs, text_col, id_col, prefix_chars, False, max_broadcast_keys).filter("group_size is not null")
    own = fresh(docs, "_own_points", "_own_bytes", "_own_prefix")
    key = fresh(docs, "_id", "_points", "_bytes", "_prefix", "_hash")
    named = [F.col(c).alias(k) for c, k in zip(("id", "n_code_points", *PAIR, "content_hash"), key)]
    verdict = materialise(decided.select(*named, _kept().alias("kept")), "verdict")
    gone = verdict.filter("not kept").select(*key)
    tied = materialise(verdict.filter("kept").groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key), "tied")
    parts = _signature(F.coalesce(F.col(text_col).cast("string"), F.lit("")), prefix_chars)
    digest = F.sha2(parts.pop("norm"), 256)
    keyed = docs.withColumns(dict(zip(own, parts.values())))
    on = F.col(id_col).eqNullSafe(F.col(key[0]))
    for a, b in zip(own, key[1:]):
        on = on & (F.col(a) == F.col(b))
    # a condition on both sides, so that it is no key of the join: hashes are made only where all keys agree
    on = on & F.when(F.col(key[4]).isNotNull(), digest == F.col(key[4])).otherwise(F.lit(False))
    kept = keyed.join(_few(gone, max_broadcast_rows), on, "left_anti")
    if not tied.isEmpty():
        tied = _few(tied, max_broadcast_rows)
        (full,) = fresh(keyed, "_own_hash")
        once = kept.join(tied, on, "left_semi").withColumn(full, digest).dropDuplicates([id_col, own[0], full])
        kept = kept.join(tied, on, "left_anti").unionByName(once.drop(full))
    return kept.select(*docs.columns)
