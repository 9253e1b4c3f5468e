"""SimHash near-dedup: fingerprints, and a binary-trie self-join of them under a Hamming error budget."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, fresh, materialise

#: A pair of trie nodes with at most so many leaf pairs is compared leaf by leaf.
LEAF_PAIRS = 64
#: Node pairs held at once; more wait on a stack.
FRONTIER = 1 << 19


def shingle_hashes(text: str | None, n: int) -> list[int]:
    """XXH64 (seed 42) of each n-word shingle of the text with A-Z lowered, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxh64_intdigest(joined, 42)]
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = starts[n:] + [at]
    return [xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, ends)]


def fingerprint(text: str | None, n: int = 3) -> int:
    """64 bits as an unsigned integer: bit i is 1 if set in over half of the shingles' hashes; no word: 0."""
    hashes = shingle_hashes(text, n)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_ = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def fingerprint_column(n: int = 3):
    """The fingerprint as a Spark column function (text -> long, the same 64 bits signed)."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, n) for t in texts], dtype=np.uint64).view(np.int64), index=texts.index)

    return simhash


def trie_pairs(keys: np.ndarray, depth: int, budget: int, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of ``keys`` (sorted, distinct uint64) that differ in at most ``budget`` bits.

    A trie node is a run of ``keys`` with equal leading bits. The join starts from each run [start, stop) that agrees on
    its first ``depth`` bits, paired with itself, and goes down both nodes together: equal next bits keep the errors,
    unequal ones add one, and a pair over budget is pruned with all below it. Small pairs are compared leaf by leaf.
    """
    one = np.uint64(1)
    stack = [(depth, starts, stops, starts, stops, np.zeros(len(starts), np.int8))]
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack.append((depth, *(x[half:] for x in (a0, a1, b0, b1, err))))
            stack.append((depth, *(x[:half] for x in (a0, a1, b0, b1, err))))
            continue
        size = (a1 - a0) * (b1 - b0)
        small = size <= LEAF_PAIRS
        if small.any():
            sa, na, sb, nb = a0[small], (a1 - a0)[small], b0[small], (b1 - b0)[small]
            count = na * nb
            which = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            i, j = sa[which] + step // nb[which], sb[which] + step % nb[which]
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        keep = ~small
        if not keep.any():
            continue
        a0, a1, b0, b1, err = (x[keep] for x in (a0, a1, b0, b1, err))
        bit = np.uint64(63 - depth)
        split = lambda lo, hi: np.clip(np.searchsorted(keys, ((keys[lo] >> bit) | one) << bit), lo, hi)
        am, same = split(a0, a1), a0 == b0
        bm = split(b0, b1)
        cross = ~same
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1),
                 tuple(x[cross] for x in (am, a1, b0, bm, err + 1))]
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*parts))
        alive = (a1 > a0) & (b1 > b0) & (err <= budget)
        stack.append((depth + 1, *(x[alive] for x in (a0, a1, b0, b1, err))))


class Forest:
    """Labels under union of index pairs, vectorised: each label is the smallest index of its tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                flat = label[label]
                if (flat == label).all():
                    break
                label[:] = flat


def blocks(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of ``count`` blocks that make up 64 bits, widths as equal as can be."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def turned(fp: np.ndarray, lead: tuple[int, ...], parts: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints with the blocks ``lead`` moved to the top: differing bits stay as many."""
    out = np.zeros_like(fp)
    for k in (*lead, *(k for k in range(len(parts)) if k not in lead)):
        low, width = parts[k]
        out = (out << np.uint64(width)) | ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


def _join_sorted(batches: Iterator[pa.RecordBatch], leads: list[tuple[int, ...]], parts: list[tuple[int, int]], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (turn, block, fp) sorted by (turn, block): links within each (turn, block), as (a, b) with b of a tree."""

    def solve(turn: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t in np.unique(turn):
            lead = leads[int(t)]
            width = sum(parts[k][1] for k in lead)
            own = fp[turn == t]
            keys = turned(own, lead, parts)
            order = np.argsort(keys)
            keys, own = keys[order], own[order]
            block = keys >> np.uint64(64 - width)
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            stops = np.r_[starts[1:], len(keys)]
            many = stops - starts > 1
            if not many.any():
                continue
            forest = Forest(len(keys))
            for i, j in trie_pairs(keys, width, budget, starts[many], stops[many]):
                forest.union(i, j)
            linked = np.flatnonzero(forest.label != np.arange(len(keys)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(own[linked].view(np.int64)), pa.array(own[forest.label[linked]].view(np.int64))], names=["a", "b"])

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]))
        size += batch.num_rows
        if size < 1 << 17:
            continue
        rows = np.concatenate(held, axis=1)
        last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        done = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
        if done:
            yield from solve(rows[0, :done], np.ascontiguousarray(rows[2, :done]).view(np.uint64))
        held, size = [rows[:, done:]], rows.shape[1] - done
    if held:
        rows = np.concatenate(held, axis=1)
        yield from solve(rows[0], np.ascontiguousarray(rows[2]).view(np.uint64))


def link_fingerprints(fps: DataFrame, budget: int = 3, agree: int = 1) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs of ``fps`` (one distinct long column fp) within
    ``budget`` differing bits; never all pairs of a group.

    Of budget + ``agree`` blocks of bits, fingerprints within the budget agree on ``agree`` at least. Each is dealt out
    by each choice of so many blocks, 20 bytes a row, and one task joins its groups' tries with themselves. More blocks
    to agree on make more rows and smaller groups; the links are the same.
    """
    parts = blocks(budget + agree)
    leads = list(combinations(range(len(parts)), agree))

    def key(lead: tuple[int, ...]):
        out = F.lit(0).cast("long")
        for k in lead:
            low, width = parts[k]
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)))
        return out

    turns = F.array(*(F.struct(F.lit(t).alias("turn"), key(lead).alias("block")) for t, lead in enumerate(leads)))
    dealt = fps.select("fp", F.explode(turns).alias("k")).select("k.turn", "k.block", "fp")
    by_block = dealt.repartition("turn", "block").sortWithinPartitions("turn", "block")
    return by_block.mapInArrow(lambda batches: _join_sorted(batches, leads, parts, budget), "a long, b long")


def near_dups(docs: DataFrame, n: int = 3, budget: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, fp (long), component_id: the smallest id reachable by links of fingerprints.

    Equal fingerprints are one class, so copies cost one row in the join. Null and empty texts have fingerprint 0 and
    link like any other. Null ids take part but never name a component unless all its ids are null; rows with equal ids
    stay separate rows. Extra columns are ignored; an empty table gives an empty result.
    """
    own = materialise(docs.select(F.col(id_col).alias("id"), fingerprint_column(n)(F.col(text_col)).alias("fp")), "simhash")
    fps = materialise(own.groupBy("fp").agg(F.min("id").alias("low")), "fingerprints")
    links = connected_components(link_fingerprints(fps.select("fp"), budget))
    classes = fps.join(links, fps["fp"] == links["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(lows, "root").select("fp", "component_id")
    return own.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(fp):
    """A long as 16 hex digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Documents of one block in the exact comparison; a task compares two blocks of one group.
BLOCK_DOCS = 1_000
#: Keys of dropped rows are broadcast up to so many (about 24 MB).
MAX_BROADCAST_KEYS = 500_000


def similar_pairs(sets: list[np.ndarray], first: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``sets`` (sorted distinct integers) with Jaccard of ``least`` or more: all pairs if ``first`` is the
    number of sets, else pairs of one of the first ``first`` and one of the others. Empty sets are like each other only."""
    size = np.array([len(s) for s in sets])
    values, index, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = df[index] > 1
    columns = np.cumsum(df > 1) - 1
    owner, column = owner[shared], columns[index[shared]]
    all_ = first == len(sets)
    rows, others = np.arange(first), np.arange(len(sets)) if all_ else np.arange(first, len(sets))
    both = np.zeros((len(rows), len(others)), np.float32)
    width = int((df > 1).sum())
    for lo in range(0, width, 4096):  # a slice of the incidence matrix at a time
        here = (column >= lo) & (column < lo + 4096)
        part = np.zeros((len(sets), min(4096, width - lo)), np.float32)
        part[owner[here], column[here] - lo] = 1
        both += part[rows] @ part[others].T
    union = size[rows][:, None] + size[others][None, :] - both
    i, j = np.nonzero((both >= least * union - 1e-6) & ((both > 0) | (union == 0)))
    i, j = rows[i], others[j]
    yield i[i < j], j[i < j]


#: Prefix tokens of a chunk of texts (about 60 MB while they are sorted), and of a bucket of all chunks as aimed at.
CHUNK_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 20
#: Share of a set's size by which its prefix is longer than one common token asks for.
SPARE = 0.2


def prefix_lengths(size: np.ndarray, similarity: float, spare: float = SPARE) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of so many tokens: how many least ones (by value) make up the prefix, and how many of its rarest are keys.

    Sets x and y of Jaccard t or more share at least t*max(|x|, |y|) tokens. The k least shared ones are among the first
    |x| - t|x| + k tokens of x, and likewise of y. So prefixes that are k(x) longer than |x| - t|x| share at least
    min(k(x), k(y)) tokens, and the rarest of those is among the prefix's |x| - t|x| + k(x) - min + 1 rarest.
    """
    up = lambda x: np.ceil(x - 1e-9).astype(np.int64)
    shared = up(similarity * size)
    k = np.maximum(1, up(spare * size))
    prefix = size - shared + k
    return prefix, prefix - np.maximum(1, up(spare * shared)) + 1


#: Columns of the table that texts are cut up into: a text has id, h, fp; a chunk fps, sizes, at; a bucket of its tokens bucket, start, tokens, counts.
CUT = ["id", "h", "fp", "chunk", "fps", "sizes", "at", "bucket", "start", "tokens", "counts"]


def _cut(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, similarity: float, words: int, bits_words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, h, text): a row for each text with its fingerprint; for each chunk of texts the places of their prefix
    tokens in the chunk's sorted tokens; and those tokens by bucket, with the number of texts that have each."""
    first, chunk = TaskContext.get().partitionId() << 32, 0
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    fps: list[int] = []
    sizes: list[int] = []
    held: list[np.ndarray] = []
    total = 0

    def rows(n: int, **columns) -> pa.RecordBatch:
        kinds = dict(zip(CUT, [id_type, pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]))
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=CUT)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal total, chunk
        tokens, at, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        yield rows(1, chunk=[first + chunk], fps=[np.array(fps, np.uint64).tobytes()], sizes=[np.array(sizes, np.uint32).tobytes()], at=[at.astype(np.uint32).tobytes()])
        bucket = tokens >> shift
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(tokens)]
        yield rows(
            len(cuts) - 1, chunk=[first + chunk] * (len(cuts) - 1), bucket=bucket[cuts[:-1]].astype(np.int32), start=np.array(cuts[:-1], np.int32),
            tokens=[tokens[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], counts=[counts[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts, cuts[1:])])
        for x in (fps, sizes, held):
            x.clear()
        total, chunk = 0, chunk + 1

    for batch in batches:
        own = []
        for text in batch.column(2):
            text = text.as_py()
            own.append(fingerprint(text, bits_words))
            tokens = np.unique(np.array(shingle_hashes(text, words), np.uint64))
            if len(tokens):  # texts without a word have fingerprint 0 all
                prefix, _ = prefix_lengths(np.array([len(tokens)]), similarity)
                fps.append(own[-1])
                sizes.append(len(tokens))
                held.append(tokens[: prefix[0]])
                total += len(held[-1])
            if total >= CHUNK_TOKENS:
                yield from close()
        yield rows(len(own), id=batch.column(0), h=batch.column(1), fp=np.array(own, np.uint64).view(np.int64))
    if total:
        yield from close()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, bucket, start, tokens, counts) sorted by bucket: those tokens of each chunk that several texts of the
    corpus have in their prefixes, as (chunk, at, tokens, counts)."""
    held: list[tuple[int, int, bytes, bytes]] = []
    last = None

    def flush() -> pa.RecordBatch:
        parts = [np.frombuffer(x[2], np.uint64) for x in held]
        _, which = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(which, np.concatenate([np.frombuffer(x[3], np.uint32) for x in held]))[which].astype(np.uint32)
        out: tuple[list, list, list, list] = ([], [], [], [])
        lo = 0
        for (chunk, start, *_), tokens in zip(held, parts):
            own = n[lo : lo + len(tokens)]
            lo += len(tokens)
            hit = np.flatnonzero(own > 1)
            if len(hit):
                for col, x in zip(out, (chunk, (hit + start).astype(np.uint32).tobytes(), tokens[hit].tobytes(), own[hit].tobytes())):
                    col.append(x)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.binary(), pa.binary(), pa.binary()])], names=["chunk", "at", "tokens", "counts"])

    for batch in batches:
        for chunk, bucket, start, tokens, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last and held:
                yield flush()
            last = bucket
            held.append((chunk, start, tokens, counts))
    if held:
        yield flush()


def _keys(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, fps, sizes, at, tokens, counts) sorted by chunk: (key, a, b), a link of two texts of the chunk with a
    common key, or (key, a, null) for the first text of each key in the chunk."""
    last, texts, known = None, None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if texts is None or not known:
            return
        fps, sizes, at = (np.frombuffer(x, t) for x, t in zip(texts, (np.uint64, np.uint32, np.uint32)))
        prefix, rarest = prefix_lengths(sizes.astype(np.int64), similarity)
        where, tokens, counts = (np.concatenate([np.frombuffer(x[k], t) for x in known]) for k, t in enumerate((np.uint32, np.uint64, np.uint32)))
        place = np.full(int(at.max()) + 1, -1)
        place[where] = np.arange(len(where))
        of, row = place[at], np.repeat(np.arange(len(prefix)), prefix)
        of, row = of[of >= 0], row[of >= 0]
        need = rarest - (prefix - np.bincount(row, minlength=len(prefix)))  # tokens of one text only are the rarest
        open_ = need[row] > 0
        of, row = of[open_], row[open_]
        order = np.lexsort((tokens[of], counts[of], row))
        of, row = of[order], row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        of, row = of[rank < need[row]], row[rank < need[row]]
        if not len(of):
            return
        key, fp = tokens[of].view(np.int64), fps[row].view(np.int64)
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        new = np.r_[True, key[1:] != key[:-1]]
        low = fp[new][np.cumsum(new) - 1]
        pairs = np.unique(np.stack([low, fp])[:, low != fp], axis=1)
        for k, a, b in ((key[new], fp[new], None), (None, pairs[0], pairs[1])):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if x is None else pa.array(x) for x in (k, a, b)], names=["key", "a", "b"])

    for batch in batches:
        for chunk, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk != last:
                yield from flush()
                last, texts, known = chunk, None, []
            if rest[0] is not None:
                texts = rest[:3]
            else:
                known.append(rest[2:])
    yield from flush()


def _link_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by both: (a, b) for each fp and the first one of its key, where they differ."""
    last, low = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        new = np.r_[True, key[1:] != key[:-1]]
        lows = fp[new]
        if key[0] == last:
            lows[0] = low
        last, low = key[-1], lows[-1]
        a = lows[np.cumsum(new) - 1]
        pairs = np.unique(np.stack([a, fp])[:, a != fp], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def cut_up(docs: DataFrame, similarity: float, words: int, bits_words: int) -> DataFrame:
    """The table of ``CUT`` of ``docs`` (id, h, text), one pass over the texts."""
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word has about five bytes, and two of five of its shingles are in the prefix
    buckets = 256
    while buckets * BUCKET_TOKENS * 12 < bytes_ and buckets < 1 << 24:
        buckets *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = next(batches, None)
        if one is not None:
            yield from _cut(chain([one], batches), one.schema.field(0).type, similarity, words, bits_words, buckets)

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, h string, fp long, chunk long, fps binary, sizes binary, at binary, bucket int, start int, tokens binary, counts binary"
    return materialise(docs.select("id", "h", "text").mapInArrow(run, schema), "near-chunks")


def link_similar(pieces: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect the fingerprints of any two texts whose shingle sets have Jaccard ``similarity`` or more.

    Others may be connected too, but only texts of which at least two fifths of the prefix tokens are others' too. Tokens
    travel in packed rows: to their buckets once a chunk, where they are counted, and those of several texts back to
    their chunks, which know their texts' rarest ones then. Texts that share one of those are linked to the first of
    them, in their chunk and over chunks: no pairs of a group are made, and a frequent token has one row a chunk.
    """
    tokens = pieces.filter("bucket is not null").select("chunk", "bucket", "start", "tokens", "counts").repartition("bucket").sortWithinPartitions("bucket")
    counted = tokens.mapInArrow(_count, "chunk long, at binary, tokens binary, counts binary")
    none = F.lit(None).cast("binary")
    texts = pieces.filter("fps is not null").select("chunk", "fps", "sizes", "at", none.alias("tokens"), none.alias("counts"))
    both = texts.unionByName(counted.select("chunk", none.alias("fps"), none.alias("sizes"), "at", "tokens", "counts"))
    met = both.repartition("chunk").sortWithinPartitions("chunk")
    keys = materialise(met.mapInArrow(lambda batches: _keys(batches, similarity), "key long, a long, b long"), "near-keys")
    across = keys.filter("key is not null").select("key", F.col("a").alias("fp")).repartition("key").sortWithinPartitions("key", "fp")
    return keys.filter("key is null").select("a", "b").unionByName(across.mapInArrow(_link_equal, "a long, b long"))


def near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, bits_words: int = 3, budget: int = 3, agree: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, h, group): rows with a near copy, keyed by id and the MD5 of the text; group is the smallest key's number.

    Near copies share ``similarity`` or more (Jaccard) of their distinct ``words``-word shingles. Candidates come from
    the trie join of SimHash fingerprints (``bits_words``-word shingles) within ``budget`` bits, which finds near copies
    with few changes, and from ``link_similar``, which misses none. Groups of candidates are then compared exactly, in
    blocks of BLOCK_DOCS documents, and linked by pairs that are similar enough: no pair leaves a task, only a parent.
    Texts without a word are near copies of each other.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.md5("text"))
    pieces = cut_up(plain, similarity, words, bits_words)
    own = pieces.filter("fp is not null").select("id", "h", "fp").distinct()
    near = link_fingerprints(materialise(own.select("fp").distinct(), "fingerprints"), budget, agree)
    links = materialise(connected_components(near.unionByName(link_similar(pieces, similarity))), "coarse")
    rows = materialise(own.join(links, own["fp"] == links["node"], "left").select("id", "h", F.coalesce("component", "fp").alias("coarse")), "grouped")
    discard(pieces, links)
    # a table of its own: a join straight on the aggregate would share its exchange, and a large group couldn't be split
    groups = materialise(rows.groupBy("coarse").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK_DOCS).cast("int")).drop("n"), "groups")
    members = rows.join(groups, "coarse").withColumn("node", F.monotonically_increasing_id())
    members = materialise(members.select("id", "h", "coarse", "blocks", "node"), "members")
    keys = members.select(F.col("id").alias("k_id"), F.col("h").alias("k_h"), "coarse", "blocks", "node")
    if members.count() <= MAX_BROADCAST_KEYS:
        keys = F.broadcast(keys)
    found = plain.join(keys, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                made = [np.unique(np.array(shingle_hashes(t.as_py(), words), np.uint64)).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("coarse", "blocks", "node")), pa.array(made, pa.binary())], names=["coarse", "blocks", "node", "set"])

    # rows that agree in id and text are one node; the text needn't be hashed twice for them
    shingled = found.select("coarse", "blocks", "node", "text").mapInArrow(sets, "coarse long, blocks int, node long, set binary")
    dealt = (shingled.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("coarse", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "set"))

    def compare(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["node"].to_numpy(), group["own"].to_numpy()))
        node, own_ = group["node"].to_numpy()[order], group["own"].to_numpy()[order]
        once = np.r_[True, node[1:] != node[:-1]]
        order, node, own_ = order[once], node[once], own_[once]
        values = group["set"].to_pylist()
        sets_ = [np.frombuffer(values[k], np.uint64) for k in order]
        same = group["i"][0] == group["j"][0]
        first = len(node) if same else int((own_ == group["i"][0].as_py()).sum())
        forest = Forest(len(node))
        if 0 < first and (same or first < len(node)):
            for i, j in similar_pairs(sets_, first, similarity):
                forest.union(i, j)
        hit = np.flatnonzero(forest.label != np.arange(len(node)))
        return pa.table({"a": node[hit], "b": node[forest.label[hit]]})

    edges = dealt.groupBy("coarse", "i", "j").applyInArrow(compare, "a long, b long")
    comps = connected_components(edges)
    return members.join(comps, "node").select("id", "h", F.col("component").alias("group"))


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id (null last), then text hash.

    Rows without a near copy stay, all columns too. Rows equal in id and text are one document to this operator: they
    stay or go together.
    """
    grouped = materialise(near_copies(docs, text_col=text_col, id_col=id_col, **options), "near-copies")
    best = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("h").alias("h"))).alias("best")
    low = materialise(grouped.groupBy("group").agg(best), "lowest")
    k_id, k_h, h = fresh(docs, "_k_id", "_k_h", "_h")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))
    gone = materialise(grouped.join(low, "group").filter(~stays).select(F.col("id").alias(k_id), F.col("h").alias(k_h)), "dropped")
    if gone.count() <= MAX_BROADCAST_KEYS:
        gone = F.broadcast(gone)
    keyed = docs.withColumn(h, F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return keyed.join(gone, F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(h) == F.col(k_h)), "left_anti").select(*docs.columns)
