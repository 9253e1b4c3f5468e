"""Importance resampling towards a target distribution of hashed n-grams: scores by array functions, draws by Gumbel keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: What separates words: ASCII characters that are no letters or digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
#: Parts into which a range of scores is cut to count them: so many counts come to the driver at a time.
STEPS = 4096


def with_buckets(texts: DataFrame, text: Column) -> DataFrame:
    """Adds ``n_words`` and ``buckets``: the bucket of each run of one, two and three words, repeats included."""
    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % BUCKETS).cast("int")

    space, words = F.lit(" "), F.col("_words")
    split = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), BETWEEN), lambda w: w != "")
    out = texts.withColumn("_words", split)
    one = F.transform(words, bucket)
    two = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w, i: bucket(F.concat(F.get(words, i), space, w)))
    three = F.transform(F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), lambda w, i: bucket(F.concat(F.get(words, i), space, F.get(words, i + 1), space, w)))
    return out.select("*", F.size(words).cast("long").alias("n_words"), F.concat(one, two, three).alias("buckets")).drop("_words")


def bucket_counts(texts: DataFrame, text_col: str = "text") -> list[int]:
    """Features of all texts by bucket. A task sums its own before they are shuffled; BUCKETS numbers come to the driver."""
    made = with_buckets(texts.select(F.col(text_col).alias("text")), F.col("text"))
    # outer: a plain one would make the array twice, first to ask whether it is empty
    each = made.select(F.explode_outer("buckets").alias("bucket")).filter(F.col("bucket").isNotNull())
    counts = [0] * BUCKETS
    for bucket, n in each.groupBy("bucket").count().collect():
        counts[bucket] = n
    return counts


def gains(raw: list[int], target: list[int]) -> list[int]:
    """What a feature of each bucket adds to a text's weight: the log of its smoothed share in the target over that in the
    raw texts, in thousandths, rounded down."""
    all_raw, all_target = sum(raw), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (all_raw + BUCKETS) / ((s + 1) * (all_target + BUCKETS)))) for s, t in zip(raw, target)]


def scored(docs: DataFrame, gain: list[int], seed: int = 42, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row. No text is exploded or shuffled: its array of buckets is
    folded over ``gain``, which stands in the plan as one literal array."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # a constant: folded by the optimiser
    made = with_buckets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col("text"))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, bucket: total + F.element_at(table, bucket + 1))
    out = made.select("id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return out.withColumn("score", F.col("weight") + noise)


def cut_score(scores: DataFrame, wanted: int) -> tuple[int, int]:
    """(the score of the wanted-th row, how many rows have that score or more).

    The range of scores is cut into STEPS parts, the one in which the wanted-th score lies is cut again, and so on: log
    of the range over log of STEPS rounds, each a sum by part that shuffles and collects STEPS rows at most.
    """
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    above = 0
    while True:
        step = (high - low) // STEPS + 1
        part = F.call_function("div", F.col("score") - F.lit(low), F.lit(step).cast("long"))
        counts = dict(scores.filter(F.col("score").between(low, high)).groupBy(part.alias("part")).count().collect())
        for k in sorted(counts, reverse=True):
            if above + counts[k] >= wanted:
                break
            above += counts[k]
        if step == 1:
            return low + k, above + counts[k]
        low, high = low + k * step, min(high, low + (k + 1) * step - 1)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank``, 1, 2, 3, ... along ``order``: rows are range-sorted and written with their places in their partition;
    only the partitions' row counts are summed up in one task."""
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    # as many rows as the sort had partitions
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score, rank.

    Draws floor(percent * N / 100) of the N rows with at least ``min_words`` words without replacement, with chances in
    proportion to exp(weight / 1000): those with the largest score, which is the weight plus Gumbel noise that depends on
    the seed and the id alone, ties to smaller ids. ``rank`` is 1, 2, 3, ... in that order, null where not drawn.

    1. Features of all rows and of all texts of ``target`` are counted by bucket; only those sums are shuffled.
    2. Rows are scored where they lie and written without their texts.
    3. The lowest drawn score is found by counting; the rows from it on are range-sorted and numbered. Others never move.

    Null texts have no feature and weigh 0; words are whole texts' words. A null id counts as '' in the noise and comes
    after others in a tie; rows with equal ids and scores are interchangeable. Extra columns are ignored. An empty target
    is smoothed like any other; an empty table gives an empty result.
    """
    rows = materialise(scored(docs, gains(bucket_counts(docs, text_col), bucket_counts(target, text_col)), seed, text_col, id_col), "scores")
    able = rows.filter(F.col("n_words") >= min_words)
    wanted = percent * able.count() // 100
    undrawn = rows.withColumn("rank", F.lit(None).cast("long"))
    if wanted == 0:
        return undrawn.withColumnRenamed("id", id_col)
    cut, reached = cut_score(able, wanted)
    drawn = numbered(able.filter(F.col("score") >= cut), F.desc("score"), F.col("id").asc_nulls_last())
    if reached > wanted:
        drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = undrawn.filter((F.col("n_words") < min_words) | (F.col("score") < cut))
    return drawn.unionByName(rest).withColumnRenamed("id", id_col)


ORACLE_OP13 = r"""
WITH RECURSIVE bit(b, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bit WHERE k < 8),
byte AS (SELECT list(v ORDER BY b) AS t FROM bit WHERE k = 8),
texts AS (SELECT row_number() OVER () AS r, 1 AS raw, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), 0, NULL, text FROM benchmark),
w AS (SELECT r, raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
o AS (SELECT r, raw, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
f AS (SELECT r, raw, w AS f FROM o UNION ALL
      SELECT a.r, a.raw, a.w || ' ' || b.w FROM o a JOIN o b ON a.r = b.r AND b.i = a.i + 1 UNION ALL
      SELECT a.r, a.raw, a.w || ' ' || b.w || ' ' || c.w FROM o a JOIN o b ON a.r = b.r AND b.i = a.i + 1 JOIN o c ON a.r = c.r AND c.i = a.i + 2),
n AS (SELECT r, raw, f, count(*) AS n FROM f GROUP BY r, raw, f),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
step AS (SELECT f, x, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM u UNION ALL
         SELECT f, x, i + 1, xor(c // 256, t[xor(c % 256, (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) + 1]) FROM step, byte WHERE 2 * i < length(x)),
h AS (SELECT f, xor(c, 4294967295) % 10000 AS b FROM step WHERE 2 * i = length(x)),
bn AS (SELECT r, raw, b, sum(n) AS n FROM n JOIN h USING (f) GROUP BY r, raw, b),
s AS (SELECT b, sum(CASE WHEN raw = 1 THEN n ELSE 0 END) AS s, sum(CASE WHEN raw = 0 THEN n ELSE 0 END) AS t FROM bn GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS g FROM s),
z AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM bn JOIN g USING (b) WHERE raw = 1 GROUP BY r),
d AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             CAST(('0x' || substr(sha256('42:' || doc_id), 1, 8)) AS BIGINT) AS h FROM texts JOIN w USING (r) LEFT JOIN z USING (r) WHERE texts.raw = 1),
e AS (SELECT doc_id, words >= 20 AS able, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS k, 5 * count(*) OVER (PARTITION BY able) // 100 AS m FROM e)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN able AND k <= m THEN k END AS BIGINT) AS rank FROM k
"""
