"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise

#: Weights of the sources in order, repeated.
CYCLE = (3.0, 1.0, 2.0)
#: Weight schedules of the sources in order, repeated: one that fades, one that grows, one that peaks half-way.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size, n_docs, weight).

    The mix holds ``share`` times all sizes. A source gets ``level * weight`` but at most ``max_repeats`` times its size;
    the common level is the one at which all targets sum to the mix, which is what resharing the excess by weight until
    no source is above its cap arrives at. Sources are sorted by cap over weight, so the sources before the first
    uncapped one are exactly the capped ones and a running sum gives the level. Sources of weight 0 get nothing.
    """
    caps = sizes.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size")).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    mix = F.lit(share) * F.sum("source_size").over(all_)
    level = (mix - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = caps.withColumn("level", level)
    # the first source whose cap is not below the level it sees fixes the level for all after it
    water = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull().alias("z"), "source", "level"))).over(all_)["level"]
    return leveled.withColumn("target", F.when(F.col("weight") <= 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce(water * F.col("weight"), F.col("cap"))))).drop("cap", "ratio", "level")


def cumulative(schedule: Sequence[tuple[float, float]]) -> tuple[list[float], list[float], list[float]]:
    """Knots, values and integral up to each knot of a piecewise-linear weight schedule on training time 0..1."""
    t, w = [float(a) for a, _ in schedule], [float(b) for _, b in schedule]
    if t[0] != 0 or t[-1] != 1 or any(b <= a for a, b in zip(t, t[1:])) or min(w) < 0 or max(w) == 0:
        raise ValueError("a schedule runs from time 0 to 1 with growing times and weights of at least 0, not all 0")
    total = [0.0]
    for i in range(1, len(t)):
        total.append(total[-1] + (t[i] - t[i - 1]) * (w[i] + w[i - 1]) / 2)
    return t, w, total


def position(fraction: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """Training time at which a source has met ``fraction`` of its demand: the inverse of the integrated schedule.

    Demand is quadratic between knots, so the inverse is a root per piece: built-in functions only.
    """
    t, w, total = cumulative(schedule)
    need = fraction * F.lit(total[-1])
    out = F.lit(1.0)
    for i in range(len(t) - 2, -1, -1):
        rest, slope = need - F.lit(total[i]), (w[i + 1] - w[i]) / (t[i + 1] - t[i])
        # w*x + slope*x^2/2 = rest, in the form that has no cancellation and also serves slope 0
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w[i] ** 2) + 2 * slope * rest))
        x = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (F.lit(w[i]) + root))
        out = F.when(need < F.lit(total[i + 1]), F.lit(t[i]) + x).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    schedules: Mapping[str | None, Sequence[tuple[float, float]]] | None = None,
    share: float = 1.5,
    max_repeats: int = 2,
    whole_documents: bool = False,
    rows_per_bucket: int = 2_000,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, copies, positions (of its takings, in order),
    position (of its first taking, or null).

    A source's documents stand in the order of md5(id), the stream repeats ``max_repeats`` times, and the source gives
    the first ``target`` words of it (rounded to a word): a document is taken once for each pass in which it lies wholly
    before that mark, and the one document across the mark gives the words before it. With ``whole_documents`` that one
    is taken whole if its middle lies before the mark, else not at all. A taking's offset in the stream over target is
    the met share of the source's demand; inverting the integral of its weight schedule gives the training position in
    0..1. Sources without a schedule of their own are flat; without ``schedules`` those of CURRICULUM hold.

    Running totals are exact and have no hot group: each source is cut into ranges of md5 of about ``rows_per_bucket``
    documents, ranges are summed, and only the sums are accumulated over a source.

    Null text or no word: size 0, taken 0. A null source is a source of its own, last in order. Rows with equal ids tie
    by size; equal rows are interchangeable. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("rank", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    base = materialise(base, "sizes")
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_source = by_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    if weights is None:
        by_source = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), (F.col("place") % len(CYCLE) + 1).cast("int")))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
        by_source = by_source.withColumn("weight", weight)
    wanted = targets(by_source, share, max_repeats).withColumn("cuts", F.ceil(F.col("n_docs") / rows_per_bucket)).select("source", "source_size", "target", "cuts", "place")
    wanted = materialise(wanted.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source"), "targets")
    # md5 as 32 bits: 0 <= head < 2^32
    head = F.conv(F.substring("rank", 1, 8), 16, 10).cast("long")
    cut = base.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).join(wanted, "key").withColumn("cut", F.floor(head * F.col("cuts") / F.lit(2.0**32)).cast("long"))
    sums = cut.groupBy("key", "cut").agg(F.sum("size").alias("cut_size"))
    starts = sums.select("key", "cut", (F.sum("cut_size").over(Window.partitionBy("key").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)) - F.col("cut_size")).alias("start"))
    inner = Window.partitionBy("key", "cut").orderBy("rank", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    at = cut.withColumn("inside", F.sum("size").over(inner) - F.col("size")).join(starts, ["key", "cut"]).withColumn("at", F.col("start") + F.col("inside"))
    mark = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    flat = ((0.0, 1.0), (1.0, 1.0))

    def when(begin: Column) -> Column:
        met = F.when(F.col("target") > 0, begin / F.col("target"))
        if schedules is None:
            choices = [(F.col("place") % len(CURRICULUM) == k, schedule) for k, schedule in enumerate(CURRICULUM)]
        else:
            choices = [(F.col("source").eqNullSafe(F.lit(source)), schedule) for source, schedule in schedules.items()]
        out = position(met, flat)
        for here, schedule in choices:
            out = F.when(here, position(met, schedule)).otherwise(out)
        return out

    taken, copies, takings = F.lit(0).cast("long"), F.lit(0).cast("int"), []
    for again in range(max_repeats):
        begin = F.col("at") + F.lit(again) * F.col("source_size")
        part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), mark - begin))
        whole = (2 * begin + F.col("size") < 2 * mark) & (F.col("size") > 0)
        taken = taken + (F.when(whole, F.col("size")).otherwise(F.lit(0)) if whole_documents else part)
        copies = copies + (whole if whole_documents else part > 0).cast("int")
        takings.append(F.when(whole if whole_documents else part > 0, when(begin)))
    out = at.select("id", "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"), F.array_compact(F.array(*takings)).alias("positions"))
    return out.withColumn("position", F.get("positions", F.lit(0))).withColumnRenamed("id", id_col)


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorts the taken documents by training position; untaken ones come last."""
    order = [F.col("position").asc_nulls_last(), F.col(mixed.columns[0]).asc_nulls_last()]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def apply_mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: whole rows of ``docs``, one per taking, range-sorted by the taking's own training position.

    A document taken twice is there twice, the second time where its source's stream comes round to it again; one not
    taken is not there. Decisions are by (id, source, size); rows that agree on all three are numbered and get one each.
    Columns of ``docs`` may have any names.
    """
    mixed = mix(docs, whole_documents=True, text_col=text_col, id_col=id_col, source_col=source_col, **options)
    id_, source, n, positions, nth, rows = fresh(docs, "_id", "_source", "_n", "_positions", "_nth", "_rows")
    size, own, at = fresh(docs, "_size", "_own", "_at")
    key = Window.partitionBy(id_, source, n)
    by = mixed.select(F.col(id_col).alias(id_), F.col("source").alias(source), F.col("size").alias(n), F.col("positions").alias(positions))
    by = by.withColumn(nth, F.row_number().over(key.orderBy(positions))).withColumn(rows, F.count("*").over(key))
    by = materialise(by.filter(F.size(positions) > 0), "taken")
    keyed = docs.withColumn(size, word_count(F.col(text_col)))
    on = F.col(id_col).eqNullSafe(F.col(id_)) & F.col(source_col).eqNullSafe(F.col(source)) & (F.col(size) == F.col(n))
    one, many = by.filter(F.col(rows) == 1), by.filter(F.col(rows) > 1)
    single = keyed.join(one, on)
    # rows that share a key are numbered by text and meet the decision of their number
    several = many.select(id_, source, n).distinct()
    numbered = keyed.join(several, on).withColumn(own, F.row_number().over(key.orderBy(F.md5(F.coalesce(F.col(text_col), F.lit("")))))).drop(id_, source, n)
    shared = numbered.join(many, on & (F.col(own) == F.col(nth)))
    taken = single.select(*docs.columns, positions).unionByName(shared.select(*docs.columns, positions)).withColumn(at, F.explode(positions))
    return taken.repartitionByRange(at, id_col).sortWithinPartitions(at, id_col).select(*docs.columns)


def position_sql(fraction: str, schedule: Sequence[tuple[float, float]]) -> str:
    """``position`` in SQL."""
    t, w, total = cumulative(schedule)
    double = lambda x: f"CAST({x!r} AS DOUBLE)"
    need, cases = f"({fraction} * {double(total[-1])})", []
    for i in range(len(t) - 1):
        rest, slope = f"({need} - {double(total[i])})", (w[i + 1] - w[i]) / (t[i + 1] - t[i])
        root = f"sqrt(greatest(CAST(0 AS DOUBLE), {double(w[i] ** 2)} + {double(2 * slope)} * {rest}))"
        cases.append(f"WHEN {need} < {double(total[i + 1])} THEN {double(t[i])} + CASE WHEN {rest} <= 0 THEN CAST(0 AS DOUBLE) ELSE 2 * {rest} / ({double(w[i])} + {root}) END")
    return f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CASE {' '.join(cases)} ELSE CAST(1 AS DOUBLE) END))"


def curriculum_sql(fraction: str) -> str:
    """The position by the schedule of the source's place."""
    return "CASE place % 3 " + " ".join(f"WHEN {k} THEN {position_sql(fraction, schedule)}" for k, schedule in enumerate(CURRICULUM)) + " END"


ORACLE_OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS weight
  FROM d GROUP BY source),
c AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, CAST(2 * source_size AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio FROM s),
l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * (SELECT CAST(sum(source_size) AS DOUBLE) FROM s)
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM c),
w AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, place, least(cap, coalesce((SELECT level FROM w) * CAST(weight AS DOUBLE), cap)) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.place, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS mark,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, greatest(0, least(size, mark - a)) AS once, greatest(0, least(size, mark - a - source_size)) AS twice,
         CASE WHEN target > 0 THEN CAST(a AS DOUBLE) / target END AS f1, CASE WHEN target > 0 THEN CAST(a + source_size AS DOUBLE) / target END AS f2 FROM p)
SELECT doc_id, size, source_size, target, CAST(once + twice AS BIGINT) AS taken,
       CASE WHEN once > 0 THEN round({curriculum_sql("f1")}, 6) END AS position,
       CASE WHEN twice > 0 THEN round({curriculum_sql("f2")}, 6) WHEN once > 0 THEN round({curriculum_sql("f1")}, 6) END AS last_position
FROM q
"""
