"""How far the sources of a language differ: wide term vectors, whose pairwise contributions the JVM makes and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: What separates terms: ASCII characters that are no letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Probabilities are whole numbers of so many parts.
PARTS = 1_000_000_000
#: A table of sources goes to all executors up to so many groups (about 10 MB), else by an equi-join in salted parts.
MAX_BROADCAST_GROUPS, SALTS = 100_000, 64


def terms(text: Column) -> Column:
    """The terms of a text, A-Z lower-cased, in order and with repeats."""
    return F.array_remove(F.split(F.translate(text, CAPITALS, SMALL), BETWEEN), "")


def part(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / (total + kept)), exact at any size."""
    ratio = F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)"), (total + kept).cast("decimal(20,0)"))
    return ratio + F.lit(1).cast("long")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def vectors(docs: DataFrame, min_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, counts, total): the kept terms, each with its count in every source of its language that has it.

    A text's terms are sorted, so each distinct one leaves the text once, as (term, occurrences). Both sums are taken
    before rows are shuffled: a task sends a (lang, source, term) once however often it occurs.
    """
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.sort_array(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("terms"))
    first = F.transform("terms", lambda t, i: F.when((i == 0) | (F.get(F.col("terms"), i - 1) != t), i))
    starts = own.withColumn("starts", F.array_compact(first))
    runs = F.transform("starts", lambda at, k: F.struct(F.get(F.col("terms"), at).alias("term"), (F.coalesce(F.get(F.col("starts"), k + 1), F.size("terms")) - at).cast("long").alias("n")))
    by_text = starts.select("lang", "source", F.explode(runs).alias("t")).select("lang", "source", "t.term", "t.n")
    by_source = by_text.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    wide = by_source.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    return wide.filter(F.col("docs") >= min_docs).drop("docs")


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group of (lang, source) its distance to every other source of the
    language (part ``pair``), and the ``top`` terms that it has more of than the language (part ``term``).

    p is a term's share among a group's kept terms in PARTS, add-one smoothed; the distance is the sum of
    floor((p-q)^2/q) over the language's kept terms, those in at least ``min_docs`` of its documents. All numbers are
    whole: a p is at most PARTS + 1, so a square fits in 64 bits, and so does a sum of them up to 8e9 kept terms.

    Each kept term becomes an array over the sources of its language. Of its n sources each gives n contributions, one
    source at a time, so a row never holds n^2 of them; they are summed before the shuffle, which carries (lang, pair)
    sums only. The best terms of a group are cut to ``top`` within each task before they meet.

    Null text, lang and source count as ''. Groups without terms and languages without kept terms have their pairs, with
    value 0 in the latter. Repeated rows count each. Extra columns are ignored, an empty table gives an empty result.
    """
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    wide = materialise(vectors(docs, min_docs, text_col, lang_col, source_col), "terms")
    sums = wide.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = materialise(groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups")
    kept = wide.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    languages = sizes.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sources")).join(kept, "lang", "left")
    if sizes.count() <= MAX_BROADCAST_GROUPS:
        placed = wide.join(F.broadcast(languages), "lang")
    else:  # a language of a third of all terms is dealt out in SALTS parts
        salted = languages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = wide.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    shares = placed.select(
        "lang", "term", F.col("sources.source").alias("sources"), F.transform(F.col("sources.source"), lambda s: F.coalesce(F.try_element_at("counts", s), F.lit(0))).alias("n"),
        F.col("sources.total").alias("totals"), "kept", part(F.col("total"), F.col("lang_total"), F.col("kept")).alias("q"))
    shares = shares.select("lang", "term", "sources", "n", "q", F.zip_with("n", "totals", lambda n, total: part(n, total, F.col("kept"))).alias("p"))

    # outer: no array here is empty, and a plain one would be made twice, first to ask that
    gaps = shares.select("lang", "p", F.posexplode_outer("p").alias("i", "own")).select("lang", "i", F.transform("p", lambda q: gap(F.col("own"), q)).alias("gaps"))
    added = gaps.select("lang", "i", F.posexplode_outer("gaps").alias("j", "gap")).groupBy("lang", "i", "j").agg(F.sum("gap").alias("value"))
    placed_groups = languages.select("lang", F.posexplode("sources.source").alias("i", "source"), F.col("sources.source").alias("others"))
    every = placed_groups.select("lang", "i", "source", F.posexplode("others").alias("j", "item")).filter("i <> j")
    pairs = every.join(added, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    own = F.arrays_zip("sources", "n", "p")
    over = shares.select("lang", "term", "q", F.explode(F.filter(own, lambda g: (g["n"] > 0) & (g["p"] > F.col("q")))).alias("g"))
    best = over.select("lang", F.col("g.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("g.p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1])


ORACLE_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + v.v) AS p,
             1 + (1000000000::HUGEINT * (k.total + 1)) // (v.total + v.v) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
best AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM best)) WHERE part = 'pair' OR rank <= 200
"""
