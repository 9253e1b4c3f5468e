"""A name index for keyword search: trigrams of the distinct node names, and the edges laid out by either end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph

#: Names that a search pushes into the scan of the edges; more of them are joined.
MAX_PUSHED = 2_000
#: Rows of a file of the index, about: small files are what a search skips.
ROWS_PER_FILE = 200_000
#: Up to so many ranges Spark's defaults shuffle without sorting. Tables that would need more get larger files, of about ROWS_PER_TASK rows at most.
MAX_RANGES, ROWS_PER_TASK = 200, 4_000_000
GRAM = 3


def grams(name: Column) -> Column:
    """The distinct runs of GRAM characters of a lower-case name, in no order; none of a shorter one."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name) - GRAM + 1, F.lit(1)))
    return F.when(F.length(name) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substring(name, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


@dataclass
class NameIndex:
    """Tables below ``path``: ``names`` (name, low), ``grams`` (gram, name, low), whose files are in the order of grams,
    ``frequency`` (gram, n), ``out`` and ``into`` (the edges with ``key``, the lower-case head or tail, files in its order)."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, edges: DataFrame, path: str) -> NameIndex:
        """Write the index of ``edges``, which are made once and written; all else is read from that and from the index.
        Names come from the edges laid out, where equal ones lie together, and are spelled out once, not once an edge, so
        the grams' table grows with the nodes; every table is range-partitioned, so a frequent gram or a hub lies across
        files, not in one task."""
        spark = edges.sparkSession
        edges = graph.cut(edges)
        n = edges.count()  # from the files' footers
        for table, end in (("out", "head"), ("into", "tail")):
            _lay_out(edges, n, f"{path}/{table}", "key", F.lower(end))
        ends = [spark.read.parquet(f"{path}/{table}").select(F.col(end).alias("name")) for table, end in (("out", "head"), ("into", "tail"))]
        ends[0].unionByName(ends[1]).distinct().withColumn("low", F.lower("name")).write.parquet(f"{path}/names")
        names = spark.read.parquet(f"{path}/names")
        n = names.agg(F.sum(F.greatest(F.length("low") - GRAM + 1, F.lit(0)))).first()[0] or 0  # repeats in a name counted, so rather too many
        _lay_out(names.select(F.explode(grams(F.col("low"))).alias("gram"), "name", "low"), n, f"{path}/grams", "gram", F.col("gram"))
        frequency = spark.read.parquet(f"{path}/grams").groupBy("gram").agg(F.count("*").alias("n"))
        frequency.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/frequency")
        return cls(spark, path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def names(self, text: str) -> DataFrame:
        """(name, low) of the nodes whose name holds ``text``, in any case of letters.

        A name that holds the text holds all its grams, so the list of its rarest gram has every one of them; the names
        in that list are then looked at themselves. A text shorter than a gram is looked for in all names.
        """
        low = self.spark.range(1).select(F.lower(F.lit(text)).alias("t")).first()["t"]  # as Spark lower-cases names
        if len(low) < GRAM:
            return self.table("names").filter(F.contains("low", F.lit(low)))
        own = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        known = {r["gram"]: r["n"] for r in self.table("frequency").filter(F.col("gram").isin(own)).collect()}  # as many rows as the text has grams
        rarest = min(own, key=lambda g: (known.get(g, 0), g))
        return self.table("grams").filter((F.col("gram") == rarest) & F.contains("low", F.lit(low))).select("name", "low")

    def match(self, node: str = "", relation: str = "", mode: str = "and") -> DataFrame:
        """What ``graph.keyword_match`` gives, read from the edges of matching nodes only.

        Edges whose head matches come from ``out``, those whose tail alone does from ``into``. Up to MAX_PUSHED keys go
        into both scans, whose row groups are skipped by their bounds; more are joined. Without a node, or where a
        relation alone is enough, edges that no node leads to are asked for: then all are scanned.
        """
        if not node or (relation and mode != "and"):
            return graph.keyword_match(self.table("out").drop("key"), node, relation, mode)
        keys = self.names(node).select("low").distinct()
        some = [r["low"] for r in keys.limit(MAX_PUSHED + 1).collect()]

        def read(table: str) -> DataFrame:
            rows = self.table(table)
            return rows.filter(F.col("key").isin(some)) if len(some) <= MAX_PUSHED else rows.join(keys.withColumnRenamed("low", "key"), "key", "left_semi")

        low = self.spark.range(1).select(F.lower(F.lit(node)).alias("t")).first()["t"]
        rows = read("out").unionByName(read("into").filter(~F.coalesce(F.contains(F.lower("head"), F.lit(low)), F.lit(False)))).drop("key")
        hit = F.contains(F.lower("relation"), F.lit(relation.lower())) if relation else F.lit(False)
        rows = rows.withColumns({"node_hit": F.lit(True), "relation_hit": hit})
        return rows.filter("relation_hit") if relation else rows

    def subgraph(self, node: str = "", relation: str = "", mode: str = "and", max_nodes: int = 200, max_edges: int = 500) -> DataFrame:
        return graph.first_subgraph(self.match(node, relation, mode), max_nodes, max_edges)

    def stats(self, node: str = "", relation: str = "", mode: str = "and") -> DataFrame:
        return graph.hit_counts(self.match(node, relation, mode))


def _lay_out(df: DataFrame, rows: int, path: str, name: str, key: Column) -> None:
    """Write ``df`` of about ``rows`` rows, with ``key`` as column ``name``, in its order from file to file. A range is a file,
    so its bounds are narrow without sorting by key; in it rows are sorted by a number, which only brings equal keys
    together. Rows of one key are spread by their other columns."""
    ranges = min(rows // ROWS_PER_FILE + 1, max(MAX_RANGES, rows // ROWS_PER_TASK + 1))
    laid = df.repartitionByRange(ranges, key, F.xxhash64(*df.columns)).select(key.alias(name), *[c for c in df.columns if c != name])
    laid.sortWithinPartitions(F.xxhash64(name)).write.parquet(path)
