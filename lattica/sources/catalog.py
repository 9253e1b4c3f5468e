"""Manifests and catalogs as tables: what is known of each data set, what is to be fetched, what has arrived whole.

An entry has a name and any further columns. Entries keep the order in which their names first came, in column n.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: What an entry of a download manifest says.
ENTRY = "name string, source string, version string, category string, parser string, query_gene string, url string, path string, sha256 string, status string"


def read(spark: SparkSession, path: str, field: str = "datasets", schema: str = ENTRY) -> DataFrame:
    """Entries of JSON manifests ``{field: [..]}`` in order; keys that ``schema`` doesn't name are left out, absent ones null."""
    listed = f"{field} array<struct<{files._fields(schema)}>>"
    text = spark.read.option("wholetext", True).text(path).select(F.from_json("value", listed)[field].alias("d"))
    return text.select(F.posexplode("d").alias("n", "e")).select(F.col("n").cast("long").alias("n"), "e.*")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` entries in the place of old ones of their name, or behind all. Of a name that one table has several times the
    last entry holds, at the first's place. Both have the same columns, with order ``n``; places stay distinct, with gaps."""
    rest = [c for c in old.columns if c not in ("name", "n")]
    ends = old.agg(F.max("n").alias("most")).crossJoin(new.agg(F.min("n").alias("least")))  # one row each
    shift = ends.select((F.coalesce("most", F.lit(-1)) + 1 - F.coalesce("least", F.lit(0))).alias("_shift"))
    moved = new.select(*old.columns).crossJoin(F.broadcast(shift)).withColumn("n", F.col("n") + F.col("_shift")).drop("_shift")
    rows = old.unionByName(moved)
    return rows.groupBy("name").agg(F.min("n").alias("n"), F.max_by(F.struct(*rest), "n").alias("e")).select("n", "name", "e.*")


def prune(entries: DataFrame, status: str = "status") -> DataFrame:
    """Without the entries whose status says that they failed; one without a status is taken for good."""
    return entries.filter(F.coalesce(F.col(status), F.lit("ok")) == "ok")


def per_gene(template: DataFrame, seeds: DataFrame, mark: str = "{gene}") -> DataFrame:
    """Catalog entries asked for once a gene: ``mark`` in name, url and path stands for the symbol, which is also query_gene.
    ``template`` is the catalog's few such rows."""
    gene = seeds.select(F.upper("gene").alias("query_gene")).distinct()
    put = lambda c: F.replace(F.col(c), F.lit(mark), F.col("query_gene")).alias(c)
    marked = [c for c in ("name", "url", "path") if c in template.columns]
    rows = gene.crossJoin(F.broadcast(template.drop("query_gene")))  # a row a source
    return rows.select(*(put(c) if c in marked else F.col(c) for c in rows.columns))


def wanted(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """Catalog entries that no good entry of the manifest has yet in their version."""
    have = prune(manifest).select("name", "version").distinct()
    return catalog.join(have, (catalog["name"] == have["name"]) & catalog["version"].eqNullSafe(have["version"]), "left_anti")


def arrived(entries: DataFrame, path: str) -> DataFrame:
    """Entries with what lies at their own path among the files that ``path`` names: bytes, and status ok, missing or damaged
    (the checksum is not the expected one; an entry without one takes any). Paths are compared without their scheme and
    host. Files are hashed by tasks, one row a file of 2 GB at most."""
    plain = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    there = files.sha256(entries.sparkSession, path).select(plain("path").alias("_at"), F.col("sha256").alias("_sha"), "bytes")
    told = entries.drop("status", "bytes").withColumn("_at", plain("path")).join(there, "_at", "left")
    status: Column = F.when(F.col("_sha").isNull(), F.lit("missing")).when(F.col("sha256").isNotNull() & (F.lower("sha256") != F.col("_sha")), F.lit("damaged")).otherwise(F.lit("ok"))
    return told.withColumn("status", status).drop("_at", "_sha")


def write(entries: DataFrame, path: str, field: str = "datasets", order: Sequence[str] = ("n",)) -> None:
    """The entries as one JSON manifest. It is a document of a row a data set, so one task puts it together."""
    kept = [c for c in entries.columns if c not in order]
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*kept).alias("e")))), lambda x: x["e"])
    entries.agg(F.to_json(F.struct(listed.alias(field))).alias("value")).write.mode("overwrite").text(path)
