"""A graph that is there when it is asked for: the last commit, or a first load from a triples CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..schemas import TRIPLE
from . import sinks, snapshots

# What an empty field of the CSV stands for.
DEFAULTS = {"relation": "associated_with", "source": "unknown", "version": "unknown", "evidence": "", "weight": 1.0, "confidence": 0.5, "effect_sign": 1.0}


def bootstrap_triples(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a triples CSV by its header, whatever further columns it has: absent and empty fields take DEFAULTS, and so
    does what should be a number and isn't. Numbers are not clamped. Rows without an end go."""
    own = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    kinds = dict(x.split() for x in TRIPLE.split(", "))
    some = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in own.columns else F.lit(None).cast("string")
    made = own.select(*(some(c).try_cast(kind).alias(c) for c, kind in kinds.items()))
    return made.filter(F.col("head").isNotNull() & F.col("tail").isNotNull()).fillna(DEFAULTS)


def available_graph(spark: SparkSession, path: str, triples_path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph at ``path``. Only where nothing has been committed there, or a graph without an edge, is the
    CSV read; its graph is then committed, so that the next call reads tables. No seed is marked. A CSV that isn't there,
    or has no edge, leaves the graph empty and commits nothing."""
    if snapshots.current(spark, path) is not None and not snapshots.read(spark, path, "edges").isEmpty():
        return snapshots.read(spark, path, "nodes"), snapshots.read(spark, path, "edges")
    try:
        loaded = graph.cut(bootstrap_triples(spark, triples_path))
    except AnalysisException as x:
        if "PATH_NOT_FOUND" not in str(x):
            raise
        loaded = spark.createDataFrame([], TRIPLE)
    nodes = graph.node_table(loaded)
    if loaded.isEmpty():
        return nodes, loaded
    sinks.replace_graph(nodes, loaded, path)
    return snapshots.read(spark, path, "nodes"), snapshots.read(spark, path, "edges")
