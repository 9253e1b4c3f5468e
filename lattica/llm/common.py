"""What the training-data operators share: scratch tables and connected components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores behind them where ``df`` has such a column (in any case of letters) already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or in local mode one of our own where unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "/tmp/lattica-checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _quietly_delete(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        pass


#: Scratch paths that haven't been deleted, in order.
_HELD: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's interpreter ends, or before by ``release``."""
    path = f"{shared_dir(spark)}/lattica-{label}-{uuid.uuid4().hex}"
    _HELD.append(path)
    atexit.register(_quietly_delete, spark, path)
    return path


def held() -> list[str]:
    """The scratch paths that haven't been deleted, oldest first."""
    return list(_HELD)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these scratch paths, once nothing that will still be computed reads them."""
    for path in paths:
        _quietly_delete(spark, path)
        if path in _HELD:
            _HELD.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` gave, once what was made of them is materialised too."""
    for df in tables:
        release(df.sparkSession, [df._lattica_path])


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs a re-read, not a recomputation, and the optimiser sees the table's true size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternates large-star and small-star contraction, O(log n) rounds in practice; each round is two aggregations
    and two equi-joins whose result is written to the shared folder. Self-loops and repeated edges are allowed.
    """
    kind = edges.schema["a"].dataType
    loops = materialise(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    current = loops.filter("u <> v")
    seen = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.least("v", "m").alias("u"), F.greatest("v", "m").alias("v")).filter("u <> v").distinct()
        # small star: u is the smaller end here, so every v looks at its smaller neighbours
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("c"), "u", "v")
        old = current if seen is not None else None
        current = materialise(
            small.select(F.explode(F.array(F.struct(F.col("c").alias("u"), F.col("u").alias("v")), F.struct(F.col("c").alias("u"), F.col("v"))))
                         .alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), "star")
        if old is not None:
            discard(old)
        # a star forest: no node is both a root and a leaf, and every leaf has one root
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("connected components did not converge")
    leaf = current.select(F.col("v").alias("node"), F.col("u").alias("component"))
    nodes = loops.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(leaf, "node", "left").select("node", F.coalesce("component", "node").cast(kind).alias("component"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session's context: their Python workers may not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_lattica_shipped", False):
        return
    import shutil
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lattica-")
    atexit.register(shutil.rmtree, folder, True)
    sc.addPyFile(shutil.make_archive(f"{folder}/lattica", "zip", root.parent, root.name))
    sc._lattica_shipped = True
