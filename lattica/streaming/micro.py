"""Incremental loads: micro-batches of triples into the graph tables, each triple key once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import canonical_relation, node_type
from ..operators.build import TRIPLE_KEY, node_updates, upsert_nodes
from ..operators.graph import cut
from ..sources import snapshots
from ..sources.sinks import append_edges

#: State lies in RocksDB on the executors' disks; a batch sends its own changes to the checkpoint, not the whole state.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def first_rows(stream: DataFrame, canonical: bool = True) -> DataFrame:
    """The rows of a stream whose key (head, relation, tail, source, version) no earlier batch had, one a key.

    The relation counts in its canonical form if ``canonical``. Of a batch's rows of a new key that of least weight,
    confidence and sign is given. The state knows when each key came first and last; a key is new while these agree, as
    a batch's time is one for all its rows and is the same when the batch runs again. So a batch looks up its own keys
    and no others, however many came before. The state grows with the distinct keys and lies in ranges of their hash
    over all executors; there is no event time after which a key could be forgotten. Use it in update mode.

    No column is held or sent twice: the key's are left to the key, and a row's order is the beginning of the row itself.
    Of rows of equal order the least by their other columns is given.
    """
    rel = canonical_relation(F.col("relation")) if canonical else F.col("relation")
    key = [(rel if c == "relation" else F.col(c)).alias(f"_{c}") for c in TRIPLE_KEY]
    order = ["weight", "confidence", "effect_sign"]
    held = [c for c in stream.columns if c not in order and (c not in TRIPLE_KEY or (canonical and c == "relation"))]
    rows = stream.select(*key, F.struct(*order, *held).alias("_r"), F.current_timestamp().alias("_at"))
    sortable = not any(kind in rows.schema["_r"].dataType.simpleString() for kind in ("map<", "variant"))
    least = F.min("_r") if sortable else F.min_by("_r", F.struct(*(f"_r.{c}" for c in order)))
    seen = rows.groupBy(*(f"_{c}" for c in TRIPLE_KEY)).agg(least.alias("_r"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    return seen.filter("_first = _last").select(*(F.col(f"_r.{c}") if c in order or c in held else F.col(f"_{c}").alias(c) for c in stream.columns))


def write_batch(rows: DataFrame, path: str, load: str, batch_id: int, normalise: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """One batch of new rows: normalise, write, commit.

    Edges go to ``edges``, nodes to ``nodes``: first the ends with their types, then the rows that name pathways, which so
    come last in ``read_nodes``. A batch that runs again overwrites its own folders; until its commit no reader sees them.
    """
    spark = rows.sparkSession
    folder = f"{path}/{load}/edges/batch={batch_id}"
    plain = not normalise and "kind" not in rows.columns
    made = cut(normalise(cut(rows))) if normalise else rows if plain else cut(rows)
    edges = made.filter("kind = 'edge'") if "kind" in made.columns else made
    append_edges(edges, folder, "overwrite")
    if plain:  # the batch is made once, by its writer
        edges = spark.read.schema(rows.schema).parquet(folder)
    ends = edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    nodes = ends.select("name", node_type(F.col("name")).alias("type"), F.lit(False).alias("is_seed"), F.lit(None).cast("string").alias("pathway_name"), F.lit(2 * batch_id).alias("seq"))
    if "kind" in made.columns:
        named = node_updates(made)
        nodes = nodes.unionByName(named.select("name", node_type(F.col("name")).alias("type"), F.lit(False).alias("is_seed"), "pathway_name", F.lit(2 * batch_id + 1).alias("seq")))
    nodes.write.mode("overwrite").parquet(f"{path}/{load}/nodes/batch={batch_id}")
    snapshots.commit(spark, path, load, batch_id + 1)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """The edges of all batches committed so far."""
    return snapshots.read(spark, path, "edges")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """name, type, is_seed, pathway_name of all batches committed so far: the last type, the last pathway name that isn't empty."""
    rows = snapshots.read(spark, path, "nodes").drop("batch")
    return upsert_nodes(rows.limit(0), rows)


def run_stream(spark: SparkSession, source_dir: str, schema: str, path: str, max_files: int = 1, normalise: Callable[[DataFrame], DataFrame] | None = None, canonical: bool = True, replace: bool = False) -> list[dict]:
    """Loads all Parquet files of a folder as a stream, ``max_files`` per batch, until none is left; what each batch did.

    A load that has committed is gone on with: files it has seen are passed over, keys it has seen are dropped. With
    ``replace``, or before any commit, a new load begins; the tables of the one before hold until its first batch is
    whole. One that ended before its first commit is begun anew.
    """
    now = None if replace else snapshots.current(spark, path)
    load = now[0] if now else snapshots.new_load()
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = first_rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir), canonical)
        write = lambda batch, batch_id: write_batch(batch, path, load, batch_id, normalise)
        query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/{load}/_progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    snapshots.clean(spark, path)
    return [p if isinstance(p, dict) else p.__dict__ for p in query.recentProgress]
