"""A knowledge graph over the order tables: customers are samples, parts genes, suppliers proteins, brands pathways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edge(df: DataFrame, head, relation, tail, source: str, weight, confidence, sign=None) -> DataFrame:
    as_column = lambda x: F.lit(float(x)) if isinstance(x, int | float) else x
    relation = F.lit(relation) if isinstance(relation, str) else relation
    return df.select(head.alias("head"), relation.alias("relation"), tail.alias("tail"), F.lit(source).alias("source"), F.lit("v1").alias("version"), as_column(weight).alias("weight"), as_column(confidence).alias("confidence"), as_column(0.0 if sign is None else sign).alias("effect_sign"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """head, relation, tail, source, version, weight, confidence, effect_sign; parallel edges are kept."""
    t = lambda name: table(spark, sf_dir, name)
    id_ = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    line, part = t("lineitem"), t("part")
    sign = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", -1.0).otherwise(0.0)
    strength = F.col("l_quantity") / 50
    expresses = _edge(line.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")), id_("sample::C", "o_custkey"), "expresses", id_("gene::P", "l_partkey"), "orders", F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength)), 1 - F.col("l_discount"), sign)
    flag = F.when(F.col("l_returnflag") == "A", F.lit("activates")).when(F.col("l_returnflag") == "R", F.lit("inhibits")).otherwise(F.lit("associated_with"))
    acts = _edge(line, id_("gene::P", "l_partkey"), flag, id_("protein::S", "l_suppkey"), "lineitem", strength, 1 - F.col("l_tax"), sign)
    takes = _edge(part, id_("gene::P", "p_partkey"), "participates", F.concat(F.lit("pathway::"), rules.normalize_entity(F.col("p_brand"))), "part", F.col("p_size") / 50, 0.75)
    nations = F.broadcast(t("nation"))  # 25 rows
    cell = F.concat(F.lit("Cell::"), rules.normalize_entity(F.col("n_name")))
    lives = _edge(t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")), id_("sample::C", "c_custkey"), "belongs_to", cell, "customer", 1.0, 0.9)
    sits = _edge(t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")), id_("protein::S", "s_suppkey"), "belongs_to", cell, "supplier", 1.0, 0.9)
    has = _edge(t("customer"), id_("sample::C", "c_custkey"), "has_condition", F.concat(F.lit("condition::"), rules.normalize_entity(F.col("c_mktsegment"))), "customer", 1.0, 0.9)
    return expresses.unionByName(acts).unionByName(takes).unionByName(lives).unionByName(sits).unionByName(has)


#: The same graph for DuckDB.
EDGES_SQL = r"""
  SELECT 'sample::C' || CAST(o_custkey AS VARCHAR) AS head, 'expresses' AS relation, 'gene::P' || CAST(l_partkey AS VARCHAR) AS tail, 'orders' AS source, 'v1' AS version,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_quantity / 50)) AS weight, 1 - l_discount AS confidence,
         CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS effect_sign
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 'gene::P' || CAST(l_partkey AS VARCHAR), CASE l_returnflag WHEN 'A' THEN 'activates' WHEN 'R' THEN 'inhibits' ELSE 'associated_with' END,
         'protein::S' || CAST(l_suppkey AS VARCHAR), 'lineitem', 'v1', l_quantity / 50, 1 - l_tax,
         CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END FROM lineitem
  UNION ALL
  SELECT 'gene::P' || CAST(p_partkey AS VARCHAR), 'participates', 'pathway::' || regexp_replace(trim(p_brand), '\s+', '_', 'g'), 'part', 'v1', p_size / 50.0::DOUBLE, 0.75::DOUBLE, 0.0::DOUBLE FROM part
  UNION ALL
  SELECT 'sample::C' || CAST(c_custkey AS VARCHAR), 'belongs_to', 'Cell::' || regexp_replace(trim(n_name), '\s+', '_', 'g'), 'customer', 'v1', 1.0::DOUBLE, 0.9::DOUBLE, 0.0::DOUBLE
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'protein::S' || CAST(s_suppkey AS VARCHAR), 'belongs_to', 'Cell::' || regexp_replace(trim(n_name), '\s+', '_', 'g'), 'supplier', 'v1', 1.0::DOUBLE, 0.9::DOUBLE, 0.0::DOUBLE
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 'sample::C' || CAST(c_custkey AS VARCHAR), 'has_condition', 'condition::' || regexp_replace(trim(c_mktsegment), '\s+', '_', 'g'), 'customer', 'v1', 1.0::DOUBLE, 0.9::DOUBLE, 0.0::DOUBLE FROM customer
"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene): the parts of size 1 of the first brand, as upper-case symbols; the graph's seed genes."""
    part = table(spark, sf_dir, "part")
    return part.filter((F.col("p_size") <= 10) & (F.col("p_brand") == "Brand#11")).select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene"))


SEEDS_SQL = "SELECT 'P' || CAST(p_partkey AS VARCHAR) AS gene FROM part WHERE p_size <= 10 AND p_brand = 'Brand#11'"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, type, is_seed of every endpoint."""
    from ..operators.graph import node_table

    return node_table(edges(spark, sf_dir), seeds(spark, sf_dir))


#: Expects a CTE or view ``edges``.
NODES_SQL = f"""
  SELECT name, CASE WHEN lower(name) LIKE 'cell::%' THEN 'Cell' WHEN regexp_matches(name, '^(gene|protein|pathway|sample|condition|mirna)::') THEN split_part(name, '::', 1) ELSE 'entity' END AS type,
         substr(name, 7) IN (SELECT gene FROM ({SEEDS_SQL})) AND name LIKE 'gene::%' AS is_seed
  FROM (SELECT head AS name FROM edges UNION SELECT tail FROM edges)
"""


def with_edges(sql: str) -> str:
    """DuckDB text with ``edges`` and ``nodes`` in front."""
    return f"WITH edges AS ({EDGES_SQL}), nodes AS ({NODES_SQL}) {sql}" if not sql.lstrip().startswith(",") else f"WITH edges AS ({EDGES_SQL}), nodes AS ({NODES_SQL}) {sql.lstrip()}"
