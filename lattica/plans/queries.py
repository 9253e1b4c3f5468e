"""One query per operator of the graph library over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..operators import build, evaluate, graph, predict, retrieval, search
from ..sources import files
from .views import SEEDS_SQL, edges, nodes, seeds, table, with_edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WEIGHT = "(CASE WHEN weight IS NULL OR weight = 0 THEN 1.0::DOUBLE ELSE weight END)"
CONFIDENCE = "(CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5::DOUBLE ELSE confidence END)"
SIGNAL = f"greatest(0.0::DOUBLE, {WEIGHT} * {CONFIDENCE})"
SIGN = "(CASE WHEN effect_sign IS NULL OR effect_sign = 0 THEN 1.0::DOUBLE ELSE effect_sign END)"
ORDER = ", ".join(graph.EDGE_ORDER)
INCIDENT = "(SELECT head AS node, tail AS other, * FROM edges UNION ALL SELECT tail, head, * FROM edges)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def kg(sql: str) -> Callable[[Query], Query]:
    """A query whose SQL reads ``edges`` and ``nodes``."""
    return query(with_edges(sql))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def node_type_sql(c: str) -> str:
    return f"CASE WHEN lower({c}) LIKE 'cell::%' THEN 'Cell' WHEN regexp_matches({c}, '^(gene|protein|pathway|sample|condition|mirna)::') THEN split_part({c}, '::', 1) ELSE 'entity' END"


def seed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return seeds(spark, sf).select(F.concat(F.lit("gene::"), "gene").alias("seed"))


# --- graph reads

def _levels(node: str) -> str:
    cols = f"head, relation, tail, {SIGNAL} AS signal, {SIGN} AS sign"
    return f", one AS (SELECT * FROM edges WHERE head = '{node}'), two AS (SELECT * FROM edges WHERE head IN (SELECT tail FROM one) AND head <> '{node}') SELECT 1 AS depth, {cols} FROM one UNION ALL SELECT 2, {cols} FROM two"


@kg(_levels("sample::C10"))
def g01_neighbours(spark, sf):
    return graph.neighbours(edges(spark, sf), "sample::C10", 2)


def _walks_sql() -> str:
    def hop(h: int, source: str) -> str:
        return (f", w{h} AS (SELECT s.origin, l.tail AS node, s.signal * l.s AS signal, s.direction * l.d AS direction FROM {source} s JOIN lean l ON s.node = l.head)"
                f", h{h} AS (SELECT origin, node, signal, direction, {h} AS hops FROM w{h} QUALIFY row_number() OVER (PARTITION BY origin, node ORDER BY signal DESC, direction DESC) = 1)")

    return (f", lean AS (SELECT head, tail, {SIGNAL} AS s, {SIGN} AS d FROM edges QUALIFY row_number() OVER (PARTITION BY head, tail ORDER BY s DESC, d DESC) = 1)"
            ", h0 AS (SELECT name AS origin, name AS node, 1.0::DOUBLE AS signal, 1.0::DOUBLE AS direction FROM nodes WHERE type = 'sample')"
            + hop(1, "h0") + hop(2, "h1") + hop(3, "h2")
            + ", scored AS (SELECT *, signal * pow(0.78::DOUBLE, hops - 1) * (CASE WHEN node LIKE 'pathway::%' THEN 1.12::DOUBLE ELSE 1.0::DOUBLE END) AS score"
            " FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) WHERE regexp_matches(node, '^(gene|pathway|protein)::') AND node <> origin)"
            " SELECT origin, node, hops, round(signal, 6) AS raw_signal, round(score, 6) AS score, direction AS direction_sign FROM scored WHERE score >= 0.01"
            " QUALIFY row_number() OVER (PARTITION BY origin, node ORDER BY score DESC, hops, signal DESC, direction DESC) = 1")


@kg(_walks_sql())
def g02_ranked_candidates(spark, sf):
    origins = nodes(spark, sf).filter("type = 'sample'").select(F.col("name").alias("origin"))
    return rounded(graph.ranked_candidates(edges(spark, sf), origins), "raw_signal", "score")


@kg(f", near AS (SELECT *, true AS is_out FROM edges WHERE head = 'gene::P7' UNION ALL SELECT *, false FROM edges WHERE tail = 'gene::P7') SELECT head, relation, tail, weight, confidence, is_out FROM near ORDER BY is_out DESC, {ORDER} LIMIT 300")
def g03_one_hop(spark, sf):
    return graph.one_hop(edges(spark, sf), "gene::P7")


HITS = "hits AS (SELECT *, (contains(lower(head), 's1') OR contains(lower(tail), 's1')) AS node_hit, contains(lower(relation), 'activ') AS relation_hit FROM edges)"


@kg(f", {HITS}, f AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS seq FROM hits WHERE node_hit AND relation_hit QUALIFY seq <= 500),"
    " ends AS (SELECT name, min(2 * seq + side) AS pos FROM (SELECT head AS name, seq, 0 AS side FROM f UNION ALL SELECT tail, seq, 1 FROM f) GROUP BY name),"
    " adm AS (SELECT name FROM ends ORDER BY pos LIMIT 200)"
    " SELECT CAST(seq AS INTEGER) AS seq, head, relation, tail, weight, confidence, 'both' AS matched_by FROM f WHERE head IN (SELECT name FROM adm) AND tail IN (SELECT name FROM adm)")
def g04_keyword_subgraph(spark, sf):
    return graph.keyword_subgraph(edges(spark, sf), "S1", "activ")


@kg(f", {HITS} SELECT count(*) AS matched, CAST(sum(node_hit::INT) AS BIGINT) AS node_hits, CAST(sum(relation_hit::INT) AS BIGINT) AS relation_hits, CAST(sum((node_hit AND relation_hit)::INT) AS BIGINT) AS both_hits FROM hits WHERE node_hit OR relation_hit")
def a28_match_stats(spark, sf):
    return graph.match_stats(edges(spark, sf), "S1", "activ", "or")


def _index(spark: SparkSession, sf: str) -> search.NameIndex:
    return search.NameIndex.build(edges(spark, sf), graph.scratch(spark, "names"))


def _named_sql(text: str) -> str:
    hit = f"(contains(lower(head), '{text}') OR contains(lower(tail), '{text}'))"
    return (f", f AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS seq FROM (SELECT * FROM edges WHERE {hit} ORDER BY {ORDER} LIMIT 500)),"
            " ends AS (SELECT name, min(2 * seq + side) AS pos FROM (SELECT head AS name, seq, 0 AS side FROM f UNION ALL SELECT tail, seq, 1 FROM f) GROUP BY name), adm AS (SELECT name FROM ends ORDER BY pos LIMIT 200)"
            " SELECT CAST(seq AS INTEGER) AS seq, head, relation, tail, weight, confidence, 'node' AS matched_by FROM f WHERE head IN (SELECT name FROM adm) AND tail IN (SELECT name FROM adm)")


@kg(_named_sql("ein::s1"))
def g04_indexed_subgraph(spark, sf):
    """The index built and read: a text across the type and the name, of suppliers S1, S10, ..., whose edges meet both their ends."""
    return _index(spark, sf).subgraph("Ein::S1")


@kg(", h AS (SELECT contains(lower(head), 'e::p19') OR contains(lower(tail), 'e::p19') AS n, contains(lower(relation), 'inhib') AS r FROM edges)"
    " SELECT count(*) AS matched, count(*) AS node_hits, count(*) AS relation_hits, count(*) AS both_hits FROM h WHERE n AND r")
def a28_indexed_stats(spark, sf):
    return _index(spark, sf).stats("e::P19", "INHIB")


@kg(f", f AS (SELECT name FROM nodes ORDER BY name LIMIT 2100) SELECT head, relation, tail, weight, confidence FROM edges WHERE head IN (SELECT name FROM f) AND tail IN (SELECT name FROM f) ORDER BY {ORDER} LIMIT 200")
def g05_visual_sample(spark, sf):
    return graph.visual_sample(edges(spark, sf), nodes(spark, sf), 2100, 200)


def _linked_sql(own: str, other: str, limit: int) -> str:
    return (f", b AS (SELECT node, other, max({SIGNAL}) AS signal FROM {INCIDENT} WHERE node LIKE '{own}::%' AND other LIKE '{other}::%' AND {SIGNAL} >= 0.02 GROUP BY node, other)"
            f" SELECT node, other, signal, CAST(row_number() OVER (PARTITION BY node ORDER BY signal DESC, other) AS INTEGER) AS place FROM b QUALIFY place <= {limit}")


@kg(_linked_sql("gene", "pathway", 20))
def g06_gene_linked_pathways(spark, sf):
    return graph.linked(edges(spark, sf), nodes(spark, sf).filter("type = 'gene'").withColumnRenamed("name", "node"), "pathway::", 20)


@kg(_linked_sql("pathway", "gene", 40))
def g06_pathway_linked_genes(spark, sf):
    return graph.linked(edges(spark, sf), nodes(spark, sf).filter("type = 'pathway'").withColumnRenamed("name", "node"), "gene::", 40)


@kg("SELECT name AS node, CASE WHEN name LIKE 'gene::%' THEN substr(name, 7) ELSE name END AS label FROM nodes")
def g07_labels(spark, sf):
    return graph.resolve_labels(edges(spark, sf), nodes(spark, sf).withColumnRenamed("name", "node"))


@kg(", v AS (SELECT type AS kind, name AS value FROM nodes UNION ALL SELECT DISTINCT 'relation', relation FROM edges) SELECT kind, value FROM v QUALIFY row_number() OVER (PARTITION BY kind ORDER BY value) <= 200")
def g08_filter_options(spark, sf):
    return graph.filter_options(edges(spark, sf), nodes(spark, sf))


@kg("SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM nodes) AS nodes")
def g09_stats(spark, sf):
    return graph.stats(edges(spark, sf))


#: Least names travel along edges for so many rounds; the tables' graph is far less deep.
_ROUNDS = 12
_LEAST = "".join(
    f", l{k} AS (SELECT node, least(any_value(own), min(near)) AS low FROM (SELECT i.node, a.low AS own, b.low AS near FROM inc i JOIN l{k - 1} a ON a.node = i.node JOIN l{k - 1} b ON b.node = i.other) GROUP BY node)" for k in range(1, _ROUNDS + 1))
COMPONENTS = f", inc AS (SELECT DISTINCT node, other FROM {INCIDENT}), l0 AS (SELECT name AS node, name AS low FROM nodes){_LEAST} SELECT node AS name, low AS component FROM l{_ROUNDS}"


@kg(COMPONENTS)
def g11_components(spark, sf):
    return graph.components(edges(spark, sf))


@kg(COMPONENTS.replace(" SELECT node AS name", ", comps AS (SELECT node AS name") + ") SELECT component, count(*) AS size FROM comps GROUP BY component ORDER BY size DESC, component LIMIT 5")
def g11_component_sizes(spark, sf):
    return graph.component_sizes(edges(spark, sf))


@kg(COMPONENTS)
def g12_all_components(spark, sf):
    """The components once more, from edges that lost their order."""
    return graph.components(edges(spark, sf).select("tail", "head").toDF("head", "tail"))


@query("SELECT -1.0::DOUBLE AS average, -1 AS diameter")
def g12_shortest_paths(spark, sf):
    """Edges lead from samples to genes and on to cells and never back, so the giant component isn't strongly connected."""
    return graph.shortest_paths(edges(spark, sf), max_nodes=400)


@kg(", arcs AS (SELECT DISTINCT head, tail FROM edges WHERE head <> tail), w AS (SELECT head, tail, count(*) AS w FROM (SELECT head, tail FROM arcs UNION ALL SELECT tail, head FROM arcs) GROUP BY head, tail),"
    " d AS (SELECT head, sum(w) AS d, count(*) FILTER (w = 2) AS r FROM w GROUP BY head),"
    " t AS (SELECT a.head, sum(a.w * b.w * c.w) / 2 AS t FROM w a JOIN w b ON a.tail = b.head JOIN w c ON b.tail = c.tail AND a.head = c.head WHERE a.head <> b.tail GROUP BY a.head)"
    " SELECT d.head AS name, CASE WHEN coalesce(t, 0) > 0 THEN CAST(t AS DOUBLE) / CAST(2 * (d * (d - 1) - 2 * r) AS DOUBLE) ELSE 0.0::DOUBLE END AS clustering FROM d LEFT JOIN t USING (head)")
def g13_clustering(spark, sf):
    return graph.clustering(edges(spark, sf))


@kg("SELECT 'condition::' || n_name AS name, 'condition' AS type, false AS is_seed FROM nation")
def g14_isolated(spark, sf):
    """The whole graph's nodes and the nations as conditions, which no edge touches."""
    more = table(spark, sf, "nation").select(F.concat(F.lit("condition::"), "n_name").alias("name"), F.lit("condition").alias("type"), F.lit(False).alias("is_seed"))
    return graph.isolated(nodes(spark, sf).unionByName(more), edges(spark, sf))


# --- building

def bought(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, sample, value): the largest quantity of a part that a customer ordered, over 50."""
    line = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    best = line.groupBy("l_partkey", "o_custkey").agg(F.max("l_quantity").alias("q"))
    return best.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("entity"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sample"), (F.col("q") / 50).alias("value"))


BOUGHT = "bought AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS entity, 'C' || CAST(o_custkey AS VARCHAR) AS sample, max(l_quantity) / 50 AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, o_custkey)"


@query(f"WITH {BOUGHT}, cells AS (SELECT DISTINCT sample FROM bought), p AS (SELECT 'cell::' || sample AS cell, 'pathway::perturbation::' || translate(upper(trim(coalesce(c_mktsegment, 'unknown'))), '- ', '__') AS pert FROM cells LEFT JOIN customer ON sample = 'C' || CAST(c_custkey AS VARCHAR)),"
       " top AS (SELECT 'gene::' || entity AS gene, 'cell::' || sample AS cell, value FROM bought QUALIFY row_number() OVER (PARTITION BY sample ORDER BY value DESC, entity) <= 20),"
       " e AS (SELECT pert AS head, 'belongs_to' AS relation, cell AS tail, 1.0::DOUBLE AS weight, 0.9::DOUBLE AS confidence FROM p UNION ALL SELECT cell, 'associated_with', pert, 0.9, 0.8 FROM p"
       " UNION ALL SELECT gene, 'belongs_to', cell, value, 0.9 FROM top WHERE value > 0.5 UNION ALL SELECT cell, 'associated_with', gene, value, 0.85 FROM top WHERE value > 0.5) SELECT *, 0.0::DOUBLE AS effect_sign FROM e")
def g15_cell_graph(spark, sf):
    who = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("cell_id"), F.col("c_mktsegment").alias("perturbation"))
    return build.cell_graph(bought(spark, sf).withColumnRenamed("sample", "cell"), who)


def _token_type(c: str) -> str:
    return f"CASE WHEN lower({c}) LIKE 'gene::%' THEN 'gene' WHEN lower({c}) LIKE 'protein::%' OR {c} LIKE '9606.%' OR lower({c}) LIKE 'ensp%' THEN 'protein' WHEN lower({c}) LIKE 'pathway::%' THEN 'pathway' WHEN contains(lower({c}), 'a549') OR contains(lower({c}), 'cell') THEN 'Cell' ELSE 'gene' END"


@query(r"WITH s AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+') AS a FROM documents), w AS (SELECT doc_id, [x FOR x IN a IF x <> ''][1:100] AS w FROM s), t AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM w),"
       " d AS (SELECT doc_id, tok, min(i) AS i FROM t GROUP BY doc_id, tok), n AS (SELECT doc_id, CAST(row_number() OVER o - 1 AS INTEGER) AS position, tok AS head, lead(tok) OVER o AS tail FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY i))"
       f" SELECT doc_id, position, head, tail, {_token_type('head')} AS head_type, {_token_type('tail')} AS tail_type, 0.2::DOUBLE AS weight, 0.3::DOUBLE AS confidence FROM n WHERE tail IS NOT NULL")
def g16_text_graph(spark, sf):
    return build.text_graph(table(spark, sf, "documents"))


@kg(f"SELECT head, relation, tail, {node_type_sql('head')} AS head_type, {node_type_sql('tail')} AS tail_type, relation AS raw_relation, 'edge' AS kind, source, version, weight, confidence,"
    " CASE WHEN effect_sign <> 0 THEN effect_sign WHEN relation = 'activates' THEN 1.0::DOUBLE WHEN relation = 'inhibits' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS effect_sign FROM edges")
def g17_normalise(spark, sf):
    e = edges(spark, sf)
    return build.normalise(e, build.gene_dictionary(e, seeds(spark, sf), from_ids=False))


@kg(f"SELECT substr(name, 7) AS symbol FROM nodes WHERE name LIKE 'gene::%' UNION SELECT upper(gene) FROM ({SEEDS_SQL})")
def g18_gene_dictionary(spark, sf):
    return build.gene_dictionary(edges(spark, sf), seeds(spark, sf))


STRENGTH = "strength AS (SELECT head AS gene, tail AS pathway, max(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (weight + confidence) / 2))) AS strength FROM edges WHERE relation = 'participates' AND head LIKE 'gene::%' AND tail LIKE 'pathway::%' GROUP BY head, tail)"
SHARED = (f"{STRENGTH}, seed AS (SELECT DISTINCT upper(gene) AS g, 'gene::' || upper(gene) AS seed FROM ({SEEDS_SQL})),"
          " pairs AS (SELECT a.gene AS seed, b.gene AS other, a.pathway, least(1.0::DOUBLE, sqrt(a.strength * b.strength)) AS score FROM strength a JOIN seed ON a.gene = seed.seed JOIN strength b ON a.pathway = b.pathway AND a.gene <> b.gene WHERE a.strength >= 0.45 AND b.strength >= 0.45),"
          " best AS (SELECT * FROM pairs WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY seed, other ORDER BY score DESC, pathway DESC) = 1),"
          " shared AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed ORDER BY score DESC, other) AS INTEGER) AS place FROM best QUALIFY place <= 80)")
METHODS = ", ".join(f"'{m}'" for m in rules.METHODS)
AUGMENTED = f"""{SHARED}, m AS (SELECT unnest([{METHODS}]) AS method),
  sm AS (SELECT g, seed, 'pathway::perturbation::' || method || '_' || g AS head, 'pathway::perturb_method::' || method AS how FROM seed, m),
  near AS (SELECT * FROM (
      SELECT head AS seed, tail AS other, relation, weight, confidence, 0 AS way FROM edges WHERE head IN (SELECT seed FROM seed)
      UNION ALL SELECT tail, head, relation, weight, confidence, 1 FROM edges WHERE head <> tail AND tail IN (SELECT seed FROM seed))
    WHERE regexp_matches(other, '^(gene|protein|pathway|Cell)::') AND other <> seed
    QUALIFY row_number() OVER (PARTITION BY seed ORDER BY weight DESC, way, other, relation, confidence DESC) <= 120),
  firsts AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY seed, relation, other ORDER BY weight DESC, way, confidence DESC) = 1),
  aug AS (
    SELECT head, 'has_perturbation_method' AS relation, how AS tail, 0.95::DOUBLE AS weight, 0.9::DOUBLE AS confidence FROM sm
    UNION ALL SELECT head, 'targets_gene', seed, 1.0, 0.92 FROM sm
    UNION ALL SELECT sm.head, 'affects_' || relation, other,
      greatest(0.2::DOUBLE, least(1.0::DOUBLE, (CASE WHEN weight IS NULL OR weight = 0 THEN 0.6::DOUBLE ELSE weight END) * 0.85::DOUBLE)),
      greatest(0.2::DOUBLE, least(1.0::DOUBLE, (CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.6::DOUBLE ELSE confidence END) * 0.85::DOUBLE)) FROM firsts JOIN sm USING (seed)
    UNION ALL SELECT sm.head, 'affects_shared_pathway_2hop', other, least(1.0::DOUBLE, 0.58::DOUBLE * (0.7::DOUBLE + 0.6::DOUBLE * score)), least(1.0::DOUBLE, 0.62::DOUBLE * (0.7::DOUBLE + 0.6::DOUBLE * score)) FROM shared JOIN sm USING (seed))"""


def augmented(spark: SparkSession, sf: str) -> DataFrame:
    return build.augment(edges(spark, sf), seeds(spark, sf))


@kg(f", {STRENGTH} SELECT gene, pathway, strength FROM strength")
def a03_pathway_strength(spark, sf):
    return build.gene_pathway_strength(edges(spark, sf))


@kg(f", {SHARED} SELECT seed, other, pathway, round(score, 6) AS score, place FROM shared")
def j06_shared_pathway(spark, sf):
    return rounded(build.shared_pathway(edges(spark, sf), seed_nodes(spark, sf)).select("seed", "other", "pathway", "score", "place"), "score")


@kg(f", {AUGMENTED} SELECT head, relation, tail, round(weight, 6) AS weight, round(confidence, 6) AS confidence FROM aug")
def g19_augment(spark, sf):
    return rounded(augmented(spark, sf), "weight", "confidence")


@query(rf"WITH {BOUGHT}, s AS (SELECT DISTINCT sample FROM bought), m AS (SELECT 'sample::' || sample AS head, 'Cell::' || regexp_replace(trim(n_name), '\s+', '_', 'g') AS cell, 'condition::' || regexp_replace(trim(c_mktsegment), '\s+', '_', 'g') AS cond FROM s JOIN customer ON sample = 'C' || CAST(c_custkey AS VARCHAR) JOIN nation ON c_nationkey = n_nationkey),"
       " top AS (SELECT * FROM bought QUALIFY row_number() OVER (PARTITION BY sample ORDER BY value DESC, entity) <= 30)"
       " SELECT 'sample::' || sample AS head, 'expresses' AS relation, 'gene::' || upper(entity) AS tail, 'orders' AS source, 'v1' AS version, value AS weight, 0.7::DOUBLE AS confidence FROM top WHERE value >= 0.1"
       " UNION ALL SELECT head, 'belongs_to', cell, 'orders', 'v1', 1.0, 0.9 FROM m UNION ALL SELECT head, 'has_condition', cond, 'orders', 'v1', 1.0, 0.9 FROM m")
def g20_omics_triples(spark, sf):
    spec = spark.createDataFrame([("orders", "expression", "orders", "v1", 30, 0.1, 0.7)], "name string, modality string, source string, version string, top_k int, min_value double, confidence double")
    who = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("sample"), F.col("n_name").alias("cell_line"), F.col("c_mktsegment").alias("condition"))
    return build.omics_triples(bought(spark, sf).withColumn("name", F.lit("orders")), spec, who)


@kg(", n AS (SELECT head, tail, relation, weight, confidence, row_number() OVER (PARTITION BY head, tail ORDER BY relation, weight, confidence) AS k FROM edges),"
    " b AS (SELECT head, tail, relation, weight / 2 AS weight, confidence, row_number() OVER (PARTITION BY head, tail ORDER BY relation, weight / 2, confidence) AS k FROM edges WHERE relation <> 'expresses' UNION ALL SELECT head, 'gene::new', 'x', 1.0, 1.0, row_number() OVER (PARTITION BY head) FROM edges WHERE relation = 'has_condition')"
    " SELECT head, tail, coalesce(b.relation, n.relation) AS relation, coalesce(b.weight, n.weight) AS weight, coalesce(b.confidence, n.confidence) AS confidence FROM n FULL JOIN b USING (head, tail, k)")
def k06_compose(spark, sf):
    """All edges, over which newer ones with half the weight come, and some between other ends."""
    lean = edges(spark, sf).select("head", "tail", "relation", "weight", "confidence")
    newer = lean.filter("relation <> 'expresses'").withColumn("weight", F.col("weight") / 2)
    other = lean.filter("relation = 'has_condition'").select("head", F.lit("gene::new").alias("tail"), F.lit("x").alias("relation"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"))
    return graph.compose(lean, newer.unionByName(other))


@kg("SELECT name, type, is_seed, CASE WHEN type = 'pathway' THEN substr(name, 10) END AS pathway_name FROM nodes")
def k02_upsert_nodes(spark, sf):
    own = nodes(spark, sf)
    named = own.filter("type = 'pathway'").select("name", "type", F.lit(False).alias("is_seed"), F.expr("substr(name, 10)").alias("pathway_name"), F.lit(1).alias("seq"))
    return build.upsert_nodes(own.select("name", "type", "is_seed", F.lit(None).cast("string").alias("pathway_name"), F.lit(0).alias("seq")), named)


@kg("SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY head, relation, tail, source, version ORDER BY weight, confidence, effect_sign) = 1")
def a01_dedup_triples(spark, sf):
    return build.dedup_triples(edges(spark, sf), ["weight", "confidence", "effect_sign"])


# --- aggregates and statistics

@kg("SELECT 'type' AS kind, type AS value, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation UNION ALL SELECT 'source', source, count(*) FROM edges GROUP BY source")
def a04_counts(spark, sf):
    e = edges(spark, sf)
    part = lambda kind, df: df.select(F.lit(kind).alias("kind"), "value", "n")
    return part("type", evaluate.counts_by(nodes(spark, sf), "type")).unionByName(part("relation", evaluate.counts_by(e, "relation"))).unionByName(part("source", evaluate.counts_by(e, "source")))


@kg("SELECT source, count(DISTINCT name) AS entities, CAST(count(*) / 2 AS BIGINT) AS edges FROM (SELECT source, head AS name FROM edges UNION ALL SELECT source, tail FROM edges) GROUP BY source")
def a05_entities_per_source(spark, sf):
    return evaluate.entities_per_source(edges(spark, sf))


DEGREES = "degrees AS (SELECT name, CAST(sum(1 - o) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT head AS name, 1 AS o FROM edges UNION ALL SELECT tail, 0 FROM edges) GROUP BY name)"


@kg(f", {DEGREES} SELECT * FROM degrees")
def a06_degrees(spark, sf):
    return evaluate.degrees(edges(spark, sf))


@kg(f", {DEGREES}, l AS (SELECT list(degree ORDER BY degree) AS v, count(*) AS n, avg(degree) AS mean FROM degrees) SELECT n, v[1] AS least, round(mean, 6) AS mean, v[n // 2 + 1] AS median, v[least(n - 1, CAST(floor(n * 0.99::DOUBLE) AS BIGINT)) + 1] AS p99, v[n] AS most FROM l")
def a06_degree_statistics(spark, sf):
    return rounded(evaluate.order_statistics(evaluate.degrees(edges(spark, sf)), "degree"), "mean")


@kg(", c AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges) SELECT nodes, edges, CAST(edges AS DOUBLE) / CAST(nodes * (nodes - 1) AS DOUBLE) AS density, CAST(2 * edges AS DOUBLE) / CAST(nodes AS DOUBLE) AS average_degree FROM c")
def a07_density(spark, sf):
    return evaluate.density(edges(spark, sf))


@kg(f", {AUGMENTED} SELECT head, count(*) AS edges, CAST(sum((relation LIKE 'affects!_%' ESCAPE '!')::INT) AS BIGINT) AS affects,"
    " count(DISTINCT tail) FILTER (relation LIKE 'affects!_%' ESCAPE '!' AND tail LIKE 'gene::%') AS genes, count(DISTINCT tail) FILTER (relation LIKE 'affects!_%' ESCAPE '!' AND tail LIKE 'protein::%') AS proteins,"
    " count(DISTINCT tail) FILTER (relation LIKE 'affects!_%' ESCAPE '!' AND tail LIKE 'pathway::%') AS pathways FROM aug GROUP BY head")
def a08_perturbation_sparsity(spark, sf):
    return evaluate.perturbation_sparsity(augmented(spark, sf))


@query("WITH r AS (SELECT upper(p_type) AS protein, (p_retailprice - 1500) / 500 AS log2_fc, p_brand AS source, p_partkey AS n FROM part) SELECT protein, log2_fc, source FROM r QUALIFY row_number() OVER (PARTITION BY protein ORDER BY abs(log2_fc) DESC, n) = 1")
def a10_best_calibration(spark, sf):
    rows = table(spark, sf, "part").select(F.upper("p_type").alias("protein"), ((F.col("p_retailprice") - 1500) / 500).alias("log2_fc"), F.col("p_brand").alias("source"), F.col("p_partkey").alias("n"))
    return files.best_calibration(rows)


@query("WITH r AS (SELECT upper(p_type) AS protein, (p_retailprice - 1500) / 500 AS log2_fc, p_brand AS source, p_partkey AS n FROM part) SELECT protein, round(median(log2_fc), 6) AS log2_fc, arg_min(source, n) AS source FROM r GROUP BY protein")
def a09_median_calibration(spark, sf):
    rows = table(spark, sf, "part").select(F.upper("p_type").alias("protein"), ((F.col("p_retailprice") - 1500) / 500).alias("log2_fc"), F.col("p_brand").alias("source"), F.col("p_partkey").alias("n"))
    return rounded(files.median_calibration(rows), "log2_fc")


@kg(", n AS (SELECT tail AS node, relation, count(*) AS n FROM edges WHERE head LIKE 'sample::%' AND relation = 'expresses' AND tail LIKE 'gene::%' GROUP BY tail, relation) SELECT node, round(least(1.0::DOUBLE, 0.40::DOUBLE * (CAST(n AS DOUBLE) / CAST(max(n) OVER () AS DOUBLE))), 6) AS omics_boost FROM n")
def a11_omics_boost(spark, sf):
    return rounded(predict.omics_boost(edges(spark, sf), nodes(spark, sf).filter("type = 'gene'").withColumnRenamed("name", "node")), "omics_boost")


@kg(", n AS (SELECT head, relation, count(*) AS n FROM edges GROUP BY head, relation) SELECT relation, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM n GROUP BY relation")
def a13_per_node(spark, sf):
    return rounded(evaluate.per_node_by_relation(edges(spark, sf)), "mean")


@kg(f"SELECT relation, {node_type_sql('tail')} AS tail_type, count(*) AS n FROM edges GROUP BY ALL")
def a14_relation_targets(spark, sf):
    return evaluate.relation_targets(edges(spark, sf))


@kg(f", {AUGMENTED} SELECT regexp_replace(head, '^pathway::perturbation::[^_]+_', '') AS gene, CAST(sum((relation LIKE 'affects!_%' ESCAPE '!' AND relation <> 'affects_shared_pathway_2hop')::INT) AS BIGINT) AS direct, CAST(sum((relation = 'affects_shared_pathway_2hop')::INT) AS BIGINT) AS two_hop, count(*) AS total FROM aug GROUP BY 1")
def e10_hop_breakdown(spark, sf):
    return evaluate.hop_breakdown(augmented(spark, sf))


@kg(f", {DEGREES} SELECT quantile_disc(degree, 0.33) AS low, quantile_disc(degree, 0.67) AS high FROM degrees WHERE name LIKE 'gene::%'")
def a16_degree_terciles(spark, sf):
    return evaluate.degree_terciles(edges(spark, sf)).select(F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


@kg(f", {DEGREES}, g AS (SELECT name, degree FROM degrees WHERE name LIKE 'gene::%'), b AS (SELECT quantile_disc(degree, 0.33) AS low, quantile_disc(degree, 0.67) AS high FROM g), seed AS (SELECT 'gene::' || upper(gene) AS name FROM ({SEEDS_SQL})),"
    " l AS (SELECT name, CASE WHEN degree <= low THEN 0 WHEN degree <= high THEN 1 ELSE 2 END AS level FROM g, b WHERE name NOT IN (SELECT name FROM seed)),"
    " p AS (SELECT name FROM l QUALIFY row_number() OVER (PARTITION BY level ORDER BY name) <= 76 UNION ALL SELECT DISTINCT name FROM seed WHERE name IN (SELECT name FROM g)) SELECT name FROM p ORDER BY name LIMIT 200")
def w13_stratified_genes(spark, sf):
    return evaluate.stratified_genes(edges(spark, sf), seeds(spark, sf))


@kg(f", i AS (SELECT node, source, count(*) AS n FROM {INCIDENT} WHERE node LIKE 'gene::%' GROUP BY node, source), r AS (SELECT source, n / CAST(sum(n) OVER (PARTITION BY node) AS DOUBLE) AS r FROM i)"
    " SELECT source, round(avg(r), 6) AS mean, round(1.96::DOUBLE * stddev_pop(r) / sqrt(count(*)), 6) AS ci95, count(*) AS coverage FROM r GROUP BY source")
def a17_source_contribution(spark, sf):
    return rounded(evaluate.source_contribution(edges(spark, sf)), "mean", "ci95")


@kg("SELECT CAST(least(9, floor(weight * 10)) AS INTEGER) AS bin, count(*) AS n, min(weight) AS least, max(weight) AS most FROM edges WHERE weight IS NOT NULL GROUP BY 1")
def a19_histogram(spark, sf):
    return evaluate.histogram(edges(spark, sf))


@kg("SELECT count(DISTINCT source) AS sources, count(*) FILTER (effect_sign > 0.1) AS positive, count(*) FILTER (effect_sign < -0.1) AS negative, count(*) FILTER (effect_sign BETWEEN -0.1 AND 0.1) AS neutral FROM edges")
def a20_semantics(spark, sf):
    return evaluate.semantics(edges(spark, sf))


@kg(", o AS (SELECT count(DISTINCT relation) FILTER (relation = 'expresses') AS modalities, count(DISTINCT head) FILTER (head LIKE 'sample::%') AS samples, count(*) FILTER (relation = 'expresses') AS omics_edges, count(*) AS n FROM edges)"
    " SELECT modalities, samples, omics_edges, round(least(1.0::DOUBLE, modalities / 5.0::DOUBLE) * least(1.0::DOUBLE, samples / 100.0::DOUBLE) * (CAST(omics_edges AS DOUBLE) / n), 6) AS score FROM o")
def e02_multi_omics(spark, sf):
    return rounded(evaluate.multi_omics(edges(spark, sf)), "score")


@kg(f", {AUGMENTED} SELECT (SELECT count(DISTINCT head) FROM aug) AS nodes, (SELECT count(*) FROM aug) AS edges, (SELECT count(*) FROM seed) AS seeds, (SELECT count(DISTINCT tail) FROM aug WHERE relation = 'targets_gene') AS covered")
def e05_perturbation_coverage(spark, sf):
    return evaluate.perturbation_coverage(augmented(spark, sf), seeds(spark, sf))


@kg("SELECT relation, count(*) AS removed, CAST((SELECT count(*) FROM edges) - count(*) AS DOUBLE) / (SELECT count(*) FROM edges) AS retained FROM edges GROUP BY relation")
def e13_modality_ablation(spark, sf):
    return evaluate.modality_ablation(edges(spark, sf))


# --- joins

@kg("SELECT e.*, h.type AS head_type, h.is_seed AS head_is_seed, t.type AS tail_type, t.is_seed AS tail_is_seed FROM edges e JOIN nodes h ON h.name = e.head JOIN nodes t ON t.name = e.tail")
def j01_typed_edges(spark, sf):
    return graph.with_types(edges(spark, sf), nodes(spark, sf))


@kg(f", i AS (SELECT node, other FROM {INCIDENT} WHERE node LIKE 'gene::%' AND regexp_matches(other, '^(protein|pathway)::')) SELECT a.node AS origin, split_part(a.other, '::', 1) AS via_type, count(*) AS paths FROM i a JOIN i b ON a.other = b.other AND a.node <> b.node GROUP BY ALL")
def j14_two_hop_paths(spark, sf):
    return evaluate.two_hop_paths(edges(spark, sf), nodes(spark, sf).filter("type = 'gene'")).filter("paths > 0")


@kg(f", {AUGMENTED}, h AS (SELECT DISTINCT regexp_replace(head, '^pathway::perturbation::[^_]+_', '') AS gene, head, tail FROM aug WHERE relation LIKE 'affects!_%' ESCAPE '!'), l AS (SELECT gene, head, list(tail) AS s FROM h GROUP BY gene, head)"
    " SELECT x.gene, x.head AS a, y.head AS b, CAST(len(list_intersect(x.s, y.s)) AS DOUBLE) / len(list_distinct(list_concat(x.s, y.s))) AS jaccard FROM l x JOIN l y ON x.gene = y.gene AND x.head < y.head")
def j19_perturbation_overlap(spark, sf):
    return evaluate.perturbation_overlap(augmented(spark, sf))


@kg(f", p AS (SELECT DISTINCT head AS gene, tail AS pathway FROM edges WHERE relation = 'participates'), s AS (SELECT 'gene::' || gene AS seed FROM ({SEEDS_SQL})) SELECT a.gene AS seed, b.gene, count(*) AS common FROM p a JOIN s ON a.gene = s.seed JOIN p b ON a.pathway = b.pathway AND a.gene <> b.gene GROUP BY a.gene, b.gene")
def j20_pathway_baseline(spark, sf):
    return evaluate.pathway_baseline(edges(spark, sf), seed_nodes(spark, sf))


@query(f"WITH {BOUGHT}, s AS (SELECT gene AS seed FROM ({SEEDS_SQL})) SELECT a.entity AS seed, b.entity, count(*) AS n, round(corr(b.value, a.value), 6) + 0.0::DOUBLE AS r FROM bought a JOIN s ON a.entity = s.seed JOIN bought b ON a.sample = b.sample AND a.entity <> b.entity GROUP BY a.entity, b.entity HAVING count(*) >= 3 AND r IS NOT NULL AND NOT isnan(r)")
def j22_correlations(spark, sf):
    return rounded(evaluate.correlations(bought(spark, sf), seeds(spark, sf).withColumnRenamed("gene", "seed"), 3), "r")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents), t AS (SELECT doc_id, CAST(quality AS DOUBLE) AS score FROM labels), x AS (SELECT t.score FROM r JOIN t USING (doc_id) WHERE place <= 500)"
       " SELECT count(*) AS hits, round(CASE WHEN count(*) >= 5 THEN count(*) FILTER (score < 0.5) / CAST(count(*) AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN count(*) >= 5 AND (SELECT count(*) FROM t WHERE score < 0.5) > 0 THEN count(*) FILTER (score < 0.5) / CAST((SELECT count(*) FROM t WHERE score < 0.5) AS DOUBLE) ELSE 0 END, 6) AS recall,"
       " round(CASE WHEN count(*) >= 5 THEN avg(score) ELSE 0 END, 6) AS mean FROM x")
def a23_top_k_accuracy(spark, sf):
    """The 500 longest documents as a ranking, against their quality labels; places come from a sorted limit, not a global window."""
    top = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(500).select(F.col("doc_id").alias("entity"), F.lit(1).alias("place"))
    truth = table(spark, sf, "labels").select(F.col("doc_id").alias("entity"), F.col("quality").cast("double").alias("score"))
    return rounded(evaluate.top_k_accuracy(top, truth, 500, 0.5), "precision", "recall", "mean")


def _mean_rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@query(f"WITH r AS (SELECT {_mean_rank('l_quantity')} AS x, {_mean_rank('l_extendedprice')} AS y FROM lineitem) SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM r")
def a25_spearman(spark, sf):
    return rounded(evaluate.spearman(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice"), "rho")


@query(f"WITH r AS (SELECT c_mktsegment = 'BUILDING' AS f, {_mean_rank('c_acctbal')} AS r, count(*) OVER (PARTITION BY c_acctbal) AS c FROM (SELECT c_mktsegment, round(c_acctbal / 100) AS c_acctbal FROM customer)),"
       " s AS (SELECT CAST(count(*) FILTER (f) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT f) AS DOUBLE) AS n2, sum(r) FILTER (f) AS s, sum(CAST(c AS DOUBLE) * c - 1) AS t FROM r),"
       " u AS (SELECT n1, n2, s - n1 * (n1 + 1) / 2 AS u, t, n1 + n2 AS n FROM s)"
       " SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 6) AS u, round((u - n1 * n2 / 2 + 0.5::DOUBLE) / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1)))), 6) AS z FROM u")
def a26_mann_whitney(spark, sf):
    rows = table(spark, sf, "customer").select(F.round(F.col("c_acctbal") / 100).alias("c_acctbal"), "c_mktsegment")
    return rounded(evaluate.mann_whitney(rows, "c_acctbal", F.col("c_mktsegment") == "BUILDING").drop("p"), "u", "z")


@kg(", m AS (SELECT tail AS node, relation, count(*) AS n, round(avg(coalesce(weight, 0.5::DOUBLE)), 6) AS avg_weight FROM edges WHERE head LIKE 'sample::%' AND relation = 'expresses' GROUP BY tail, relation) SELECT * FROM m")
def a11_by_modality(spark, sf):
    return rounded(predict.omics_by_modality(edges(spark, sf), nodes(spark, sf).filter("type = 'gene'").withColumnRenamed("name", "node")), "avg_weight")


@kg(", s AS (SELECT DISTINCT tail AS node, head FROM edges WHERE relation = 'expresses'), k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY head) AS k FROM s) SELECT node, string_agg(head, ',' ORDER BY head) AS samples FROM k WHERE k <= 10 GROUP BY node")
def a12_omics_samples(spark, sf):
    found = predict.omics_samples(edges(spark, sf), nodes(spark, sf).filter("type = 'gene'").withColumnRenamed("name", "node"))
    return found.withColumn("samples", F.array_join("samples", ","))


@kg("SELECT relation, CASE WHEN relation = 'expresses' THEN 'omics' ELSE 'knowledge' END AS kind, count(*) AS edges, count(DISTINCT CASE WHEN tail LIKE 'gene::%' THEN tail WHEN head LIKE 'gene::%' THEN head END) AS genes FROM edges GROUP BY relation")
def a18_modality_coverage(spark, sf):
    return evaluate.modality_coverage(edges(spark, sf))


@kg(f", g AS (SELECT DISTINCT node, CASE WHEN relation = 'expresses' THEN 'omics' ELSE 'knowledge' END AS kind FROM {INCIDENT} WHERE node LIKE 'gene::%') SELECT kind, count(*) AS genes, round(CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT node) FROM g), 6) AS share FROM g GROUP BY kind")
def a18_coverage_by_kind(spark, sf):
    return rounded(evaluate.coverage_by_kind(edges(spark, sf)), "share")


@kg(", e AS (SELECT CASE WHEN relation = 'participates' THEN NULL ELSE weight END AS weight FROM edges) SELECT count(*) AS n, count(*) FILTER (weight IS NULL) AS missing, min(weight) AS least, max(weight) AS most FROM e")
def a19_histogram_summary(spark, sf):
    return evaluate.histogram_summary(edges(spark, sf).withColumn("weight", F.when(F.col("relation") != "participates", F.col("weight"))))


@kg(", e AS (SELECT CASE WHEN relation = 'expresses' THEN NULL WHEN relation = 'activates' THEN 'plain ' || head ELSE '{\"structured\": 1}' END AS v, relation FROM edges) SELECT count(*) AS edges, count(v) AS with_evidence, round(avg(length(v)), 6) AS mean_length, round(count(*) FILTER (v LIKE '{%') / CAST(count(*) AS DOUBLE), 6) AS structured FROM e")
def a20_evidence(spark, sf):
    proof = F.when(F.col("relation") == "expresses", F.lit(None).cast("string")).when(F.col("relation") == "activates", F.concat(F.lit("plain "), "head")).otherwise(F.lit('{"structured": 1}'))
    return rounded(evaluate.evidence_coverage(edges(spark, sf).withColumn("evidence", proof)), "mean_length", "structured")


@query("WITH m AS (SELECT l_partkey, avg(CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END) AS m FROM lineitem GROUP BY l_partkey) SELECT 'P' || (l_partkey % 50) AS entity, round(min(m), 6) AS score FROM m WHERE m IS NOT NULL GROUP BY 1")
def a22_gene_means(spark, sf):
    name = F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string"), F.lit(" ("), F.col("l_partkey").cast("string"), F.lit(")"))
    long = table(spark, sf, "lineitem").select(name.alias("entity"), F.col("l_orderkey").alias("sample"), F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("value"))
    return rounded(evaluate.gene_means(long), "score")


@query(f"WITH {BOUGHT}, s AS (SELECT gene AS seed FROM ({SEEDS_SQL})), y AS (SELECT b.* FROM bought b JOIN s ON b.entity = s.seed),"
       " p AS (SELECT y.entity AS seed, x.entity, sum(x.value * y.value) AS sxy, count(*) AS both FROM bought x JOIN y ON x.sample = y.sample AND x.entity <> y.entity GROUP BY 1, 2),"
       " o AS (SELECT entity, count(*) AS n, sum(value) AS a, sum(value * value) AS aa FROM bought GROUP BY entity),"
       " j AS (SELECT p.seed, p.entity, x.n + y.n - p.both AS n, p.sxy, x.a AS ax, x.aa AS axx, y.a AS ay, y.aa AS ayy FROM p JOIN o x ON x.entity = p.entity JOIN o y ON y.entity = p.seed)"
       " SELECT seed, entity, n, round((sxy - ax * ay / n) / sqrt((axx - ax * ax / n) * (ayy - ay * ay / n)), 6) + 0.0::DOUBLE AS r FROM j WHERE n >= 5")
def a24_zero_filled(spark, sf):
    return rounded(evaluate.correlations(bought(spark, sf), seeds(spark, sf).withColumnRenamed("gene", "seed"), 5, zero_fill=True), "r")


@kg(", e AS (SELECT substr(tail, 7) AS entity, substr(head, 9) AS sample, weight, row_number() OVER (PARTITION BY head, tail ORDER BY source DESC, weight DESC, confidence DESC) AS k FROM edges WHERE relation = 'expresses') SELECT entity, sample, weight AS value FROM e WHERE k = 1")
def a29_expression(spark, sf):
    return evaluate.expression_from_edges(edges(spark, sf))


@query("WITH r AS (SELECT source AS method, lang AS seed, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS place FROM documents), t AS (SELECT doc_id, CAST(quality AS DOUBLE) AS score FROM labels),"
       " x AS (SELECT method, seed, score FROM r JOIN t USING (doc_id) WHERE place <= 20), g AS (SELECT count(*) FILTER (score < 0.5) AS n FROM t)"
       " SELECT method, seed, count(*) AS hits, round(CASE WHEN count(*) >= 5 THEN count(*) FILTER (score < 0.5) / CAST(count(*) AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN count(*) >= 5 AND any_value(n) > 0 THEN count(*) FILTER (score < 0.5) / CAST(any_value(n) AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN count(*) >= 5 THEN avg(score) ELSE 0 END, 6) AS mean FROM x, g GROUP BY method, seed")
def e08_accuracy(spark, sf):
    place = F.row_number().over(Window.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = table(spark, sf, "documents").select(F.col("source").alias("method"), F.col("lang").alias("seed"), F.col("doc_id").alias("entity"), place.alias("place"))
    truth = table(spark, sf, "labels").select(F.col("doc_id").alias("entity"), F.col("quality").cast("double").alias("score"))
    return rounded(evaluate.prediction_accuracy(ranked, truth, 20, 0.5), "precision", "recall", "mean")


BRIDGES = "bridges AS (SELECT 'protein::S' || s_suppkey AS head, 'protein::S' || min(s_suppkey) OVER (PARTITION BY s_nationkey) AS tail FROM supplier)"


@kg(f", {BRIDGES}, h AS (SELECT head AS gene, tail AS p, count(*) AS n FROM edges WHERE head LIKE 'gene::%' AND tail LIKE 'protein::%' GROUP BY ALL), b AS (SELECT p, q, count(*) AS m FROM (SELECT head AS p, tail AS q FROM bridges UNION ALL SELECT tail, head FROM bridges WHERE head <> tail) GROUP BY ALL),"
    " t AS (SELECT p AS q, sum(n) AS t FROM h GROUP BY p), w AS (SELECT gene, q, sum(n * m) AS w FROM h JOIN b USING (p) GROUP BY gene, q)"
    " SELECT w.gene AS origin, CAST(sum(w * (t - coalesce(h.n, 0))) AS BIGINT) AS paths FROM w JOIN t USING (q) LEFT JOIN h ON h.gene = w.gene AND h.p = w.q GROUP BY w.gene")
def j15_three_hop_paths(spark, sf):
    """Suppliers of a nation are bridged through its first one, which is bridged to itself."""
    first = F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))
    bridges = table(spark, sf, "supplier").select(F.concat(F.lit("protein::S"), F.col("s_suppkey").cast("string")).alias("head"), F.concat(F.lit("protein::S"), first.cast("string")).alias("tail"))
    every = edges(spark, sf).select("head", "tail").unionByName(bridges)
    return evaluate.three_hop_paths(every, nodes(spark, sf).filter("type = 'gene'"))


@kg("SELECT 'relations' AS \"check\", count(*) FILTER (relation NOT IN (" + ", ".join(f"'{r}'" for r in rules.RELATIONS) + ")) AS problems FROM edges"
    " UNION ALL SELECT 'properties', count(*) FILTER (trim(coalesce(source, '')) = '') + count(*) FILTER (trim(coalesce(version, '')) = '') FROM edges"
    f" UNION ALL SELECT 'seeds', (SELECT count(*) FROM (SELECT gene FROM ({SEEDS_SQL}) EXCEPT SELECT substr(name, 7) FROM nodes WHERE is_seed)) + (SELECT count(*) FROM (SELECT substr(name, 7) FROM nodes WHERE is_seed EXCEPT SELECT gene FROM ({SEEDS_SQL})))"
    " UNION ALL SELECT 'names', count(*) - count(DISTINCT name) FROM nodes")
def v06_validate(spark, sf):
    return evaluate.validate(edges(spark, sf), nodes(spark, sf), seeds(spark, sf), ("source", "version"))


# --- text

def _tfidf_sql(table_: str, id_: str) -> str:
    return (rf"tf AS (SELECT {id_}, term, count(*) AS tf FROM (SELECT {id_}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {table_}) GROUP BY {id_}, term),"
            f" idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM {table_})) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM tf GROUP BY term),"
            f" raw AS (SELECT {id_}, term, tf * idf AS raw FROM tf JOIN idf USING (term)), w AS (SELECT {id_}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {id_})) AS weight FROM raw)")


@query(f"WITH {_tfidf_sql('documents', 'doc_id')} SELECT doc_id, term, round(weight, 6) AS weight FROM w")
def t01_tfidf(spark, sf):
    return rounded(retrieval.tfidf(table(spark, sf, "documents")), "weight")


@query(rf"WITH {_tfidf_sql('documents', 'doc_id')}, qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM benchmark) GROUP BY item_id, term),"
       " qr AS (SELECT item_id, term, tf * idf AS raw FROM qt JOIN idf USING (term)), q AS (SELECT item_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)) AS q FROM qr),"
       " s AS (SELECT item_id, doc_id, round(sum(weight * q), 9) AS similarity FROM w JOIN q USING (term) GROUP BY item_id, doc_id), f AS (SELECT item_id, doc_id, similarity FROM s UNION ALL SELECT item_id, doc_id, 0.0 FROM benchmark, documents WHERE (item_id, doc_id) NOT IN (SELECT item_id, doc_id FROM s))"
       " SELECT item_id, doc_id, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id DESC) AS INTEGER) AS place FROM f QUALIFY place <= 5")
def t02_search(spark, sf):
    return rounded(retrieval.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 5, query_id="item_id", query_col="text"), "similarity")


QUESTION = "Which report from the river station names the water level?"


@query(r"WITH q AS (SELECT list_distinct(list_transform(regexp_extract_all('" + QUESTION + r"', '[A-Za-z0-9_]{2,}'), lambda x: lower(x))) AS t),"
       r" p AS (SELECT DISTINCT doc_id, sentence FROM (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(coalesce(text, ''), '[。！？!?\n\r]+')), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS sentence FROM documents) WHERE sentence <> ''),"
       " s AS (SELECT doc_id, sentence, CAST(len([x FOR x IN t IF contains(lower(sentence), x)]) AS INTEGER) AS score FROM p, q)"
       " SELECT doc_id, sentence, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(sentence), sentence) AS INTEGER) AS place FROM s WHERE score > 0 QUALIFY place <= 2")
def t04_best_sentences(spark, sf):
    return retrieval.best_sentences(table(spark, sf, "documents"), QUESTION)


#: The oracle has no look-arounds: what bounds a gene is matched instead, doubled so that two genes never want the same one.
QUESTIONS = r"""
WITH q AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
c AS (SELECT *, regexp_extract(t, '(?:^|[^A-Za-z0-9_])([A-Za-z]+[0-9]{2,}|cell[A-Za-z0-9_-]+)(?:$|[^A-Za-z0-9_])', 1) AS cell,
  regexp_extract_all(regexp_replace(t, '([^A-Za-z0-9_])', '\1\1', 'g'), '(?:^|[^A-Za-z0-9_])([A-Z]{2,}[A-Z0-9]{0,8})(?:$|[^A-Za-z0-9_])', 1) AS genes FROM q),
g AS (SELECT *, coalesce(list_filter(genes, lambda x: cell = '' OR upper(x) <> upper(cell))[1], '') AS gene FROM c)
SELECT conv_id, turn, CASE WHEN gene = '' THEN '' ELSE cell END AS cell,
  CASE WHEN gene = '' THEN '' WHEN contains(lower(t), '抑制') OR contains(lower(t), '敲除') OR contains(lower(t), 'ko') OR contains(lower(t), 'inhibit') OR contains(lower(t), 'knockout') OR contains(lower(t), 'kd') THEN 'KO_' || gene
       WHEN contains(lower(t), '过表达') OR contains(lower(t), '激活') OR contains(lower(t), 'oe') OR contains(lower(t), 'activate') OR contains(lower(t), 'overexpression') THEN 'OE_' || gene ELSE 'Perturb_' || gene END AS perturbation,
  CAST(len(list_distinct(list_transform(regexp_extract_all(t, '[A-Za-z0-9_]{2,}|[\x{4e00}-\x{9fff}]{2,}'), lambda x: lower(x)))) AS INTEGER) AS tokens FROM g
"""


@query(QUESTIONS)
def p24_questions(spark, sf):
    """Every turn as a question."""
    asked = table(spark, sf, "conversations").select("conv_id", "turn", tx.parse_question(F.col("text")).alias("q"), tx.question_tokens(F.col("text")).alias("t"))
    return asked.select("conv_id", "turn", "q.cell", "q.perturbation", F.size("t").alias("tokens"))


@query("WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), s AS (SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS i FROM supplier),"
       " arc AS (SELECT DISTINCT i AS a, (2 * i + k) % n AS b FROM s, n, (SELECT unnest([0, 1]) AS k) WHERE i <> (2 * i + k) % n),"
       " walk(o, v, d) AS (SELECT i, i, 0 FROM s UNION SELECT o, b, d + 1 FROM walk JOIN arc ON a = v WHERE d < 14), best AS (SELECT o, v, min(d) AS d FROM walk GROUP BY o, v)"
       " SELECT round(sum(d) / CAST(count(*) FILTER (o <> v) AS DOUBLE), 6) AS average, CAST(max(d) AS INTEGER) AS diameter FROM best")
def g12_path_lengths(spark, sf):
    """Suppliers in order of their keys, each linked to those at twice its place and one on: a strongly connected graph full of cycles."""
    keys = table(spark, sf, "supplier").select("s_suppkey")
    n = keys.count()
    places = graph.in_order(keys, "s_suppkey").withColumn("i", F.col("i") - 1)
    ends = F.array(*(((2 * F.col("i") + k) % n).cast("string") for k in (0, 1)))
    arcs = places.select(F.col("i").cast("string").alias("head"), F.explode(ends).alias("tail"))
    return rounded(graph.shortest_paths(arcs, max_nodes=None), "average")


# the dense table: every gene of every sample, 0 where it bought none
@query(f"WITH {BOUGHT}, g AS (SELECT DISTINCT entity FROM bought), s AS (SELECT DISTINCT sample FROM bought), d AS (SELECT entity, sample, coalesce(value, 0.0::DOUBLE) AS value FROM g CROSS JOIN s LEFT JOIN bought USING (entity, sample))"
       " SELECT sample, entity, round(value, 6) AS value, CAST(row_number() OVER (PARTITION BY sample ORDER BY value DESC, entity) AS INTEGER) AS place FROM d QUALIFY place <= 60")
def w02_sparse_top(spark, sf):
    """The 60 first genes of each sample out of its stored cells, zeros filled in where it has fewer."""
    stored = graph.cut(bought(spark, sf))
    label = lambda c: stored.select(F.col(c).alias("label")).distinct()
    return rounded(build.top_of_sparse(stored, label("entity"), label("sample"), 60).select("sample", "entity", "value", "place"), "value")


@query(f"WITH {BOUGHT}, top AS (SELECT * FROM bought QUALIFY row_number() OVER (PARTITION BY sample ORDER BY value DESC, entity) <= 30)"
       " SELECT 'sample::' || sample AS head, 'expresses' AS relation, 'gene::' || upper(entity) AS tail, round(least(1.0::DOUBLE, value), 6) AS weight FROM top WHERE value >= 0.1"
       " UNION ALL SELECT 'sample::' || sample, 'has_cnv', 'gene::' || upper(entity), round(least(1.0::DOUBLE, value), 6) FROM bought WHERE value >= 0.5")
def m01_omics_chunks(spark, sf):
    """Two modalities in chunks of about 5,000 cells, the input written once and each chunk read from its own folders."""
    spec = spark.createDataFrame([("orders", "expression", "orders", "v1", 30, 0.1, 0.7), ("copies", "cnv", "orders", "v1", 0, 0.5, 0.7)], "name string, modality string, source string, version string, top_k int, min_value double, confidence double")
    long = bought(spark, sf).select(F.explode(F.array(F.lit("orders"), F.lit("copies"))).alias("name"), "entity", "sample", "value")
    out = None
    for part in files.omics_chunks(long, spec, 5_000):
        out = part if out is None else out.unionByName(part)
    return rounded(out.select("head", "relation", "tail", "weight"), "weight")


# --- predictions for tables of pairs

def prediction_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The graph with its derived perturbation edges, both stored: the edges are made once."""
    own = graph.cut(edges(spark, sf))
    derived = build.augment(own, seeds(spark, sf)).select("head", "relation", "tail", F.lit("Derived").alias("source"), F.lit("v1").alias("version"), "weight", "confidence", F.lit(0.0).alias("effect_sign"))
    return own.unionByName(graph.cut(derived))


def asked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(cell, perturbation): each user's turn asks of its conversation's sample what one of the seeds does."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    numbered = seeds(spark, sf).distinct().agg(F.array_sort(F.collect_list("gene")).alias("genes"))  # the seeds of one brand
    gene = F.element_at("genes", (F.pmod(F.col("conv_id") + F.col("turn"), F.size("genes")) + 1).cast("int"))
    method = F.when(F.col("conv_id") % 3 == 0, F.lit("OE_")).otherwise(F.lit("KO_"))
    return turns.crossJoin(F.broadcast(numbered)).filter(F.size("genes") > 0).select(F.concat(F.lit("sample::C"), F.col("conv_id").cast("string")).alias("cell"), F.concat(method, gene).alias("perturbation")).distinct()


ASKED = ("SELECT DISTINCT 'sample::C' || conv_id AS cell, (CASE WHEN conv_id % 3 = 0 THEN 'OE_' ELSE 'KO_' END) || g AS perturbation FROM conversations"
         " JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS n FROM seed) ON k = (conv_id + turn) % n WHERE role = 'user'")


def _prediction_sql(asked: str, k: int, floor: float = graph.MIN_SCORE, targets: str | None = None) -> str:
    """CTEs q_genes, q_paths and q_prots: the whole prediction for the pairs of ``asked`` (cell, perturbation), for the genes of
    ``targets`` alone if it is given. On these
    tables every pair with a gene has a pathway, labels are names, and the last fallback has no row; it isn't here."""
    key = "cell, perturbation"
    first = "ORDER BY score DESC, hops, node"

    def hop(h: int, source: str) -> str:
        return (f", w{h} AS (SELECT s.origin, l.tail AS node, s.signal * l.s AS signal, s.direction * l.d AS direction FROM {source} s JOIN lean l ON s.node = l.head)"
                f", h{h} AS (SELECT origin, node, signal, direction, {h} AS hops FROM w{h} QUALIFY row_number() OVER (PARTITION BY origin, node ORDER BY signal DESC, direction DESC) = 1)")

    def links(own: str, other: str, limit: int) -> str:
        near = "(SELECT head AS node, tail AS other, weight, confidence FROM net UNION ALL SELECT tail, head, weight, confidence FROM net)"
        return (f"(SELECT node, other, signal FROM (SELECT node, other, max({SIGNAL}) AS signal FROM {near} WHERE node LIKE '{own}::%' AND other LIKE '{other}::%' AND NOT regexp_matches(other, '^pathway::(perturbation|perturb_method)::') AND {SIGNAL} >= {max(0.005, floor / 2) if own == 'gene' else floor / 2} GROUP BY node, other)"
                f" QUALIFY row_number() OVER (PARTITION BY node ORDER BY signal DESC, other) <= {limit})")

    bio = "node LIKE 'pathway::%' AND NOT regexp_matches(node, '^pathway::(perturbation|perturb_method)::')"
    columns = f"{key}, node, hops, raw_signal, score, direction_sign, from_perturbation"
    delta = lambda scale: f"round((CASE WHEN regexp_matches(lower(perturbation), 'ko|inhibit|kd') THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * direction_sign * score * {scale}::DOUBLE, 4) + 0.0::DOUBLE"
    return (
        f"{AUGMENTED}, net AS (SELECT head, relation, tail, weight, confidence, effect_sign FROM edges UNION ALL SELECT head, relation, tail, weight, confidence, 0.0::DOUBLE FROM aug)"
        f", asked AS (SELECT cell, perturbation, 'pathway::perturbation::' || upper(perturbation) AS anchor FROM ({asked}))"
        f", lean AS (SELECT head, tail, {SIGNAL} AS s, {SIGN} AS d FROM net QUALIFY row_number() OVER (PARTITION BY head, tail ORDER BY s DESC, d DESC) = 1)"
        ", h0 AS (SELECT o AS origin, o AS node, 1.0::DOUBLE AS signal, 1.0::DOUBLE AS direction FROM (SELECT cell AS o FROM asked UNION SELECT anchor FROM asked))"
        + hop(1, "h0") + hop(2, "h1") + hop(3, "h2")
        + ", scored AS (SELECT *, (CASE WHEN node LIKE 'pathway::%' THEN signal * pow(0.78::DOUBLE, hops - 1) * 1.12::DOUBLE ELSE signal * pow(0.78::DOUBLE, hops - 1) END) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) WHERE regexp_matches(node, '^(gene|pathway|protein)::') AND node <> origin)"
        ", walks AS (SELECT origin, node, hops, signal AS raw_signal, score, direction AS direction_sign FROM scored QUALIFY row_number() OVER (PARTITION BY origin, node ORDER BY score DESC, hops, signal DESC, direction DESC) = 1)"
        ", q_near AS (SELECT origin, node, hops, signal AS raw_signal, score, direction AS direction_sign FROM scored WHERE hops = 1)"
        f", q_both AS (SELECT {key}, node, hops, raw_signal, score, direction_sign, false AS from_perturbation FROM asked JOIN walks ON origin = cell WHERE score >= {floor}"
        f" UNION ALL SELECT {key}, node, hops, raw_signal, score * (CASE WHEN hops <= 1 THEN 1.6::DOUBLE ELSE 1.35::DOUBLE END), direction_sign, true FROM asked JOIN walks ON origin = anchor WHERE score >= {0.6 * floor})"
        f", q_merged AS (SELECT * FROM q_both QUALIFY row_number() OVER (PARTITION BY {key}, node ORDER BY score DESC, from_perturbation, hops) = 1)"
        f", q_ranked AS (SELECT {columns} FROM q_merged UNION ALL SELECT {key}, node, hops, raw_signal, greatest(score, raw_signal, 0.005::DOUBLE), direction_sign, true FROM asked JOIN q_near ON origin = anchor WHERE ({key}) NOT IN (SELECT {key} FROM q_merged))"
        f", q_gene0 AS (SELECT * FROM q_ranked WHERE node LIKE 'gene::%'), q_path0 AS (SELECT *, CAST(NULL AS VARCHAR) AS from_gene FROM q_ranked WHERE {bio})"
        f", q_path1 AS (SELECT * FROM q_path0 UNION ALL (SELECT {key}, other, hops + 1, signal, round(score * signal * 0.95::DOUBLE, 6) AS s, direction_sign, from_perturbation, t.node AS from_gene"
        f" FROM (SELECT * FROM q_gene0 WHERE ({key}) NOT IN (SELECT {key} FROM q_path0) QUALIFY row_number() OVER (PARTITION BY {key} {first}) <= {min(12, max(4, k))}) t JOIN {links('gene', 'pathway', 20)} l ON l.node = t.node"
        f" QUALIFY row_number() OVER (PARTITION BY {key}, other ORDER BY s DESC, hops, t.node DESC) = 1))"
        f", q_mark AS (SELECT *, ({key}, node) IN (SELECT {key}, node FROM asked JOIN q_near ON origin = anchor) AS direct FROM q_gene0)"
        f", q_lift AS (SELECT {key}, node, hops, raw_signal, (CASE WHEN direct THEN score * 1.35::DOUBLE ELSE score END) AS score, direction_sign, from_perturbation OR direct AS from_perturbation FROM q_mark QUALIFY direct OR sum(direct::INT) OVER (PARTITION BY {key}) < {max(8, k)})"
        f", q_gene1 AS (SELECT * FROM q_lift{f' WHERE node IN ({targets})' if targets else ''})"
        ", q_seen AS (SELECT tail AS node, count(*) AS n FROM net WHERE head LIKE 'sample::%' AND relation = 'expresses' GROUP BY tail)"
        f", q_boost AS (SELECT {key}, node, least(1.0::DOUBLE, 0.4::DOUBLE * (n / CAST(max(n) OVER (PARTITION BY {key}) AS DOUBLE))) AS boost FROM q_gene1 JOIN q_seen USING (node))"
        f", q_fallen AS (SELECT g.* REPLACE (score * (1 + 0.35::DOUBLE * coalesce(boost, 0.0::DOUBLE)) AS score) FROM q_gene1 g LEFT JOIN q_boost b USING (cell, perturbation, node))"
        f", q_poor AS (SELECT * FROM q_path1 WHERE ({key}) NOT IN (SELECT {key} FROM q_fallen GROUP BY {key} HAVING count(*) >= {max(k, min(25, 2 * k))}){' AND false' if targets else ''} QUALIFY row_number() OVER (PARTITION BY {key} {first}) <= {max(3, k)})"
        f", q_more AS (SELECT {key}, other AS node, hops + 1 AS hops, signal AS raw_signal, round(score * signal * 0.9::DOUBLE, 6) AS score, direction_sign, from_perturbation FROM q_poor t JOIN {links('pathway', 'gene', 40)} l ON l.node = t.node"
        f" QUALIFY row_number() OVER (PARTITION BY {key}, other ORDER BY round(t.score * signal * 0.9::DOUBLE, 6) DESC, t.hops, t.node DESC) = 1)"
        f", q_gene2 AS (SELECT * FROM q_fallen UNION ALL SELECT * FROM q_more WHERE ({key}, node) NOT IN (SELECT {key}, node FROM q_gene1))"
        f", q_order AS (SELECT *, node IN (SELECT seed FROM seed) AS is_seed, row_number() OVER (PARTITION BY {key} {first}) AS r FROM q_gene2)"
        f", q_kind AS (SELECT *, NOT is_seed AND row_number() OVER (PARTITION BY {key}, is_seed ORDER BY r) <= {max(1, k // 3)} AND {k} >= 4 AS reserved FROM q_order)"
        f", q_genes AS (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY reserved DESC, r) AS INTEGER) AS place, {delta(0.2)} AS delta FROM q_kind QUALIFY place <= {k})"
        f", q_paths AS (SELECT *, CAST(row_number() OVER (PARTITION BY {key} {first}) AS INTEGER) AS place FROM q_path1 QUALIFY place <= {k})"
        f", q_prots AS (SELECT *, CAST(row_number() OVER (PARTITION BY {key} {first}) AS INTEGER) AS place, {delta(0.15)} AS delta FROM q_ranked WHERE node LIKE 'protein::%' QUALIFY place <= {k})")


EFFECT = "CASE WHEN delta > 0 THEN '增强' WHEN delta < 0 THEN '抑制' ELSE '不确定' END"
SHOWN = "cell, perturbation, node, hops, round(score, 6) AS score, direction_sign, from_perturbation, place"


@kg(f", {_prediction_sql(ASKED, 10)} SELECT 'gene' AS part, {SHOWN}, delta, {EFFECT} AS effect FROM q_genes UNION ALL SELECT 'pathway', {SHOWN}, NULL, NULL FROM q_paths UNION ALL SELECT 'protein', {SHOWN}, delta, {EFFECT} FROM q_prots")
def r_predictions(spark, sf):
    """Genes, pathways and proteins of every pair that a conversation asks for, all pairs in one plan."""
    made = predict.predict_all(prediction_edges(spark, sf), seeds(spark, sf), asked_pairs(spark, sf))
    place = F.row_number().over(Window.partitionBy("cell", "perturbation").orderBy(F.desc("score"), "hops", "node"))
    none = {"delta": F.lit(None).cast("double"), "effect": F.lit(None).cast("string")}
    parts = {"gene": made.genes, "pathway": made.pathways.withColumns({"place": place} | none), "protein": made.proteins.withColumn("place", place)}
    out = None
    for part, rows in parts.items():
        rows = rows.select(F.lit(part).alias("part"), "cell", "perturbation", "node", "hops", "score", "direction_sign", "from_perturbation", "place", (F.col("delta") + F.lit(0.0)).alias("delta"), "effect")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, "score")


@kg(f", {_prediction_sql(ASKED, 5, targets="SELECT seed FROM seed")} SELECT cell, perturbation, node, hops, round(score, 6) AS score, from_perturbation, place, delta FROM q_genes")
def r09_targets(spark, sf):
    """What the pairs do to the seeds: no other gene counts, and none is filled in where they are few."""
    wanted = [r["gene"].lower() for r in seeds(spark, sf).distinct().collect()]  # the seeds of one brand are the user's list
    made = predict.predict_all(prediction_edges(spark, sf), seeds(spark, sf), asked_pairs(spark, sf), wanted, top_k=5)
    return rounded(made.genes.select("cell", "perturbation", "node", "hops", "score", "from_perturbation", "place", (F.col("delta") + F.lit(0.0)).alias("delta")), "score")


TRUTH = "t AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS entity, (p_size - 25) / 25.0::DOUBLE AS score FROM part)"
#: Genes by the correlation of their expression with a seed's, zero where a sample has none.
ALIKE = (f"{BOUGHT}, c_y AS (SELECT b.* FROM bought b JOIN (SELECT DISTINCT g FROM seed) ON b.entity = g),"
         " c_p AS (SELECT y.entity AS seed, x.entity, sum(x.value * y.value) AS sxy, count(*) AS both FROM bought x JOIN c_y y ON x.sample = y.sample AND x.entity <> y.entity GROUP BY 1, 2),"
         " c_o AS (SELECT entity, count(*) AS n, sum(value) AS a, sum(value * value) AS aa FROM bought GROUP BY entity),"
         " c_j AS (SELECT p.seed, p.entity, x.n + y.n - p.both AS n, p.sxy, x.a AS ax, x.aa AS axx, y.a AS ay, y.aa AS ayy FROM c_p p JOIN c_o x ON x.entity = p.entity JOIN c_o y ON y.entity = p.seed),"
         " alike AS (SELECT seed, entity, round((sxy - ax * ay / n) / sqrt((axx - ax * ax / n) * (ayy - ay * ay / n)), 6) + 0.0::DOUBLE AS r FROM c_j WHERE n >= 5)")


@kg(f", {_prediction_sql("SELECT 'sample::C10' AS cell, 'KO_' || g AS perturbation FROM seed", 100)}, {TRUTH}, {ALIKE}"
    ", r AS (SELECT 'graph' AS method, substr(perturbation, 4) AS seed, substr(node, 7) AS entity, place FROM q_genes"
    " UNION ALL SELECT 'expression', seed, entity, row_number() OVER (PARTITION BY seed ORDER BY r DESC, entity) FROM alike)"
    ", x AS (SELECT method, seed, score FROM r JOIN t USING (entity) WHERE place <= 100), n AS (SELECT count(*) FILTER (score < -0.5) AS n FROM t)"
    " SELECT method, seed, count(*) AS hits, round(CASE WHEN count(*) >= 5 THEN count(*) FILTER (score < -0.5) / CAST(count(*) AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN count(*) >= 5 AND any_value(n) > 0 THEN count(*) FILTER (score < -0.5) / CAST(any_value(n) AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN count(*) >= 5 THEN avg(score) ELSE 0 END, 6) + 0.0::DOUBLE AS mean FROM x, n GROUP BY method, seed")
def e08_predictions(spark, sf):
    """The predictor over all seeds in one plan, 100 genes each, against the genes whose expression is most like the seed's;
    the truth is the parts' sizes."""
    pairs = seeds(spark, sf).distinct().select(F.lit("sample::C10").alias("cell"), F.concat(F.lit("KO_"), "gene").alias("perturbation"))
    made = predict.predict_all(prediction_edges(spark, sf), seeds(spark, sf), pairs, top_k=100)
    ranked = made.genes.select(F.lit("graph").alias("method"), F.substring("perturbation", 4, 1 << 30).alias("seed"), F.substring("node", 7, 1 << 30).alias("entity"), "place")
    alike = rounded(evaluate.correlations(bought(spark, sf), seeds(spark, sf).withColumnRenamed("gene", "seed"), 5, zero_fill=True), "r")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("r"), "entity"))
    alike = alike.select(F.lit("expression").alias("method"), "seed", "entity", place.alias("place")).filter(F.col("place") <= 100)
    truth = table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity"), ((F.col("p_size") - 25) / F.lit(25.0)).alias("score"))
    made = rounded(evaluate.prediction_accuracy(ranked.unionByName(alike), truth, 100, -0.5), "precision", "recall", "mean")
    return made.withColumn("mean", F.col("mean") + F.lit(0.0))


@kg(f", {_prediction_sql("SELECT 'sample::C10' AS cell, 'KO_' || min(g) AS perturbation FROM seed", 10)} SELECT node, substr(node, 7) AS label, hops, round(score, 6) AS score, delta, {EFFECT} AS effect, place FROM q_genes")
def r_prediction(spark, sf):
    """The genes of one pair."""
    first = seeds(spark, sf).agg(F.min("gene")).first()[0]
    made = predict.predict(prediction_edges(spark, sf), seeds(spark, sf), "sample::C10", f"KO_{first}")
    return rounded(made.genes.select("node", "label", "hops", "score", (F.col("delta") + F.lit(0.0)).alias("delta"), "effect", "place"), "score")


@kg(", arc AS (SELECT DISTINCT head, tail FROM edges), origin AS (SELECT DISTINCT head AS o FROM edges WHERE head LIKE 'sample::%'), one AS (SELECT o, tail FROM origin JOIN arc ON head = o),"
    " seen AS (SELECT o, o AS node FROM origin UNION SELECT o, tail FROM one UNION SELECT o, arc.tail FROM one JOIN arc ON arc.head = one.tail), d AS (SELECT head AS node, count(*) AS n FROM edges GROUP BY head)"
    " SELECT o AS origin, CAST(sum(n) AS BIGINT) AS evidence FROM seen JOIN d USING (node) GROUP BY o")
def r02_evidence(spark, sf):
    """What each sample's prediction could rest on: the edges within three hops."""
    e = edges(spark, sf)
    return graph.evidence_counts(e, e.filter(F.startswith("head", F.lit("sample::"))).select(F.col("head").alias("origin")).distinct())


# --- questions

def spelled(c: str) -> Column:
    """Ids with their genes' numbers in letters: a word that ends in two digits counts as a cell line in a question."""
    number = F.regexp_extract(c, r"(?:^gene::|_|^)P([0-9]+)$", 1)
    return F.when(number == "", F.col(c)).otherwise(F.concat(F.regexp_replace(c, "P[0-9]+$", "GX"), F.translate(number, "0123456789", "ABCDEFGHIJ")))


#: What each turn of a user asks: kind 0 names a cell, kind 3 a gene that the graph doesn't have, which every second time is
#: asked of a cell that it doesn't have either, kind 4 no gene.
TURNS = ("SELECT conv_id * 1000 + turn AS query_id, (conv_id + turn) % 5 AS kind, conv_id, turn, g FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user')"
         " JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS n FROM seed) ON k = (conv_id + turn) % n")
NAMED = "(kind = 0 OR kind = 3 AND conv_id % 2 = 0)"
TRIED = (f"SELECT query_id, {NAMED} AS named, CASE WHEN kind = 3 THEN 'KO_ZZZ' WHEN conv_id % 3 = 0 THEN 'OE_' || g ELSE 'KO_' || g END AS perturbation, unnest(CASE WHEN {NAMED} THEN ['Cell::cell-' || conv_id] ELSE ['sample::C10', 'sample::C11'] END) AS cell,"
         f" unnest(CASE WHEN {NAMED} THEN [1] ELSE [1, 2] END) AS try FROM ({TURNS}) WHERE kind < 4")


@kg(f", {_prediction_sql(f'SELECT DISTINCT cell, perturbation FROM ({TRIED})', predict.ANSWER_ROWS, predict.ANSWER_FLOOR * graph.MIN_SCORE)}, n_all AS ("
    "SELECT cell, perturbation, 1 AS g, 0 AS p, 0 AS r FROM q_genes UNION ALL SELECT cell, perturbation, 0, 1, 0 FROM q_paths UNION ALL SELECT cell, perturbation, 0, 0, 1 FROM q_prots)"
    ", n_pair AS (SELECT cell, perturbation, sum(g) AS genes, sum(p) AS pathways, sum(r) AS proteins FROM n_all GROUP BY ALL)"
    f", told AS (SELECT t.*, genes, pathways, proteins FROM ({TRIED}) t JOIN n_pair USING (cell, perturbation) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY try) = 1)"
    f" SELECT query_id, told.query_id IS NOT NULL AS predicted, cell, CASE WHEN perturbation = 'KO_ZZZ' THEN perturbation ELSE left(perturbation, 3) || 'GX' || translate(substr(perturbation, 5), '0123456789', 'ABCDEFGHIJ') END AS perturbation, told.query_id IS NOT NULL AND NOT named AS assumed,"
    f" CAST(coalesce(genes, 0) AS BIGINT) AS genes, CAST(coalesce(pathways, 0) AS BIGINT) AS pathways, CAST(coalesce(proteins, 0) AS BIGINT) AS proteins FROM ({TURNS}) LEFT JOIN told USING (query_id)")
def t05_answers(spark, sf):
    """Every user's turn asks a question, and all are answered in one plan: predicted in the cell that is named or in the first of
    two in which anything comes out, else by the documents' sentences."""
    named = prediction_edges(spark, sf).withColumns({"head": spelled("head"), "tail": spelled("tail")})
    genes = seeds(spark, sf).select(spelled("gene").alias("gene"))
    numbered = seeds(spark, sf).distinct().agg(F.array_sort(F.collect_list("gene")).alias("genes"))  # the seeds of one brand
    turns = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn").distinct().crossJoin(F.broadcast(numbered)).filter(F.size("genes") > 0)
    turns = turns.withColumn("g", F.element_at("genes", (F.pmod(F.col("conv_id") + F.col("turn"), F.size("genes")) + 1).cast("int"))).withColumn("g", spelled("g"))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    method = F.when(F.col("conv_id") % 3 == 0, F.lit("overexpression of ")).otherwise(F.lit("knockout of "))
    where = F.when((kind == 0) | ((kind == 3) & (F.col("conv_id") % 2 == 0)), F.concat(F.lit("In cell-"), F.col("conv_id").cast("string"), F.lit(", what follows "))).otherwise(F.lit("What follows "))
    ask = F.when(kind == 4, F.lit("Which report names the water level?")).otherwise(F.concat(where, F.when(kind == 3, F.lit("knockout of ZZZ")).otherwise(F.concat(method, "g")), F.lit("?")))
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), ask.alias("question"))
    made = predict.answer_all(graph.cut(named), genes, table(spark, sf, "documents"), asked, ("sample::C10", "sample::C11")).answers
    return made.select("query_id", (F.col("kind") == "prediction").alias("predicted"), "cell", "perturbation", "assumed", "genes", "pathways", "proteins")
