"""Queries of manifests, catalogs, loads and reports, each held against SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import build, evaluate, graph, predict
from ..sources import bootstrap, catalog, files, sinks
from .formats import csv, line, on, raw_edges, text, tsv
from .queries import INCIDENT, ORDER, kg, query, rounded
from .views import EDGES_SQL, SEEDS_SQL, edges, nodes, seeds, table

# --- manifests and catalogs

OLD = "SELECT p_partkey AS n, 'D' || (p_partkey % 150) AS name, p_brand AS source, CASE WHEN p_size % 11 = 0 THEN 'failed' WHEN p_size % 3 = 0 THEN NULL ELSE 'ok' END AS status FROM part"
NEW = "SELECT s_suppkey AS n, 'D' || (s_suppkey * 7) AS name, 'new ' || s_nationkey AS source, CASE WHEN s_suppkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM supplier"


@query(f"WITH old AS ({OLD}), new AS ({NEW}), every AS (SELECT 0 AS late, * FROM old UNION ALL SELECT 1, * FROM new),"
       " kept AS (SELECT name, min(late * 1000000000000 + n) AS first, arg_max(source, late * 1000000000000 + n) AS source, max(late * 1000000000000 + n) AS last FROM every GROUP BY name),"
       " good AS (SELECT k.name, k.first, k.source FROM kept k JOIN every e ON e.name = k.name AND e.late * 1000000000000 + e.n = k.last WHERE coalesce(e.status, 'ok') = 'ok')"
       " SELECT name, source, row_number() OVER (ORDER BY first) AS place FROM good")
def k10_manifest(spark, sf):
    """A manifest of the parts, most names several times, updated by one of the suppliers, the failed entries left out, written
    as one document and read again in its order."""
    status = F.when(F.col("p_size") % 11 == 0, F.lit("failed")).when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.lit("ok"))
    old = table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.concat(F.lit("D"), (F.col("p_partkey") % 150).cast("string")).alias("name"), F.col("p_brand").alias("source"), status.alias("status"))
    fresh = F.when(F.col("s_suppkey") % 5 == 0, F.lit("failed")).otherwise(F.lit("ok"))
    new = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("n"), F.concat(F.lit("D"), (F.col("s_suppkey") * 7).cast("string")).alias("name"), F.concat(F.lit("new "), F.col("s_nationkey").cast("string")).alias("source"), fresh.alias("status"))
    path = graph.scratch(spark, "manifest")
    catalog.write(catalog.prune(catalog.upsert(old, new)), path)
    return catalog.read(spark, path).select("name", "source", (F.col("n") + 1).alias("place"))


@query("WITH c AS (SELECT 'P' || p_partkey AS name, CASE WHEN p_size % 4 <> 0 THEN 'v' || (p_size % 3) END AS version, p_brand AS source FROM part),"
       " m AS (SELECT 'P' || l_partkey AS name, CASE WHEN l_linenumber % 4 <> 0 THEN 'v' || (l_linenumber % 3) END AS version FROM lineitem WHERE l_returnflag <> 'R')"
       " SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.name = c.name AND m.version IS NOT DISTINCT FROM c.version)")
def s40_wanted(spark, sf):
    """Which versions of the parts no line has brought."""
    version = lambda c: F.when(F.col(c) % 4 != 0, F.concat(F.lit("v"), (F.col(c) % 3).cast("string"))).alias("version")
    listed = table(spark, sf, "part").select(on("P", "p_partkey").alias("name"), version("p_size"), F.col("p_brand").alias("source"))
    status = F.when(F.col("l_returnflag") == "R", F.lit("failed")).otherwise(F.lit("ok"))
    return catalog.wanted(listed, line(spark, sf).select(on("P", "l_partkey").alias("name"), version("l_linenumber"), status.alias("status")))


@query(f"SELECT DISTINCT 'kegg_' || gene AS name, '/link/' || gene || '.txt' AS path, gene AS query_gene, r_name AS source FROM ({SEEDS_SQL}), region")
def s40_per_gene(spark, sf):
    template = table(spark, sf, "region").select(F.lit("kegg_{gene}").alias("name"), F.lit("/link/{gene}.txt").alias("path"), F.col("r_name").alias("source"))
    return catalog.per_gene(template, seeds(spark, sf)).select("name", "path", "query_gene", "source")


@query("WITH f AS (SELECT 'N' || c_nationkey AS base, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY c_nationkey)"
       " SELECT n_name AS name, CASE WHEN f.base IS NULL OR n_nationkey % 6 = 5 THEN 'missing' WHEN n_nationkey % 4 = 1 THEN 'damaged' ELSE 'ok' END AS status, CASE WHEN n_nationkey % 6 <> 5 THEN CAST(strlen(body) AS BIGINT) END AS bytes FROM nation LEFT JOIN f ON f.base = 'N' || n_nationkey")
def s38_arrived(spark, sf):
    """The customers' names, a file a nation, against the checksums that a catalog expects: some files lie elsewhere, some are
    expected to be others."""
    path = graph.scratch(spark, "arrived")
    who = table(spark, sf, "customer").select(on("N", "c_nationkey").alias("nation"), "c_custkey", "c_name")
    who.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", F.col("c_name").alias("value")).write.partitionBy("nation").text(path)
    known = files.sha256(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", r"nation=(\w+)", 1).alias("nation"), F.col("path").alias("at"), F.col("sha256").alias("expected"))
    nation = table(spark, sf, "nation").withColumn("nation", on("N", "n_nationkey")).join(known, "nation", "left")
    key = F.col("n_nationkey")
    entries = nation.select(F.col("n_name").alias("name"), F.when(key % 6 == 5, F.lit("elsewhere")).otherwise(F.coalesce("at", F.lit("none"))).alias("path"), F.when(key % 4 == 1, F.lit("0")).when(key % 4 == 2, F.upper("expected")).when(key % 4 == 3, F.lit(None)).otherwise(F.col("expected")).alias("sha256"))
    return catalog.arrived(entries, f"{path}/*/*.txt").select("name", "status", "bytes")


# Fixed values of the links' file: scores as STRING writes them.
SCORE = "CAST(l_quantity * 21 AS INTEGER)"


@query(f"WITH links AS (SELECT DISTINCT ON (l_partkey, l_suppkey) l_partkey, l_suppkey FROM lineitem WHERE {SCORE} >= 800 AND l_linenumber <= 3), grid AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <> 4)"
       " SELECT 'string_ppi' AS source, 'protein_interacts_with' AS relation, count(*) AS n, count(DISTINCT l_partkey) AS heads FROM links HAVING count(*) > 0 UNION ALL SELECT 'grid', 'biogrid_interacts_with', count(*), count(DISTINCT l_partkey) FROM grid HAVING count(*) > 0")
def s26_manifest_sources(spark, sf):
    """A manifest of two sources that can be read, one of them listed twice, beside one without its file, one that has failed and
    one that no parser knows."""
    some = line(spark, sf).filter("l_linenumber <= 3")
    links = text(some, on("9606.ENSP", "l_partkey"), on("9606.ENSP", "l_suppkey"), (F.col("l_quantity") * 21).cast("int"), sep="  ")
    grid = tsv(line(spark, sf), **{
        "Official Symbol Interactor A": on("a", "l_partkey"), "Official Symbol Interactor B": on("b", "l_suppkey"), "Systematic Name Interactor B": F.lit("-"),
        "Organism ID Interactor A": F.when(F.col("l_linenumber") == 4, "10090").otherwise("9606"), "Organism ID Interactor B": F.lit("9606"), "Experimental System": F.lit("Two-hybrid")})
    entries = [{"name": "string_ppi", "status": "ok", "path": links}, {"name": "again", "parser": "string_ppi", "source": "string_ppi", "status": "ok", "path": links},
               {"name": "biogrid_4", "source": "grid", "status": "ok", "path": grid}, {"name": "signor", "status": "ok", "path": f"{grid}-absent"},
               {"name": "npinter", "status": "failed", "path": grid}, {"name": "nobody", "status": "ok", "path": grid}]
    return files.manifest_triples(spark, entries, min_score=800).groupBy("source", "relation").agg(F.count("*").alias("n"), F.count_distinct("head").alias("heads"))


@query("SELECT 'set ' || replace(p_brand, '#', '') AS name, CASE WHEN count(*) % 2 = 0 THEN 'cnv' ELSE 'expression' END AS modality, CASE WHEN min(p_size) % 2 = 0 THEN 'own' ELSE 'set ' || replace(p_brand, '#', '') END AS source, 'v1' AS version, 'csv' AS matrix_format, ',' AS delimiter, 'sample_id' AS sample_id_column,"
       " CAST(CASE WHEN max(p_size) % 3 = 0 THEN max(p_size) ELSE 0 END AS INTEGER) AS top_k, CASE WHEN count(*) % 5 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS min_value, 0.7::DOUBLE AS confidence FROM part GROUP BY p_brand")
def s23_omics_manifest(spark, sf):
    """A data set a brand; fields are there or not by the brand's parts."""
    brand = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))
    spec = brand.select(
        F.concat(F.lit("set "), F.translate("p_brand", "#", "")).alias("name"), F.when(F.col("n") % 2 == 0, F.lit("cnv")).otherwise(F.lit("expression")).alias("modality"), F.when(F.col("least") % 2 == 0, F.lit("own")).alias("source"),
        F.when(F.col("most") % 3 == 0, F.col("most")).alias("top_k"), F.when(F.col("n") % 5 == 0, F.lit(0.25)).alias("min_value"))
    path = graph.scratch(spark, "specs")
    spec.agg(F.to_json(F.struct(F.collect_list(F.struct(*spec.columns)).alias("datasets"))).alias("value")).write.text(path)  # a row a data set
    return files.omics_manifest(spark, path).select("name", "modality", "source", "version", "matrix_format", "delimiter", "sample_id_column", "top_k", "min_value", "confidence")


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS i, 'P' || p_partkey AS label FROM part WHERE p_size % 9 <> 0")
def s20_labels(spark, sf):
    """A label file with a second field and blank lines; file order counts, so the file is one."""
    path = graph.scratch(spark, "labels")
    rows = table(spark, sf, "part").coalesce(1).sortWithinPartitions("p_partkey")
    rows.select(F.when(F.col("p_size") % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), on("P", "p_partkey"), F.lit("\t"), "p_type"))).write.text(path)
    return files.labels(spark, path)


@query(r"SELECT DISTINCT 'hsa:' || p_partkey AS id FROM part WHERE p_size % 5 <> 0 AND regexp_matches(CASE p_size % 3 WHEN 0 THEN lower(p_type) || '; kinase' WHEN 1 THEN 'X' || p_type ELSE 'akt1,' || p_type || '-like' END, '(?i)(^|[^A-Za-z0-9])promo([^A-Za-z0-9]|$)')")
def s41_kegg_ids(spark, sf):
    """Genes, each listed twice, whose description has the symbol as a word of its own."""
    kind = F.col("p_size") % 3
    told = F.when(kind == 0, F.concat(F.lower("p_type"), F.lit("; kinase"))).when(kind == 1, F.concat(F.lit("X"), "p_type")).otherwise(F.concat(F.lit("akt1,"), "p_type", F.lit("-like")))
    lines = table(spark, sf, "part").select(F.concat(F.when(F.col("p_size") % 5 == 0, F.lit("mmu:")).otherwise(F.lit("hsa:")), F.col("p_partkey").cast("string"), F.lit("\t"), told).alias("value"))
    return files.kegg_ids(lines.unionByName(lines), "Promo")


@query("SELECT text AS content, CAST(doc_id AS VARCHAR) AS id, coalesce(lang, '') AS lang FROM documents WHERE text IS NOT NULL")
def k08_document_store(spark, sf):
    """The documents written as a store of content and metadata, and read again."""
    path = graph.scratch(spark, "store")
    sinks.documents_json(table(spark, sf, "documents").filter("text is not null").select(F.col("text").alias("content"), F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("lang"), F.coalesce("lang", F.lit(""))).alias("metadata")), path)
    return spark.read.schema("content string, metadata map<string,string>").json(path).select("content", F.col("metadata")["id"].alias("id"), F.col("metadata")["lang"].alias("lang"))


@query("SELECT c_name AS name, lower(c_mktsegment) AS modality, c_name || '.csv' AS matrix_path, 't.csv' AS sample_metadata_path, CASE WHEN c_custkey % 3 = 0 THEN 'gene_means' ELSE 'none' END AS postprocess FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'METH' ELSE c_mktsegment END AS c_mktsegment FROM customer)")
def k11_omics_entries(spark, sf):
    """A manifest entry a customer's matrix, a third of them arrays of beta values."""
    specs = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("METH")).otherwise(F.col("c_mktsegment")).alias("modality"), F.concat("c_name", F.lit(".csv")).alias("matrix_path"))
    return sinks.omics_entries(specs, "t.csv").withColumn("modality", F.lower("modality"))


@query("SELECT DISTINCT 'C' || o_custkey AS sample_id, 'A549' AS cell_line, '' AS condition FROM orders")
def k11_metadata_template(spark, sf):
    """The samples of the orders, a row each to be filled in, written and read as sample metadata are."""
    samples = table(spark, sf, "orders").select(on("C", "o_custkey").alias("sample"))
    made = files.sample_metadata(spark, csv(sinks.metadata_template(samples, "A549")))
    return made.select(F.col("sample").alias("sample_id"), "cell_line", F.coalesce("condition", F.lit("")).alias("condition"))


# --- loads

FLAWED = f"f AS (SELECT head, CASE WHEN relation = 'expresses' AND effect_sign > 0 THEN 'associated_with' ELSE relation END AS relation, tail, CASE WHEN source = 'part' THEN 'unknown' ELSE source END AS source, CASE WHEN relation = 'participates' THEN 1.0::DOUBLE ELSE weight END AS weight, CASE WHEN source = 'customer' THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM ({EDGES_SQL}) WHERE NOT (relation = 'activates' AND weight > 0.5))"


@query(f"WITH {FLAWED}, n AS (SELECT DISTINCT unnest([head, tail]) AS name FROM f) SELECT relation AS what, source, count(*) AS n, round(sum(weight), 4) AS weight, round(sum(confidence), 4) AS confidence FROM f GROUP BY relation, source"
       " UNION ALL SELECT 'nodes', CASE WHEN name LIKE 'Cell::%' THEN 'Cell' ELSE split_part(name, '::', 1) END, count(*), 0, 0 FROM n GROUP BY 2")
def s29_bootstrap(spark, sf):
    """A CSV with empty fields, words for numbers and rows without an end makes the graph; what is given is the second look at it,
    after the CSV has been replaced by an empty one."""
    e = edges(spark, sf)
    path, at = graph.scratch(spark, "triples"), graph.scratch(spark, "graph")
    flawed = e.select(
        "head", F.when((F.col("relation") == "expresses") & (F.col("effect_sign") > 0), F.lit("")).otherwise(F.col("relation")).alias("relation"), F.when((F.col("relation") == "activates") & (F.col("weight") > 0.5), F.lit(" ")).otherwise(F.col("tail")).alias("tail"),
        F.when(F.col("source") != "part", F.col("source")).alias("source"), "version", F.when(F.col("relation") == "participates", F.lit("n/a")).otherwise(F.col("weight").cast("string")).alias("weight"),
        F.when(F.col("source") != "customer", F.col("confidence").cast("string")).alias("confidence"), F.lit("more").alias("further"))
    flawed.write.option("header", True).csv(path)
    bootstrap.available_graph(spark, at, path)
    flawed.limit(0).write.mode("overwrite").option("header", True).csv(path)
    node, edge = bootstrap.available_graph(spark, at, path)
    rows = edge.groupBy(F.col("relation").alias("what"), "source").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.sum("confidence"), 4).alias("confidence"))
    return rows.unionByName(node.groupBy(F.lit("nodes").alias("what"), F.col("type").alias("source")).agg(F.count("*").alias("n"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("confidence")))


@query("SELECT l_linenumber % 7 AS kind, count(*) AS n, round(sum(l_quantity / 50), 4) AS weight FROM lineitem WHERE l_suppkey % 4 <> 3 AND l_quantity / 50 >= 0.4 AND 1 - l_tax >= 0.95 GROUP BY 1")
def f05_floors(spark, sf):
    """Raw edges normalised under floors of weight and confidence; each kind of line has its relation."""
    made = build.normalise(raw_edges(spark, sf), min_weight=0.4, min_confidence=0.95)
    told = (" Up-regulates strongly", "upregulated by", "is repressed", "member_of", "pathway_name", "affects_size")
    kind = F.lit(6)
    for i, r in enumerate(told):
        kind = F.when(F.col("raw_relation") == r, F.lit(i)).otherwise(kind)
    return made.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@kg(f", s AS (SELECT 'gene::' || upper(gene) AS seed FROM ({SEEDS_SQL})) SELECT node AS seed, other, relation, weight, confidence FROM {INCIDENT} WHERE node IN (SELECT seed FROM s) AND other <> node"
    " QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, other, relation, confidence DESC) <= 20")
def m04_collectors(spark, sf):
    """What two halves of the edges have gathered for the seeds, merged."""
    e = edges(spark, sf)
    half = F.pmod(F.xxhash64("head", "tail"), F.lit(2)) == 0
    near, _ = build.merge_collectors(build.collectors(e.filter(half), seeds(spark, sf), 20), build.collectors(e.filter(~half), seeds(spark, sf), 20), 20)
    return near.select("seed", "other", "relation", "weight", "confidence")


# --- reports

TOLD = "CASE WHEN relation = 'expresses' THEN NULL WHEN relation = 'participates' THEN '{\"raw\":\"x\"}' WHEN relation = 'inhibits' THEN '{}' ELSE '{\"structured\":{\"a\":1},\"raw\":\"y\"}' END"


def told(df):
    """Edges with evidence by relation: none, some, empty, structured."""
    evidence = F.when(F.col("relation") == "expresses", F.lit(None).cast("string")).when(F.col("relation") == "participates", F.lit('{"raw":"x"}')).when(F.col("relation") == "inhibits", F.lit("{}")).otherwise(F.lit('{"structured":{"a":1},"raw":"y"}'))
    return df.withColumn("evidence", evidence)


@kg(f", t AS (SELECT *, {TOLD} AS evidence FROM edges) SELECT relation, coalesce(evidence, '') <> '' AS has_evidence, coalesce(contains(evidence, 'structured'), false) AS is_structured, count(*) AS n FROM t GROUP BY 1, 2, 3")
def s31_evidence_flags(spark, sf):
    return graph.with_evidence_flags(told(edges(spark, sf))).groupBy("relation", "has_evidence", F.coalesce("is_structured", F.lit(False)).alias("is_structured")).agg(F.count("*").alias("n"))


@kg(f", t AS (SELECT {TOLD} AS evidence FROM edges), k AS (SELECT unnest(json_keys(evidence)) AS key FROM t WHERE evidence IS NOT NULL) SELECT key, count(*) AS n FROM k WHERE key <> 'raw' GROUP BY key")
def v04_unexpected_keys(spark, sf):
    return evaluate.unexpected_keys(told(edges(spark, sf)), "evidence", ("raw",))


@kg(f""", every AS (SELECT name, type FROM nodes UNION ALL SELECT 'gene::X' || s_suppkey, 'gene' FROM supplier UNION ALL SELECT 'pathway::perturbation::KO_' || gene, 'pathway' FROM ({SEEDS_SQL})), t AS (SELECT *, {TOLD} AS evidence FROM edges),
  e AS (SELECT count(*) AS edges, count(DISTINCT relation) AS relations, count(DISTINCT source) AS sources, round(count(*) FILTER (contains(evidence, 'structured')) / CAST(count(*) AS DOUBLE), 4) AS structured,
    round(count(*) FILTER (effect_sign <> 0) / CAST(count(*) AS DOUBLE), 4) AS direction, round(count(*) FILTER (length(evidence) > 2) / CAST(count(*) AS DOUBLE), 4) AS evidence, count(*) FILTER (relation = 'expresses') AS omics FROM t),
  v AS (SELECT count(*) AS nodes, count(DISTINCT type) AS types, count(*) FILTER (name LIKE 'pathway::perturbation::%') AS perturbations, round(count(*) FILTER (name NOT IN (SELECT name FROM nodes)) / CAST(count(*) AS DOUBLE), 4) AS alone FROM every),
  c AS (SELECT round(count(*) FILTER ('gene::' || gene IN (SELECT name FROM every)) / CAST(greatest(1, count(*)) AS DOUBLE), 4) AS cover FROM (SELECT DISTINCT upper(gene) AS gene FROM ({SEEDS_SQL}))),
  s AS (SELECT unnest([
    {{'part': 'structure', 'score': round(least(25.0::DOUBLE, 8 * log10(nodes) / 5 + 8 * log10(edges) / 6 + 5 * types / 8.0::DOUBLE + 4 * relations / 15.0::DOUBLE), 1)}},
    {{'part': 'omics', 'score': round(least(20.0::DOUBLE, 10 * 1 / 5.0::DOUBLE + 10 * least(1.0::DOUBLE, omics / 50000.0::DOUBLE)), 1)}},
    {{'part': 'semantic', 'score': round(least(15.0::DOUBLE, 5 * sources / 13.0::DOUBLE + 4 * structured + 3 * direction + 3 * evidence), 1)}},
    {{'part': 'connectivity', 'score': round(greatest(2.0::DOUBLE, least(20.0::DOUBLE, 12 * (1 - alone) + 8 * least(1.0::DOUBLE, round(edges / (CAST(nodes AS DOUBLE) * (nodes - 1)), 8) * 10000000))), 1)}},
    {{'part': 'perturbation', 'score': round(least(15.0::DOUBLE, 10 * cover + 5 * least(1.0::DOUBLE, perturbations / 50.0::DOUBLE)), 1)}},
    {{'part': 'consistency', 'score': round(least(5.0::DOUBLE, 3 + 2 * (1 - alone)), 1)}}], recursive := true) FROM e, v, c)
  SELECT part, score FROM s UNION ALL SELECT 'total', round(sum(score), 1) FROM s""")
def e07_quality(spark, sf):
    """The score of the graph with evidence, nodes without edges, and the seeds' perturbations."""
    more = table(spark, sf, "supplier").select(on("gene::X", "s_suppkey").alias("name"), F.lit("gene").alias("type"), F.lit(False).alias("is_seed"))
    asked = seeds(spark, sf).select(F.concat(F.lit("pathway::perturbation::KO_"), "gene").alias("name"), F.lit("pathway").alias("type"), F.lit(False).alias("is_seed"))
    return evaluate.quality(told(edges(spark, sf)), nodes(spark, sf).unionByName(more).unionByName(asked), seeds(spark, sf))


@query("SELECT 'P' || p_partkey AS token, (p_size * 2)::VARCHAR || '.00%' AS share, upper(trim(p_brand)) AS seed FROM part")
def p30_report_texts(spark, sf):
    part = table(spark, sf, "part")
    return part.select(rules.suffix(on("a::gene::P", "p_partkey")).alias("token"), rules.percent(F.col("p_size") / 50).alias("share"), F.upper(F.trim("p_brand")).alias("seed"))


# --- small ends of reads and predictions

@kg(f", f AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS seq FROM edges QUALIFY seq <= 200), ends AS (SELECT name, min(2 * seq + side) AS pos FROM (SELECT head AS name, seq, 0 AS side FROM f UNION ALL SELECT tail, seq, 1 FROM f) GROUP BY name),"
    " adm AS (SELECT name FROM ends ORDER BY pos LIMIT 80) SELECT head, relation, tail, weight, confidence FROM f WHERE head IN (SELECT name FROM adm) AND tail IN (SELECT name FROM adm)")
def g05_fallback(spark, sf):
    """The first nodes by name are cells, conditions and genes, which have no edges among themselves: the first edges are shown."""
    return graph.visualise(edges(spark, sf), nodes(spark, sf))


@query("SELECT upper(p_type) AS protein, round(median((p_retailprice - 1500) / 500), 6) AS log2_fc, arg_min(p_brand, p_partkey) AS source FROM part GROUP BY 1")
def k09_calibration(spark, sf):
    """Medians written as a calibration table and read again."""
    rows = table(spark, sf, "part").select(F.upper("p_type").alias("protein"), ((F.col("p_retailprice") - 1500) / 500).alias("log2_fc"), F.col("p_brand").alias("source"), F.col("p_partkey").alias("n"))
    path = graph.scratch(spark, "calibration")
    sinks.write_calibration(files.median_calibration(rows), path)
    return rounded(files.calibration(spark, path), "log2_fc")


@query("WITH c AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 0.0::DOUBLE ELSE s_acctbal / 2000 END AS fc FROM supplier WHERE s_suppkey % 4 <> 0),"
       " r AS (SELECT l_orderkey, l_linenumber, l_suppkey, (CASE WHEN l_linenumber % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN l_returnflag = 'A' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * (l_quantity / 50) * 0.15::DOUBLE AS raw FROM lineitem),"
       " d AS (SELECT l_orderkey, l_linenumber, CASE WHEN fc IS NULL THEN raw ELSE (CASE WHEN fc <> 0 THEN sign(fc) * abs(raw) ELSE raw END) * greatest(0.7::DOUBLE, least(2.0::DOUBLE, 1.0::DOUBLE + 0.35::DOUBLE * abs(fc))) END AS delta FROM r LEFT JOIN c ON l_suppkey = s_suppkey)"
       " SELECT l_orderkey, l_linenumber, round(delta, 4) + 0.0::DOUBLE AS delta, CASE WHEN delta > 0 THEN '增强' ELSE '抑制' END AS effect FROM d")
def j17_calibrated(spark, sf):
    """Every line's effect on its protein, by the prior of a protein that has one; a prior of 0 leaves the sign."""
    rows = line(spark, sf).select("l_orderkey", "l_linenumber", on("protein::S", "l_suppkey").alias("node"), F.when(F.col("l_returnflag") == "A", -1.0).otherwise(1.0).alias("direction_sign"), (F.col("l_quantity") / 50).alias("score"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("KO_x")).otherwise(F.lit("OE_x")).alias("perturbation"))
    prior = table(spark, sf, "supplier").filter("s_suppkey % 4 <> 0").select(on("S", "s_suppkey").alias("protein"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("s_acctbal") / 2000).alias("log2_fc"))
    made = predict.deltas(rows, F.col("perturbation"), predict.DELTA_PROTEIN, prior)
    return made.select("l_orderkey", "l_linenumber", (F.col("delta") + F.lit(0.0)).alias("delta"), "effect")
