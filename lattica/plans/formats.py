"""Queries of the file formats: each writes a public format's lines from the tables, reads them with its parser, and is held against SQL over the same tables."""

from __future__ import annotations

import io
import itertools
import tarfile
import zipfile

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..operators import build, graph, retrieval
from ..sources import archives, files, parsers, sinks, snapshots
from ..streaming import micro
from .queries import BOUGHT, bought, query, rounded
from .views import EDGES_SQL, SEEDS_SQL, edges, seeds, table

RESULT = ("head", "relation", "tail", "weight", "confidence")


def text(df: DataFrame, *fields: Column | str, sep: str = "\t") -> str:
    """Writes a line a row and gives the folder."""
    path = graph.scratch(df.sparkSession, "lines")
    df.select(F.concat_ws(sep, *(F.coalesce(x.cast("string"), F.lit("")) if isinstance(x, Column) else F.lit(x) for x in fields))).write.text(path)
    return path


def tsv(df: DataFrame, **columns: Column) -> str:
    """Writes tab-separated files, each under its header, and gives the folder."""
    path = graph.scratch(df.sparkSession, "table")
    df.select(*(c.cast("string").alias(k) for k, c in columns.items())).write.options(sep="\t", header=True, comment="~", emptyValue="").csv(path)
    return path


def csv(df: DataFrame) -> str:
    path = graph.scratch(df.sparkSession, "csv")
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


def archived(df: DataFrame, kind: str) -> str:
    """Writes an archive a task of (member, value), a member of a tar for each row, of a zip for each run of rows of a name;
    gives the folder. A task that runs again writes the same name anew."""
    path = graph.scratch(df.sparkSession, "archives")

    def write(batches):
        where, inner = archives.located(path)
        where.create_dir(inner)
        part = TaskContext.get().partitionId()
        target = f"{inner}/_{part}-{TaskContext.get().taskAttemptId()}"
        rows = (row for batch in batches for row in zip(batch["member"], batch["value"]))
        with where.open_output_stream(target) as f:
            if kind == "tar":
                with tarfile.open(fileobj=f, mode="w|") as t:
                    for name, value in rows:
                        info, content = tarfile.TarInfo(name), value.encode()
                        info.size = len(content)
                        t.addfile(info, io.BytesIO(content))
            else:
                with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, run in itertools.groupby(rows, lambda r: r[0]):
                        with z.open(name, "w", force_zip64=True) as m:
                            for _, value in run:
                                m.write(value.encode() + b"\n")
        where.move(target, f"{inner}/{part}.{kind}")
        yield pd.DataFrame({"part": [part]})

    df.mapInPandas(write, "part int").write.format("noop").mode("overwrite").save()
    return path


def on(prefix: str, c: str, *, but: int = 0) -> Column:
    """prefix and number; every ``but``-th is empty."""
    made = F.concat(F.lit(prefix), F.col(c).cast("string"))
    return F.when(F.col(c) % but == 0, F.lit("")).otherwise(made) if but else made


def line(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def triples(df: DataFrame) -> DataFrame:
    return df.select(*RESULT)


S = "CAST({} AS VARCHAR)".format


@query(r"""SELECT 'pathway::R-HSA-' || l_suppkey AS head, 'pathway_child_of' AS relation, 'pathway::R-HSA-' || l_partkey AS tail, 0.6::DOUBLE AS weight, 0.65::DOUBLE AS confidence,
  '{"raw":"R-HSA-' || l_partkey || '\tR-HSA-' || l_suppkey || '","structured":{"parent":"R-HSA-' || l_partkey || '","child":"R-HSA-' || l_suppkey || '"}}' AS evidence
  FROM lineitem WHERE l_partkey % 7 <> 0""")
def s01_reactome_relations(spark, sf):
    path = text(line(spark, sf), on("R-HSA-", "l_partkey", but=7), on("R-HSA-", "l_suppkey"))
    return parsers.reactome_relations(spark, path).select(*RESULT, "evidence")


@query("SELECT 'pathway::R-HSA-' || p_partkey AS head, 'pathway_name' AS relation, 'term::' || replace(p_type, ' ', '_') AS tail, 0.4::DOUBLE AS weight, 0.6::DOUBLE AS confidence FROM part WHERE p_size % 3 <> 0")
def s02_reactome_pathways(spark, sf):
    species = F.when(F.col("p_size") % 3 == 0, "Mus musculus").otherwise(" homo SAPIENS")
    return triples(parsers.reactome_pathways(spark, text(table(spark, sf, "part"), on("R-HSA-", "p_partkey"), F.col("p_type"), species)))


ONE_LINE = r"regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g')"


def one_line() -> Column:
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ")


def line_facts(fields: Column) -> list[Column]:
    return [fields[0].cast("long").alias("doc_id"), F.length(fields[1]).cast("long").alias("chars"), F.md5(fields[1]).alias("digest")]


@query(f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, {ONE_LINE} AS t FROM documents)")
def s17_zip_lines(spark, sf):
    """Texts are the human member of their zip; what stands beside them is not read."""
    docs = table(spark, sf, "documents").select(F.explode(F.array(F.lit("a.txt"), F.lit("homo_sapiens/b.tsv"))).alias("member"), F.concat_ws("\t", F.col("doc_id").cast("string"), one_line()).alias("value"))
    path = archived(docs.sortWithinPartitions("member"), "zip")
    return archives.read(spark, path).select(*line_facts(F.split("value", "\t", 2)))


@query(f"SELECT doc_id, lang, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, coalesce(lang, '') AS lang, {ONE_LINE} AS t FROM documents)")
def s36_tar_members(spark, sf):
    """A member a text, its language in its path."""
    docs = table(spark, sf, "documents").select(F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), F.concat(F.col("doc_id").cast("string"), F.lit("\t"), one_line(), F.lit("\n")).alias("value"))
    got = archives.read(spark, archived(docs, "tar"), stretch=32 << 20)
    fields = F.split("value", "\t", 2)
    return got.select(F.substring_index("member", "/", 1).alias("lang"), *line_facts(fields))


@query("WITH h AS (SELECT *, 'Step ' || (l_partkey % 10) AS n FROM lineitem WHERE l_linenumber <> 2 AND l_suppkey % 5 <> 0)"
       " SELECT 'protein::P' || l_suppkey AS head, 'participates_in_pathway' AS relation, 'pathway::R-' || l_partkey AS tail, 0.74::DOUBLE AS weight, 0.82::DOUBLE AS confidence FROM h"
       " UNION ALL SELECT 'pathway::R-' || l_partkey, 'pathway_name', 'term::' || replace(n, ' ', '_'), 0.45, 0.7 FROM h WHERE l_partkey % 4 <> 0")
def s03_reactome_uniprot(spark, sf):
    name = F.when(F.col("l_partkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Step "), (F.col("l_partkey") % 10).cast("string")))
    species = F.when(F.col("l_linenumber") == 2, "Rattus").otherwise("Homo sapiens")
    return triples(parsers.reactome_uniprot(spark, text(line(spark, sf), on("P", "l_suppkey", but=5), on("R-", "l_partkey"), "url", name, "IEA", species)))


@query("SELECT 'protein::9606.ENSP' || l_partkey AS head, 'protein_interacts_with' AS relation, 'protein::9606.ENSP' || l_suppkey AS tail, round(least(1.0, CAST(l_quantity * 21 AS INTEGER) / 1000.0::DOUBLE), 4) AS weight, weight AS confidence FROM lineitem WHERE CAST(l_quantity * 21 AS INTEGER) >= 700")
def s04_string_links(spark, sf):
    return triples(parsers.string_links(spark, text(line(spark, sf), on("9606.ENSP", "l_partkey"), on("9606.ENSP", "l_suppkey"), (F.col("l_quantity") * 21).cast("int"), sep="  ")))


@query("SELECT 'gene::SYM' || s_suppkey AS head, 'has_string_protein_id' AS relation, 'protein::9606.ENSP' || s_suppkey AS tail, 0.96::DOUBLE AS weight, 0.92::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 9 <> 0")
def s05_string_info(spark, sf):
    return triples(parsers.string_info(spark, tsv(table(spark, sf, "supplier"), **{"#string_protein_id": on("9606.ENSP", "s_suppkey"), "annotation": F.lit("x"), "preferred_name": on("sym", "s_suppkey", but=9)})))


@query("SELECT 'gene::' || a AS head, 'has_string_protein_id' AS relation, 'protein::9606.ENSP' || p_partkey AS tail, 0.88::DOUBLE AS weight, CASE p_size % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.86::DOUBLE ELSE 0.82::DOUBLE END AS confidence"
       " FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE replace(upper(p_brand), ' ', '_') || p_type[1:p_size // 2] END AS a FROM part) t WHERE p_partkey % 4 <> 0 AND length(a) <= 18 AND NOT contains(a, ' ')"
       " AND p_type[1:p_size // 2] NOT LIKE '% %'".replace("p_type[1:p_size // 2]", "repeat('X', p_size // 2)"))
def s06_string_aliases(spark, sf):
    alias = F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat("p_brand", F.repeat(F.lit("x"), F.floor(F.col("p_size") / 2).cast("int"))))
    kind = F.when(F.col("p_size") % 3 == 0, "Ensembl_HGNC").when(F.col("p_size") % 3 == 1, "UniProt_AC").otherwise("other")
    return triples(parsers.string_aliases(spark, tsv(table(spark, sf, "part"), **{"#string_protein_id": on("9606.ENSP", "p_partkey"), "alias": alias, "source": kind})))


@query("SELECT 'gene::A' || l_partkey AS head, CASE WHEN l_linestatus = 'O' THEN 'gene_related_to' ELSE 'controls-' || lower(l_returnflag) END AS relation, 'gene::B' || l_suppkey AS tail, 0.7::DOUBLE AS weight, 0.7::DOUBLE AS confidence FROM lineitem WHERE l_linenumber <> 3")
def s07_pathway_commons(spark, sf):
    left = F.concat(F.when(F.col("l_linenumber") == 3, F.lit("# a")).otherwise(F.lit("a")), F.col("l_partkey").cast("string"))
    relation = F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.concat(F.lit("Controls-"), "l_returnflag"))
    return triples(parsers.pathway_commons(spark, text(line(spark, sf), left, relation, on("b", "l_suppkey"))))


@query("SELECT 'rna_or_protein::LNC' || l_partkey AS head, 'binds_' || lower(l_returnflag) AS relation, 'rna_or_protein::S' || l_suppkey AS tail, 0.65::DOUBLE AS weight, 0.68::DOUBLE AS confidence FROM lineitem WHERE l_linenumber <> 1")
def s08_npinter(spark, sf):
    left = F.when(F.col("l_linenumber") == 1, F.lit("Interactor1")).otherwise(on("LNC", "l_partkey"))
    return triples(parsers.npinter(spark, text(line(spark, sf), left, F.concat(F.lit("Binds "), "l_returnflag"), on("S", "l_suppkey"))))


@query("SELECT 'gene::' || l_partkey AS head, 'participates_in_pathway' AS relation, 'pathway::kegg_hsa' || l_suppkey AS tail, 0.72::DOUBLE AS weight, 0.75::DOUBLE AS confidence FROM lineitem WHERE l_partkey % 6 <> 0")
def s09_kegg_links(spark, sf):
    gene = F.concat(F.lit("hsa:"), F.when(F.col("l_partkey") % 6 == 0, F.lit("")).otherwise(F.col("l_partkey").cast("string")))
    return triples(parsers.kegg_links(spark, text(line(spark, sf), gene, on("path:hsa", "l_suppkey"))))


@query("SELECT 'gene::EGFR' AS head, 'participates_in_pathway' AS relation, 'pathway::wp_WP' || n_nationkey AS tail, 0.66::DOUBLE AS weight, 0.7::DOUBLE AS confidence FROM nation WHERE n_nationkey % 5 <> 0")
def s10_wikipathways(spark, sf):
    """One document lists all: the nations, 25 rows."""
    row = F.struct(F.when(F.col("n_nationkey") % 5 != 0, on("WP", "n_nationkey")).alias("id"), F.col("n_name").alias("name"))
    path = graph.scratch(spark, "json")
    table(spark, sf, "nation").agg(F.to_json(F.struct(F.collect_list(row).alias("result")))).write.text(path)
    return triples(parsers.wikipathways(spark, path, query_gene="egfr"))


@query("SELECT 'gene::' || replace(n_name, ' ', '_') AS head, 'supported_by_eclip' AS relation, 'cell_context::' || CASE WHEN n_regionkey = 0 THEN 'E' || n_nationkey WHEN n_regionkey = 1 THEN 'unknown' ELSE 'K_' || n_regionkey END AS tail, 0.74::DOUBLE AS weight, 0.78::DOUBLE AS confidence FROM nation WHERE n_nationkey % 8 <> 0")
def s11_encode_eclip(spark, sf):
    """A report of one file with a line above its header: the nations, 25 rows."""
    path = graph.scratch(spark, "report")
    cells = table(spark, sf, "nation").select(F.concat_ws("\t", F.when(F.col("n_nationkey") % 8 == 0, "").otherwise(F.lower("n_name")), F.when(F.col("n_regionkey") < 2, "").otherwise(F.concat(F.lit("K "), F.col("n_regionkey").cast("string"))), F.when(F.col("n_regionkey") == 1, "").otherwise(on("E", "n_nationkey"))).alias("value"))
    head = spark.createDataFrame([(0, "about the file"), (1, "Target of assay\tBiosample summary\tAccession")], "n int, value string")
    head.unionByName(cells.withColumn("n", F.lit(2))).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return triples(parsers.encode_eclip(spark, path))


@query("SELECT 'gene::A' || l_partkey AS head, 'biogrid_interacts_with' AS relation, 'gene::' || CASE WHEN l_suppkey % 3 = 0 THEN 'SYS' ELSE 'B' END || l_suppkey AS tail, 0.76::DOUBLE AS weight, 0.74::DOUBLE AS confidence FROM lineitem WHERE l_linenumber <> 4")
def s12_biogrid(spark, sf):
    return triples(parsers.biogrid(spark, tsv(line(spark, sf), **{
        "Official Symbol Interactor A": on("a", "l_partkey"), "Official Symbol Interactor B": on("b", "l_suppkey", but=3), "Systematic Name Interactor B": on("sys", "l_suppkey"),
        "Organism ID Interactor A": F.when(F.col("l_linenumber") == 4, "10090").otherwise("9606"), "Organism ID Interactor B": F.when(F.col("l_linenumber") == 1, "").otherwise("9606"), "Experimental System": F.lit("Two-hybrid")})))


@query("WITH l AS (SELECT *, l_returnflag IN ('A', 'R') AS signed FROM lineitem WHERE l_linenumber <> 5)"
       " SELECT CASE WHEN l_partkey % 2 = 0 THEN 'protein::p' || l_partkey ELSE 'gene::P' || l_partkey END AS head, CASE l_returnflag WHEN 'A' THEN 'activates' WHEN 'R' THEN 'inhibits' ELSE 'associated_with' END AS relation, CASE WHEN l_suppkey % 3 = 0 THEN 'mirna::S' || l_suppkey ELSE 'gene::S' || l_suppkey END AS tail,"
       " CASE WHEN signed THEN 0.88::DOUBLE ELSE 0.7::DOUBLE END AS weight, CASE WHEN NOT signed THEN 0.72::DOUBLE WHEN l_linestatus = 'O' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM l")
def s13_signor(spark, sf):
    effect = F.when(F.col("l_returnflag") == "A", "up-regulates activity").when(F.col("l_returnflag") == "R", "down-regulates").otherwise("unknown")
    kinds = F.when(F.col("l_partkey") % 2 == 0, "protein").otherwise("gene"), F.when(F.col("l_suppkey") % 3 == 0, "microRNA").otherwise("gene")
    organism, pmid = F.when(F.col("l_linenumber") == 5, "10090").otherwise("9606"), F.when(F.col("l_linestatus") == "O", F.col("l_orderkey").cast("string")).otherwise("")
    return triples(parsers.signor(spark, text(line(spark, sf), on("p", "l_partkey"), kinds[0], "x", "x", on("s", "l_suppkey"), kinds[1], "x", "x", effect, "x", "x", organism, "x", "x", "x", "x", "x", pmid)))


@query("WITH l AS (SELECT *, l_returnflag <> 'N' AS s, l_linenumber % 2 = 0 AS i, l_linestatus = 'O' AS c FROM lineitem)"
       " SELECT 'gene::A' || l_partkey AS head, CASE WHEN s AND NOT i THEN 'activates' WHEN i AND NOT s THEN 'inhibits' ELSE 'associated_with' END AS relation, 'gene::B' || l_suppkey AS tail, CASE WHEN c THEN 0.86::DOUBLE ELSE 0.78::DOUBLE END AS weight, CASE WHEN c THEN 0.87::DOUBLE ELSE 0.78::DOUBLE END AS confidence FROM l")
def s14_omnipath(spark, sf):
    return triples(parsers.omnipath(spark, tsv(line(spark, sf), source=F.when(F.col("l_partkey") % 2 == 0, on("a", "l_partkey")), source_genesymbol=on("A", "l_partkey"), target=on("b", "l_suppkey"), is_stimulation=F.when(F.col("l_returnflag") != "N", "1").otherwise("0"), is_inhibition=F.when(F.col("l_linenumber") % 2 == 0, "True").otherwise("False"), consensus_direction=F.when(F.col("l_linestatus") == "O", "yes").otherwise("no"))))


@query("SELECT 'gene::PART_' || p_partkey AS head, 'has_ncbi_gene_id' AS relation, 'ncbi_gene::' || p_partkey AS tail, 1.0::DOUBLE AS weight, 0.95::DOUBLE AS confidence FROM part WHERE p_size % 2 = 0")
def s15_ncbi_genes(spark, sf):
    return triples(parsers.ncbi_genes(spark, tsv(table(spark, sf, "part"), **{"#tax_id": F.when(F.col("p_size") % 2 == 0, "9606").otherwise("10090"), "GeneID": F.col("p_partkey"), "Symbol": on("part ", "p_partkey")})))


@query("SELECT 'gene::G' || p_partkey AS head, 'has_ensembl_gene_id' AS relation, 'ensembl_gene::ENSG' || p_partkey AS tail, 1.0::DOUBLE AS weight, 0.95::DOUBLE AS confidence FROM part WHERE p_size % 4 <> 0 AND p_partkey % 5 <> 0")
def s16_ensembl_gtf(spark, sf):
    kind = F.when(F.col("p_size") % 4 == 0, "transcript").otherwise("gene")
    named = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(' gene_name "g'), F.col("p_partkey").cast("string"), F.lit('";')))
    told = F.concat(F.lit('gene_id "ENSG'), F.col("p_partkey").cast("string"), F.lit('";'), named)
    return triples(parsers.ensembl_gtf(spark, text(table(spark, sf, "part"), "1", "havana", kind, "1", "2", ".", "+", ".", told)))


# --- other files

@query("SELECT 'P' || p_partkey AS entity, sample, CAST(value AS DOUBLE) AS value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS price FROM part) UNPIVOT INCLUDE NULLS (value FOR sample IN (size, price))")
def s18_matrix(spark, sf):
    wide = table(spark, sf, "part").select(on("P", "p_partkey").alias("gene"), F.col("p_size").cast("double").cast("string").alias("size"), F.when(F.col("p_size") % 7 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string")).alias("price"))
    return files.matrix(spark, csv(wide))


@query("SELECT 'C' || c_custkey AS cell_id, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'KO_' || c_nationkey END AS perturbation FROM customer")
def s21_perturbations(spark, sf):
    own = table(spark, sf, "customer").select(on("C", "c_custkey").alias("cell_id"), on("KO_", "c_nationkey").alias("perturbation"))
    return files.perturbations(spark, csv(own.filter(F.expr("cast(substr(cell_id, 2) as long) % 3 <> 0"))), own)


@query("SELECT entity, cell, value, CASE WHEN q = 0 THEN 'unknown' ELSE 'OE_' || q END AS perturbation FROM (SELECT 'P' || p_partkey AS entity, cell, CAST(value AS DOUBLE) AS value, CASE cell WHEN 'a' THEN 1 WHEN 'b' THEN 2 ELSE 0 END AS q FROM (SELECT p_partkey, p_size AS a, p_size * 2 AS b, p_size * 3 AS c FROM part) UNPIVOT (value FOR cell IN (a, b, c)))")
def s22_dataset(spark, sf):
    size = F.col("p_size")
    wide = table(spark, sf, "part").select(on("P", "p_partkey").alias("gene"), size.alias("a"), (size * 2).alias("b"), (size * 3).alias("c"))
    known = csv(spark.createDataFrame([("a", "OE_1"), ("b", "OE_0"), ("b", "OE_2")], "cell_id string, perturbation string").coalesce(1))
    long, perts = files.dataset(spark, csv(wide), perturbation_path=known)
    return long.join(perts.withColumnRenamed("cell_id", "cell"), "cell").select("entity", "cell", "value", "perturbation")


@query("SELECT 'C' || c_custkey AS sample, CASE WHEN c_nationkey % 4 <> 0 THEN 'L' || c_nationkey END AS cell_line, c_mktsegment AS condition FROM customer")
def s24_sample_metadata(spark, sf):
    own = table(spark, sf, "customer").select(on("C", "c_custkey").alias("sample_id"), F.when(F.col("c_nationkey") % 4 != 0, on("L", "c_nationkey")).alias("cell_line"), F.col("c_mktsegment").alias("condition"))
    return files.sample_metadata(spark, csv(own))


@query("SELECT 'miR-' || l_suppkey AS mirna, 'P' || l_partkey AS gene FROM lineitem WHERE l_suppkey % 3 <> 0")
def s25_mirna_targets(spark, sf):
    return files.mirna_targets(spark, csv(line(spark, sf).select(F.lit("x").alias("note"), F.concat(F.lit(" "), on("P", "l_partkey")).alias("Target"), on("miR-", "l_suppkey", but=3).alias("miRNA"))))


@query("SELECT DISTINCT upper(replace(p_brand, '#', ' ')).replace(' ', '_') AS gene FROM part")
def s28_seed_genes(spark, sf):
    return files.seed_genes(spark, csv(table(spark, sf, "part").select(F.concat(F.lit("  "), F.lower(F.translate("p_brand", "#", " "))).alias("gene"))))


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'P' || p_partkey ELSE 'c' || p_size END AS entity, p_brand AS sample, CAST(p_retailprice AS DOUBLE) AS value FROM part WHERE false UNION ALL SELECT 'P' || p_partkey, 's' || i, CAST(p_size * i AS DOUBLE) FROM part, range(1, 4) t(i)")
def s32_gene_effects(spark, sf):
    size = F.col("p_size")
    return files.gene_effects(spark, csv(table(spark, sf, "part").select(on("P", "p_partkey").alias("gene"), *((size * i).alias(f"s{i}") for i in (1, 2, 3)))))


@query("WITH r AS (SELECT upper(p_type) AS protein, CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE p_retailprice - 1500 END AS log2_fc FROM part) SELECT protein, max(abs(log2_fc)) AS most, count(*) AS n FROM r GROUP BY protein")
def s33_calibration(spark, sf):
    rows = table(spark, sf, "part").select(F.lower("p_type").alias("Gene"), F.when(F.col("p_partkey") % 5 == 0, F.lit("bad")).otherwise((F.col("p_retailprice") - 1500).cast("string")).alias("log2FC"))
    own = rows.groupBy(F.upper("Gene").alias("protein")).agg(F.count("*").alias("n"))
    return files.calibration(spark, csv(rows)).join(own, "protein").select("protein", F.abs("log2_fc").alias("most"), "n")


@query("SELECT r_name AS content, CAST(r_regionkey AS VARCHAR) AS key FROM region")
def s34_documents_json(spark, sf):
    """One JSON array: the regions, 5 rows."""
    path = graph.scratch(spark, "store")
    row = F.struct(F.col("r_name").alias("content"), F.create_map(F.lit("key"), F.col("r_regionkey").cast("string")).alias("metadata"))
    table(spark, sf, "region").agg(F.to_json(F.collect_list(row))).write.text(path)
    return files.documents_json(spark, path).select("content", F.col("metadata")["key"].alias("key"))


@query("SELECT 'P' || p_partkey AS value FROM part")
def s35_geo_series(spark, sf):
    """The table of one file between its marks; file order counts, so the file is one."""
    path = graph.scratch(spark, "series")
    body = table(spark, sf, "part").select(F.lit(2).alias("n"), on("P", "p_partkey").alias("value"))
    rest = spark.createDataFrame([(0, "!Series_title"), (1, "!series_matrix_table_begin"), (3, "!series_matrix_table_end"), (4, "after")], "n int, value string")
    body.unionByName(rest).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return files.geo_series_matrix(spark, path).select("value")


RAW_RELATION = "CASE l_linenumber % 7 WHEN 0 THEN ' Up-regulates strongly' WHEN 1 THEN 'upregulated by' WHEN 2 THEN 'is repressed' WHEN 3 THEN 'member_of' WHEN 4 THEN 'pathway_name' WHEN 5 THEN 'affects_size' ELSE '' END"
RAW_HEAD = "CASE l_partkey % 6 WHEN 0 THEN 'cell::c ' || l_partkey WHEN 1 THEN 'mi_rna::let ' || l_partkey WHEN 2 THEN 'wp' || l_partkey WHEN 3 THEN '9606.x' || l_partkey WHEN 4 THEN 'rna_or_protein::hsa' || l_partkey ELSE ' p' || l_partkey END"
RAW_TAIL = "CASE l_suppkey % 4 WHEN 0 THEN 'term::some path ' || l_suppkey WHEN 1 THEN 'Protein::s' || l_suppkey WHEN 2 THEN 'ensembl_gene::s' || l_suppkey ELSE '' END"


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges as sources write them: odd prefixes, spaces, case, relations in words, empty ends."""
    rows = line(spark, sf).selectExpr(f"{RAW_HEAD} AS head", f"{RAW_RELATION} AS relation", f"{RAW_TAIL} AS tail", "'s' AS source", "'v' AS version", "l_quantity / 50 AS weight", "1 - l_tax AS confidence", "CASE WHEN l_returnflag = 'A' THEN -1D ELSE 0D END AS effect_sign")
    return rows


@query(f"""WITH e AS (SELECT *, {RAW_HEAD} AS rh, {RAW_RELATION} AS rr, {RAW_TAIL} AS rt FROM lineitem),
  k AS (SELECT *, CASE WHEN l_partkey % 6 = 2 AND l_partkey % 4 = 0 THEN 'gene::WP' || l_partkey WHEN l_partkey % 6 = 0 THEN 'Cell::c_' || l_partkey WHEN l_partkey % 6 = 1 THEN 'mirna::LET_' || l_partkey WHEN l_partkey % 6 = 2 THEN 'pathway::wp' || l_partkey
      WHEN l_partkey % 6 = 3 THEN 'protein::9606.x' || l_partkey WHEN l_partkey % 6 = 4 THEN 'gene::HSA' || l_partkey ELSE 'gene::P' || l_partkey END AS h,
    CASE l_suppkey % 4 WHEN 0 THEN 'pathway::some_path_' || l_suppkey WHEN 1 THEN 'protein::s' || l_suppkey WHEN 2 THEN 'gene::S' || l_suppkey ELSE '' END AS t,
    CASE l_linenumber % 7 WHEN 0 THEN 'regulates' WHEN 1 THEN 'activates' WHEN 2 THEN 'inhibits' WHEN 3 THEN 'belongs_to' WHEN 4 THEN 'participates' WHEN 5 THEN 'affects_size' ELSE 'associated_with' END AS r FROM e),
  y AS (SELECT *, CASE WHEN h LIKE 'Cell::%' THEN 'Cell' ELSE split_part(h, '::', 1) END AS ht, split_part(t, '::', 1) AS tt FROM k WHERE t <> ''),
  f AS (SELECT *, ht = 'Cell' AS flip FROM y),
  g AS (SELECT CASE WHEN flip THEN t ELSE h END AS head, CASE WHEN flip THEN 'belongs_to' ELSE r END AS r, CASE WHEN flip THEN h ELSE t END AS tail, CASE WHEN flip THEN tt ELSE ht END AS head_type, CASE WHEN flip THEN ht ELSE tt END AS tail_type, rr AS raw_relation, l_returnflag, l_quantity, l_tax FROM f)
  SELECT head, CASE WHEN r LIKE 'affects%' OR (r = 'belongs_to' AND head_type IN ('gene', 'protein', 'pathway', 'sample', 'mirna') AND tail_type = 'Cell') OR (r = 'participates' AND head_type IN ('gene', 'protein') AND tail_type = 'pathway')
      OR (r IN ('activates', 'inhibits') AND head_type IN ('gene', 'protein') AND tail_type IN ('gene', 'protein')) OR (r = 'regulates' AND head_type = 'mirna' AND tail_type IN ('gene', 'protein')) THEN r ELSE 'associated_with' END AS relation,
    tail, head_type, tail_type, raw_relation, CASE WHEN raw_relation = 'pathway_name' THEN 'name' ELSE 'edge' END AS kind, l_quantity / 50 AS weight, 1 - l_tax AS confidence,
    CASE WHEN l_returnflag = 'A' THEN -1.0::DOUBLE WHEN raw_relation LIKE '%repress%' THEN -1.0::DOUBLE WHEN lower(raw_relation) LIKE '%up%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS effect_sign FROM g""")
def g17_raw_normalise(spark, sf):
    symbols = table(spark, sf, "part").filter("p_partkey % 4 = 0").select(F.concat(F.lit("WP"), F.col("p_partkey").cast("string")).alias("symbol"))
    return build.normalise(raw_edges(spark, sf), symbols).drop("source", "version")


@query(f"WITH e AS (SELECT {RAW_RELATION} AS r, {RAW_HEAD} AS h FROM lineitem) SELECT DISTINCT r, CASE WHEN trim(regexp_replace(upper(r), '[^A-Z0-9_]', '_', 'g'), '_') = '' THEN 'RELATED_TO' ELSE trim(regexp_replace(upper(r), '[^A-Z0-9_]', '_', 'g'), '_') END AS storage,"
       " CASE WHEN h LIKE 'cell::%' THEN 'Cell' WHEN h LIKE 'mi_rna%' THEN 'mirna' WHEN h LIKE 'wp%' THEN 'pathway' WHEN h LIKE '9606%' THEN 'protein' ELSE 'gene' END AS node_type,"
       " CASE WHEN contains(lower(r), 'repress') THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS saved_sign FROM e")
def p12_storage(spark, sf):
    """Storage names, node types of canonical ids, and the sign that a save gives."""
    e = raw_edges(spark, sf).select(F.col("relation").alias("r"), "head").distinct()
    return e.select("r", rules.storage_type(F.col("r")).alias("storage"), rules.canonical_node_type(F.col("head")).alias("node_type"), rules.relation_sign(F.col("r"), rules.SIGN_AT_SAVE).alias("saved_sign")).distinct()


@query("SELECT p_partkey, replace(replace(p_type, ' ', '_'), '_', ' ') AS pathway, CASE WHEN p_size % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign, round(greatest(0.7::DOUBLE, least(2.0::DOUBLE, 1.0::DOUBLE + 0.35::DOUBLE * abs((p_retailprice - 1500) / 300))), 6) AS factor, 'PART' || p_partkey AS symbol,"
       " round(least(0.99::DOUBLE, 0.4::DOUBLE + 0.04::DOUBLE * (p_size % 12) + 0.02::DOUBLE * (p_size % 5)), 6) AS sure FROM part")
def p15_small_rules(spark, sf):
    """Pathway names, signs of perturbations, calibration factors, symbols, confidence."""
    from ..operators.predict import confidence

    part = table(spark, sf, "part")
    tail = F.concat(F.lit("term::"), rules.normalize_entity(F.col("p_type")))
    name = F.when(F.col("p_size") % 2 == 0, F.lit("KO_x")).otherwise(F.lit("OE_x"))
    return rounded(part.select(
        "p_partkey", rules.pathway_name(tail).alias("pathway"), rules.perturbation_sign(name).alias("sign"), rules.calibration_factor((F.col("p_retailprice") - 1500) / 300).alias("factor"),
        rules.strip_symbol(F.concat(F.lit("part"), F.col("p_partkey").cast("string"), F.lit(" (12)"))).alias("symbol"), confidence(F.col("p_size") % 12, F.col("p_size") % 5).alias("sure")), "factor", "sure")


@query("WITH w AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS a, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS b FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE round(CAST(len(b) AS DOUBLE) / len(a), 6) END AS jaccard FROM w")
def p32_jaccard(spark, sf):
    sets = line(spark, sf).groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey"))).alias("b"))  # the lines of one order
    return rounded(sets.select("l_orderkey", rules.jaccard(F.col("a"), F.col("b")).alias("jaccard")), "jaccard")


@query("WITH w AS (SELECT doc_id, '== ' || coalesce(lang, '') || ' == [[' || coalesce(source, '') || ']] {{x|y}} <b>' || n_chars || '</b> [[' || replace(coalesce(text, ''), chr(10), ']]' || chr(10) || '<i>[[') || ']] {{a' || chr(10) || 'b}} ' AS t FROM documents),"
       " p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '=+([^=]+)=+', '\\1', 'g'), '\\[\\[(.*?)\\]\\]', '\\1', 'g'), '\\{\\{(.*?)\\}\\}', '', 'g'), '<.*?>', '', 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS plain FROM w)"
       " SELECT doc_id, length(plain) AS chars, md5(plain) AS digest FROM p")
def p25_wiki(spark, sf):
    """Whole texts as wiki pages, each line of them a link behind a tag, with a template over two lines that stays."""
    some = lambda c: F.coalesce(c, F.lit(""))
    lines = F.replace(some("text"), F.lit("\n"), F.lit("]]\n<i>[["))
    marked = F.concat(F.lit("== "), some("lang"), F.lit(" == [["), some("source"), F.lit("]] {{x|y}} <b>"), F.col("n_chars").cast("string"), F.lit("</b> [["), lines, F.lit("]] {{a\nb}} "))
    plain = table(spark, sf, "documents").select("doc_id", tx.strip_wiki(marked).alias("plain"))
    return plain.select("doc_id", F.length("plain").cast("long").alias("chars"), F.md5("plain").alias("digest"))


@query("SELECT c_custkey, '{{CellPerturbationPrediction|cell=' || CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE c_name END || '|perturbation=' || c_mktsegment || '|effects=a/' || c_nationkey || '; b|confidence=0.5}}' AS template FROM customer")
def k12_template(spark, sf):
    who = F.when(F.col("c_custkey") % 5 == 0, F.lit(" ")).otherwise(F.col("c_name"))
    effects = F.array(F.concat(F.lit("a|"), F.col("c_nationkey").cast("string")), F.lit("b"))
    return table(spark, sf, "customer").select("c_custkey", sinks.prediction_template(who, F.col("c_mktsegment"), effects, F.lit(0.5)).alias("template"))


@query(f"WITH edges AS ({EDGES_SQL}) SELECT head, relation, tail, source, version, least(1.0, greatest(0.0, weight)) AS weight, least(1.0, greatest(0.0, confidence)) AS confidence, effect_sign FROM edges")
def k01_triples_csv(spark, sf):
    """The triples written and read again."""
    path = graph.scratch(spark, "triples")
    sinks.write_triples(edges(spark, sf).withColumn("evidence", F.lit('{"a":"x, \\"y\\""}')), path)
    return files.triples_csv(spark, path).select("head", "relation", "tail", "source", "version", "weight", "confidence", "effect_sign")


@query(f"WITH edges AS ({EDGES_SQL}) SELECT upper(relation) AS rel_type, head, tail, weight FROM edges")
def k03_edges_by_type(spark, sf):
    path = graph.scratch(spark, "by-type")
    sinks.append_edges(edges(spark, sf), path)
    return spark.read.parquet(path).select("rel_type", "head", "tail", "weight")


ONCE = "SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY head, relation, tail, source, version ORDER BY weight, confidence, effect_sign) = 1"


def dealt(rows: DataFrame, batches: int, path: str, *by: str) -> int:
    """Writes ``rows`` as files for so many batches, dealt by hash, and gives the files of a batch. There are as many files
    as shuffle partitions at least: few large ones would be read and written by as few tasks."""
    each = -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // batches)
    rows.repartition(batches * each, *by).write.parquet(path)
    return each


@query(f"WITH edges AS ({EDGES_SQL}), once AS ({ONCE}) SELECT relation, count(*) AS n, count(DISTINCT head) AS heads, round(sum(weight), 4) AS weight FROM once GROUP BY relation")
def m02_stream_load(spark, sf):
    """Edges as a stream of files, dealt by head so that a key's copies meet in one batch, loaded batch by batch."""
    source, path = graph.scratch(spark, "stream"), graph.scratch(spark, "graph")
    e = edges(spark, sf)
    micro.run_stream(spark, source, e._jdf.schema().toDDL(), path, max_files=dealt(e, 2, source, "head"))
    loaded = micro.read_edges(spark, path)
    return loaded.groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("head").alias("heads"), F.round(F.sum("weight"), 4).alias("weight"))


LOADED = f"""e AS (SELECT *, {RAW_HEAD} AS rh, {RAW_RELATION} AS rr, {RAW_TAIL} AS rt FROM lineitem),
  k AS (SELECT *, CASE l_linenumber % 7 WHEN 0 THEN 'regulates' WHEN 1 THEN 'activates' WHEN 2 THEN 'inhibits' WHEN 3 THEN 'belongs_to' WHEN 4 THEN 'participates' WHEN 5 THEN 'affects_size' ELSE 'associated_with' END AS r FROM e),
  once AS (SELECT DISTINCT rh, r, rr, rt FROM k WHERE rt <> ''),
  n AS (SELECT rh, rt, r, CASE WHEN l = 2 THEN 'pathway::' || rh WHEN l = 0 THEN 'Cell::' || replace(substr(rh, 7), ' ', '_') WHEN l = 1 THEN 'mirna::' || upper(replace(substr(rh, 9), ' ', '_')) WHEN l = 3 THEN 'protein::' || rh WHEN l = 4 THEN 'gene::' || upper(substr(rh, 17)) ELSE 'gene::' || upper(trim(rh)) END AS h,
    CASE WHEN rt LIKE 'term::%' THEN 'pathway::' || replace(substr(rt, 7), ' ', '_') WHEN rt LIKE 'Protein::%' THEN 'protein::' || substr(rt, 10) ELSE 'gene::' || upper(substr(rt, 15)) END AS t, rr
    FROM (SELECT *, CASE WHEN rh LIKE 'cell::%' THEN 0 WHEN rh LIKE 'mi_rna::%' THEN 1 WHEN rh LIKE 'wp%' THEN 2 WHEN rh LIKE '9606%' THEN 3 WHEN rh LIKE 'rna_or%' THEN 4 ELSE 5 END AS l FROM once))"""


def loaded(spark: SparkSession, sf: str) -> str:
    """Raw edges as a stream of files, loaded and normalised batch by batch; the folder of the graph."""
    source, path = graph.scratch(spark, "stream"), graph.scratch(spark, "graph")
    e = raw_edges(spark, sf)
    micro.run_stream(spark, source, e._jdf.schema().toDDL(), path, max_files=dealt(e, 4, source, "head"), normalise=build.normalise)
    return path


@query(f"WITH {LOADED}, a AS (SELECT DISTINCT h, t FROM n WHERE rr <> 'pathway_name'), p AS (SELECT DISTINCT CASE WHEN h LIKE 'Cell::%' THEN t ELSE h END AS name FROM n WHERE rr = 'pathway_name'),"
       " x AS (SELECT h AS name FROM a UNION SELECT t FROM a UNION SELECT name FROM p) SELECT name, CASE WHEN name LIKE 'Cell::%' THEN 'Cell' ELSE split_part(name, '::', 1) END AS type, name IN (SELECT name FROM p) AS named FROM x")
def k04_stream_nodes(spark, sf):
    """Nodes of the streamed graph: ends with their types, and whether a row named them (which of several does is the batches' order)."""
    nodes = micro.read_nodes(spark, loaded(spark, sf))
    return nodes.select("name", "type", F.col("pathway_name").isNotNull().alias("named"))


@query(f"WITH {LOADED}, d AS (SELECT DISTINCT rh, r, rt, rr = 'pathway_name' AS named FROM n) SELECT count(*) AS edges FROM d WHERE NOT named")
def a02_canonical_dedup(spark, sf):
    """How many edges a streamed load keeps of relations that differ in words only."""
    return micro.read_edges(spark, loaded(spark, sf)).agg(F.count("*").alias("edges"))


@query(f"WITH edges AS ({EDGES_SQL}), once AS (SELECT DISTINCT head, relation, tail, source, version FROM edges) SELECT relation, count(*) AS n, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails FROM once GROUP BY relation")
def j10_across_batches(spark, sf):
    """Every edge twice, its copies dealt to batches by all its columns and the copy: keys meet earlier batches all the time."""
    source, path = graph.scratch(spark, "stream"), graph.scratch(spark, "graph")
    twice = edges(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    each = dealt(twice, 6, source, *twice.columns)
    micro.run_stream(spark, source, edges(spark, sf)._jdf.schema().toDDL(), path, max_files=each)
    return micro.read_edges(spark, path).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("head").alias("heads"), F.count_distinct("tail").alias("tails"))


@query(f"WITH edges AS ({EDGES_SQL}), e AS (SELECT * FROM edges WHERE relation <> 'expresses'), n AS (SELECT head AS name FROM e UNION SELECT tail FROM e) SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM n) AS nodes")
def k05_replace(spark, sf):
    """A graph replaced by a part of itself, read from the very tables that it replaces."""
    path = graph.scratch(spark, "graph")
    e = edges(spark, sf)
    sinks.replace_graph(graph.node_table(e), e, path)
    part = snapshots.read(spark, path, "edges").filter("relation <> 'expresses'").select(*e.columns)
    sinks.replace_graph(graph.node_table(part), part, path)
    return snapshots.read(spark, path, "edges").agg(F.count("*").alias("edges")).crossJoin(snapshots.read(spark, path, "nodes").agg(F.count("*").alias("nodes")))  # one row each


# --- the document store

@query("SELECT doc_id, text, CAST(NULL AS VARCHAR) AS origin FROM documents UNION ALL SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY text), text, 'benchmark' FROM benchmark WHERE trim(text) <> ''")
def t03_add_documents(spark, sf):
    store = table(spark, sf, "documents").select("doc_id", "text", F.create_map().cast("map<string,string>").alias("metadata"))
    return retrieval.add_documents(store, table(spark, sf, "benchmark").select("text"), {"origin": "benchmark"}).select("doc_id", "text", F.col("metadata")["origin"].alias("origin"))


@query(f"WITH {BOUGHT}, top AS (SELECT sample AS cell, entity, value, row_number() OVER (PARTITION BY sample ORDER BY value DESC, entity) AS k FROM bought), g AS (SELECT cell, string_agg(entity, ', ' ORDER BY k) AS genes FROM top WHERE k <= 10 GROUP BY cell)"
       " SELECT cell, 'Cell ' || cell || ' under ' || coalesce(c_mktsegment, 'unknown') || '. Most expressed genes: ' || genes || '.' AS profile FROM g LEFT JOIN customer ON cell = 'C' || CAST(c_custkey AS VARCHAR)")
def p31_cell_profiles(spark, sf):
    who = table(spark, sf, "customer").select(on("C", "c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("perturbation"))
    return build.cell_profiles(bought(spark, sf).withColumnRenamed("sample", "cell"), who)


@query(f"WITH edges AS ({EDGES_SQL}), n AS (SELECT source, count(*) AS edges FROM edges GROUP BY source), m AS (SELECT split_part(name, '::', 1) AS source, count(*) AS nodes FROM (SELECT head AS name FROM edges UNION SELECT tail FROM edges) GROUP BY 1) SELECT source, coalesce(edges, 0) AS edges, coalesce(nodes, 0) AS nodes FROM n FULL JOIN m USING (source)")
def j13_source_counts(spark, sf):
    from ..operators import evaluate

    e = edges(spark, sf)
    named = graph.node_table(e).withColumn("source", F.substring_index("name", "::", 1))
    return evaluate.source_counts(e, named)


@query("SELECT source, lang AS version, count(*) AS files, string_agg(DISTINCT CAST(n_chars % 3 AS VARCHAR), ',' ORDER BY CAST(n_chars % 3 AS VARCHAR)) AS categories FROM documents GROUP BY source, lang")
def a21_datasets(spark, sf):
    entries = table(spark, sf, "documents").select("source", F.col("lang").alias("version"), (F.col("n_chars") % 3).cast("string").alias("category"))
    return files.datasets(entries).withColumn("categories", F.array_join("categories", ","))


@query("WITH c AS (SELECT c_mktsegment AS name, min(c_custkey) AS k FROM customer GROUP BY 1) SELECT n_name AS name, coalesce(c.k, -1) AS k FROM (SELECT n_name FROM nation UNION ALL SELECT DISTINCT c_mktsegment FROM customer) e LEFT JOIN c ON c.name = e.n_name")
def j25_manifest_catalog(spark, sf):
    results = table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")).distinct())
    catalog = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("k"))
    return files.with_catalog(results, catalog, "k").select("name", F.coalesce("k", F.lit(-1)).alias("k"))
