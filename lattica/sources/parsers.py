"""Parsers of public biology formats into triples. Each is (spark, path, source, version, ...) -> DataFrame.

Text is read by Spark's readers (gzip by extension) and parsed by built-in functions, so a file is split over tasks.
``max_rows`` is an optional safety valve on kept rows; without it every row is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import as_gene, as_pathway, as_protein, contains_any, evidence, normalize_entity, typed_entity

HUMAN = "9606"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): text lines; .zip archives are opened by ``sources.files.read_lines``."""
    from .files import read_lines

    return read_lines(spark, path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` and these columns, made once a row: a filter on a plain column would be pushed below it and make it again for
    each time that the filter names it."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def fields(spark: SparkSession, path: str, least: int, sep: str = r"\t") -> DataFrame:
    """(value, f): lines of at least ``least`` fields; surrounding quotes of a field are dropped."""
    f = F.transform(F.split("value", sep), lambda x: F.when(F.startswith(x, F.lit('"')), F.regexp_replace(x, '^"(.*)"$', "$1")).otherwise(x))
    return once(lines(spark, path).select("value"), f=f).filter(F.size("f") >= least)


def table(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """Tab-separated rows under their header, the line after ``skip`` others; all strings, empty as null."""
    text = lines(spark, path)
    if skip:
        first = [r["value"] for r in text.limit(skip + 1).collect()]  # the first lines of the file
        header = first[skip] if len(first) > skip else ""
    else:
        row = text.first()
        header = row["value"] if row else ""
    names = header.rstrip("\r\n").split("\t")
    body = text.filter(F.col("value") != header)
    if skip:
        body = body.filter(~F.col("value").isin(*first[:skip]))
    cells = body.filter(F.trim("value") != "").select(F.split("value", "\t").alias("c"))
    seen: dict[str, int] = {}
    for i, n in enumerate(names):
        seen.setdefault(n, i)
    return cells.select(*(F.nullif(F.trim(F.get("c", F.lit(i))), F.lit("")).alias(n) for n, i in seen.items()))


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of these columns that a row has a value in."""
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have, F.lit("")) if have else F.lit("")


def at(i: int) -> Column:
    return normalize_entity(F.get("f", F.lit(i)))


def made(df: DataFrame, head: Column, relation: Column | str, tail: Column, source: str, version: str, proof: Column, weight: Column | float, confidence: Column | float, max_rows: int | None = None) -> DataFrame:
    c = lambda x: F.lit(x) if isinstance(x, str | float) else x
    out = df.select(head.alias("head"), c(relation).alias("relation"), tail.alias("tail"), F.lit(source).alias("source"), F.lit(version).alias("version"), proof.alias("evidence"), c(weight).cast("double").alias("weight"), c(confidence).cast("double").alias("confidence"), F.lit(0.0).alias("effect_sign"))
    return out if max_rows is None else out.limit(max_rows)


def reactome_relations(spark, path, source="Reactome", version="v1", max_rows=None) -> DataFrame:
    """Parent and child pathway ids."""
    df = fields(spark, path, 2).withColumns({"p": at(0), "c": at(1)}).filter("p <> '' and c <> ''")
    return made(df, as_pathway(F.col("c")), "pathway_child_of", as_pathway(F.col("p")), source, version, evidence(F.concat_ws("\t", "p", "c"), parent=F.col("p"), child=F.col("c")), 0.6, 0.65, max_rows)


def reactome_pathways(spark, path, source="Reactome", version="v1", max_rows=None) -> DataFrame:
    """Pathway id, name, species; human only."""
    df = fields(spark, path, 3).withColumns({"i": at(0), "n": at(1), "s": F.get("f", F.lit(2))}).filter("lower(trim(s)) = 'homo sapiens' and i <> ''")
    return made(df, as_pathway(F.col("i")), "pathway_name", F.concat(F.lit("term::"), "n"), source, version, evidence(F.array_join(F.slice("f", 1, 3), "\t"), pathway_id=F.col("i"), pathway_name=F.col("n"), species=F.col("s")), 0.4, 0.6, max_rows)


def reactome_uniprot(spark, path, source="Reactome", version="v1", max_rows=None) -> DataFrame:
    """UniProt id, pathway id, -, name, -, species; one triple, and one more if the pathway has a name."""
    df = fields(spark, path, 6).withColumns({"u": at(0), "i": at(1), "n": at(3)}).filter("lower(trim(f[5])) = 'homo sapiens' and u <> '' and i <> ''")
    raw = F.substring(F.array_join(F.slice("f", 1, 6), "\t"), 1, 500)
    part = made(df, as_protein(F.col("u")), "participates_in_pathway", as_pathway(F.col("i")), source, version, evidence(raw, uniprot=F.col("u"), pathway_id=F.col("i"), pathway_name=F.col("n"), species=F.get("f", F.lit(5))), 0.74, 0.82)
    name = made(df.filter("n <> ''"), as_pathway(F.col("i")), "pathway_name", F.concat(F.lit("term::"), "n"), source, version, evidence(raw, pathway_id=F.col("i"), pathway_name=F.col("n")), 0.45, 0.7)
    out = part.unionByName(name)
    return out if max_rows is None else out.limit(max_rows)


def string_links(spark, path, source="STRING", version="v1", min_score=700, max_rows=None) -> DataFrame:
    """Two proteins and an integer score out of 1000."""
    df = lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") >= 3).withColumn("s", F.get("f", F.lit(2)).try_cast("int"))
    df = df.filter(F.col("s") >= min_score)
    w = F.round(F.least(F.lit(1.0), F.col("s") / 1000), 4)
    return made(df, as_protein(F.get("f", F.lit(0))), "protein_interacts_with", as_protein(F.get("f", F.lit(1))), source, version, evidence(F.array_join(F.slice("f", 1, 3), " "), string_score=F.col("s")), w, w, max_rows)


def string_info(spark, path, source="STRING", version="v1", max_rows=None) -> DataFrame:
    df = table(spark, path)
    df = df.select(normalize_entity(first_of(df, "#string_protein_id", "string_protein_id")).alias("p"), F.upper(normalize_entity(first_of(df, "preferred_name"))).alias("n")).filter("p <> '' and n <> ''")
    return made(df, as_gene(F.col("n")), "has_string_protein_id", as_protein(F.col("p")), source, version, evidence(F.concat_ws("\t", "p", "n"), string_protein_id=F.col("p"), preferred_name=F.col("n")), 0.96, 0.92, max_rows)


def string_aliases(spark, path, source="STRING", version="v1", max_rows=None) -> DataFrame:
    """Protein, alias, alias source under one header line; aliases have a letter and at most 18 characters."""
    head = lines(spark, path).first()
    df = fields(spark, path, 2).filter(F.col("value") != (head["value"] if head else "")).withColumns({"p": at(0), "a": F.upper(at(1)), "s": F.lower(at(2))})
    df = df.filter((F.col("p") != "") & F.col("a").rlike(r"\p{L}") & (F.length("a") <= 18))
    sure = F.when(F.contains("s", F.lit("hgnc")), 0.9).when(F.contains("s", F.lit("uniprot")), 0.86).otherwise(0.82)
    return made(df, as_gene(F.col("a")), "has_string_protein_id", as_protein(F.col("p")), source, version, evidence(F.array_join(F.slice("f", 1, 3), "\t"), string_protein_id=F.col("p"), alias=F.col("a"), alias_source=F.col("s")), 0.88, sure, max_rows)


def pathway_commons(spark, path, source="PathwayCommons", version="v1", max_rows=None) -> DataFrame:
    """Tab SIF: left, relation, right; # lines are comments."""
    df = lines(spark, path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')").select("value", F.split("value", "\t").alias("f")).filter(F.size("f") >= 3)
    df = df.withColumns({"l": F.upper(at(0)), "r": F.lower(at(1)), "t": F.upper(at(2))})
    rel = F.when(F.col("r") == "", F.lit("gene_related_to")).otherwise(F.col("r"))
    return made(df, as_gene(F.col("l")), rel, as_gene(F.col("t")), source, version, evidence(F.substring("value", 1, 500), left=F.col("l"), relation=F.col("r"), right=F.col("t")), 0.7, 0.7, max_rows)


def npinter(spark, path, source="NPInter", version="v1", max_rows=None) -> DataFrame:
    df = fields(spark, path, 3).withColumns({"l": at(0), "r": F.lower(at(1)), "t": at(2)}).filter(~F.lower("l").isin("rna", "rna_interactor", "interactor1"))
    rel = F.when(F.col("r") == "", F.lit("rna_protein_regulates")).otherwise(F.col("r"))
    return made(df, F.concat(F.lit("rna_or_protein::"), "l"), rel, F.concat(F.lit("rna_or_protein::"), "t"), source, version, evidence(F.substring(F.array_join(F.slice("f", 1, 6), "|"), 1, 500), left=F.col("l"), relation=rel, right=F.col("t")), 0.65, 0.68, max_rows)


def kegg_links(spark, path, source="KEGG", version="v1", query_gene="", max_rows=None) -> DataFrame:
    """db:gene and db:pathway; the query's gene stands for all."""
    df = lines(spark, path).select(F.trim("value").alias("value")).filter(F.contains("value", F.lit("\t")))
    after = lambda c: F.regexp_replace(c, r"^[^:]*:", "")
    df = df.withColumns({"g0": F.upper(normalize_entity(after(F.substring_index("value", "\t", 1)))), "p": normalize_entity(after(F.regexp_replace("value", r"^[^\t]*\t", "")))})
    asked = F.upper(normalize_entity(F.lit(query_gene)))
    df = df.withColumn("g", F.when(asked != "", asked).otherwise(F.col("g0"))).filter("g <> '' and p <> ''")
    return made(df, as_gene(F.col("g")), "participates_in_pathway", as_pathway(F.concat(F.lit("kegg_"), "p")), source, version, evidence(F.col("value"), gene=F.col("g"), kegg_gene_id=F.col("g0"), pathway=F.col("p"), query_gene=asked), 0.72, 0.75, max_rows)


def wikipathways(spark, path, source="WikiPathways", version="v1", query_gene="", max_rows=None) -> DataFrame:
    """A JSON document with an array under result or results; a broken document gives nothing."""
    text = spark.read.option("wholetext", True).text(path)
    row = "array<struct<id:string,wpid:string,identifier:string,name:string,title:string>>"
    doc = text.select(F.from_json("value", f"result {row}, results {row}").alias("d")).select(F.explode(F.coalesce("d.result", "d.results")).alias("x")).filter("x is not null")
    some = lambda *names: normalize_entity(F.coalesce(*(F.nullif(F.col(f"x.{n}"), F.lit("")) for n in names), F.lit("")))
    df = doc.select(F.to_json("x").alias("raw"), some("id", "wpid", "identifier").alias("i"), some("name", "title").alias("n")).filter("i <> ''")
    asked = F.upper(normalize_entity(F.lit(query_gene)))
    return made(df, as_gene(F.when(asked != "", asked).otherwise(F.lit("UNKNOWN"))), "participates_in_pathway", as_pathway(F.concat(F.lit("wp_"), "i")), source, version, evidence(F.substring("raw", 1, 500), query_gene=asked, pathway_id=F.col("i"), pathway_name=F.col("n")), 0.66, 0.7, max_rows)


def encode_eclip(spark, path, source="ENCODE", version="v1", max_rows=None) -> DataFrame:
    """One line about the file, then a header."""
    df = table(spark, path, skip=1)
    df = df.select(
        F.upper(normalize_entity(first_of(df, "Target of assay", "target.label", "target", "Target"))).alias("t"),
        normalize_entity(first_of(df, "Biosample summary", "Biosample term name", "biosample_ontology.term_name", "Biosample")).alias("b"),
        normalize_entity(first_of(df, "Accession", "accession")).alias("a")).filter("t <> ''")
    where = F.coalesce(F.nullif("b", F.lit("")), F.nullif("a", F.lit("")), F.lit("unknown"))
    told = {"target": F.col("t"), "biosample": F.col("b"), "accession": F.col("a")}
    return made(df, as_gene(F.col("t")), "supported_by_eclip", F.concat(F.lit("cell_context::"), where), source, version, evidence(F.to_json(F.struct(*(v.alias(k) for k, v in told.items()))), **told), 0.74, 0.78, max_rows)


def biogrid(spark, path, source="BioGRID", version="v1", max_rows=None) -> DataFrame:
    df = table(spark, path)
    side = lambda x: F.upper(normalize_entity(first_of(df, f"Official Symbol Interactor {x}", f"Systematic Name Interactor {x}")))
    own = df.select(side("A").alias("a"), side("B").alias("b"), first_of(df, "Organism ID Interactor A").alias("oa"), first_of(df, "Organism ID Interactor B").alias("ob"), normalize_entity(first_of(df, "Experimental System")).alias("m"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("raw"))
    own = own.filter(F.col("oa").isin("", HUMAN) & F.col("ob").isin("", HUMAN) & (F.col("a") != "") & (F.col("b") != ""))
    return made(own, as_gene(F.col("a")), "biogrid_interacts_with", as_gene(F.col("b")), source, version, evidence(F.substring("raw", 1, 500), left=F.col("a"), right=F.col("b"), method=F.col("m")), 0.76, 0.74, max_rows)


def signor(spark, path, source="SIGNOR", version="v1", max_rows=None) -> DataFrame:
    """Positional columns without a header; the effect decides the relation, a PubMed id the confidence."""
    raw = lambda i: F.trim(F.coalesce(F.get("f", F.lit(i)), F.lit("")))
    df = fields(spark, path, 9).filter(raw(11).isin("", HUMAN))
    low = lambda i: F.lower(normalize_entity(raw(i)))
    df = once(df, a=normalize_entity(raw(0)), x=low(1), b=normalize_entity(raw(4)), y=low(5), e=F.lower(at(8)), pmid=raw(17)).filter("a <> '' and b <> ''")
    up, down = contains_any(F.col("e"), ("up-regulates", "upregulates", "activat", "stimul", "expression")), contains_any(F.col("e"), ("down-regulates", "downregulates", "inhibit", "repress", "suppress"))
    rel = F.when(up, F.lit("activates")).when(down, F.lit("inhibits")).otherwise(F.lit("associated_with"))
    conf = F.when(up | down, F.when(F.col("pmid") != "", 0.9).otherwise(0.8)).otherwise(0.72)
    return made(df, typed_entity(F.col("a"), F.col("x")), rel, typed_entity(F.col("b"), F.col("y")), source, version, evidence(F.substring(F.array_join(F.slice("f", 1, 10), "\t"), 1, 500), effect=F.col("e"), pmid=F.col("pmid")), F.when(up | down, 0.88).otherwise(0.7), conf, max_rows)


def omnipath(spark, path, source="OmniPath", version="v1", max_rows=None) -> DataFrame:
    """Flags of stimulation and inhibition; one of them alone gives a sign. ``source`` wins over ``source_genesymbol``."""
    df = table(spark, path)
    yes = lambda *names: F.lower(first_of(df, *names)).isin("1", "true", "yes")
    own = df.select(F.upper(normalize_entity(first_of(df, "source", "source_genesymbol"))).alias("a"), F.upper(normalize_entity(first_of(df, "target", "target_genesymbol"))).alias("b"), yes("is_stimulation", "stimulation").alias("s"), yes("is_inhibition", "inhibition").alias("i"), yes("consensus_direction").alias("c"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("raw")).filter("a <> '' and b <> ''")
    rel = F.when(F.expr("s and not i"), F.lit("activates")).when(F.expr("i and not s"), F.lit("inhibits")).otherwise(F.lit("associated_with"))
    return made(own, as_gene(F.col("a")), rel, as_gene(F.col("b")), source, version, evidence(F.substring("raw", 1, 500), is_stimulation=F.col("s"), is_inhibition=F.col("i"), consensus_direction=F.col("c")), F.when(F.col("c"), 0.86).otherwise(0.78), F.when(F.col("c"), 0.87).otherwise(0.78), max_rows)


def ncbi_genes(spark, path, source="NCBI Gene", version="v1", max_rows=None) -> DataFrame:
    df = table(spark, path)
    own = df.select(first_of(df, "#tax_id", "tax_id").alias("x"), normalize_entity(first_of(df, "GeneID")).alias("i"), F.upper(normalize_entity(first_of(df, "Symbol"))).alias("s")).filter(F.col("x").isin("", HUMAN) & (F.col("i") != "") & (F.col("s") != ""))
    return made(own, as_gene(F.col("s")), "has_ncbi_gene_id", F.concat(F.lit("ncbi_gene::"), "i"), source, version, evidence(F.concat_ws("\t", "i", "s"), gene_id=F.col("i"), symbol=F.col("s")), 1.0, 0.95, max_rows)


def ensembl_gtf(spark, path, source="Ensembl", version="v1", max_rows=None) -> DataFrame:
    df = lines(spark, path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')").select("value", F.split("value", "\t").alias("f")).filter("size(f) >= 9 and f[2] = 'gene'")
    attr = lambda k: normalize_entity(F.regexp_extract(F.get("f", F.lit(8)), f'{k} "([^"]+)"', 1))
    df = df.withColumns({"i": attr("gene_id"), "s": F.upper(attr("gene_name"))}).filter("i <> '' and s <> ''")
    return made(df, as_gene(F.col("s")), "has_ensembl_gene_id", F.concat(F.lit("ensembl_gene::"), "i"), source, version, evidence(F.substring("value", 1, 500), symbol=F.col("s"), ensembl_gene=F.col("i")), 1.0, 0.95, max_rows)


#: Parser by the name that a manifest gives; users may add their own.
REGISTRY = {
    "reactome_pathway_relations": reactome_relations, "reactome_pathways": reactome_pathways, "reactome_uniprot_pathway": reactome_uniprot,
    "string_ppi": string_links, "string_protein_info": string_info, "string_protein_aliases": string_aliases, "pathway_commons_sif": pathway_commons,
    "npinter": npinter, "kegg_gene_pathway": kegg_links, "wikipathways_query": wikipathways, "encode_eclip": encode_eclip, "biogrid_tab3": biogrid,
    "signor": signor, "omnipath": omnipath, "ncbi_gene_info": ncbi_genes, "ensembl_gtf": ensembl_gtf,
}
