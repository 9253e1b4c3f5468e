"""Validation, quality statistics and experiments over the graph tables."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import graph

REQUIRED = ("source", "version", "evidence")


# --- validation

def bad_relations(edges: DataFrame, allowed: Sequence[str] = rules.RELATIONS) -> DataFrame:
    """(relation, n) of relations that aren't allowed."""
    return edges.filter(~F.coalesce(F.col("relation").isin(*allowed), F.lit(False))).groupBy("relation").agg(F.count("*").alias("n"))


def missing_properties(edges: DataFrame, required: Sequence[str]) -> DataFrame:
    """(property, n): edges where a required property is null or blank. One pass over the edges."""
    blank = lambda c: F.sum((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").cast("long"))
    one = edges.agg(*(F.coalesce(blank(c), F.lit(0)).alias(c) for c in required))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.col(c).alias("n")) for c in required))).alias("x")).select("x.*")


def unexpected_columns(edges: DataFrame, allowed: Sequence[str]) -> list[str]:
    return sorted(set(edges.columns) - set(allowed))


def seed_differences(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(gene, problem): seeds that no node marks, and marked nodes that are no seed."""
    want = seeds.select(F.upper(rules.normalize_entity(F.col("gene"))).alias("gene")).distinct()
    have = nodes.filter("is_seed").select(rules.gene_token(F.col("name")).alias("gene")).distinct()
    return want.subtract(have).withColumn("problem", F.lit("missing")).unionByName(have.subtract(want).withColumn("problem", F.lit("extra")))


def duplicate_names(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def validate(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, required: Sequence[str]) -> DataFrame:
    """(check, problems): one row per check; 0 is passed."""
    total = lambda name, df, n: df.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("problems")).select(F.lit(name).alias("check"), "problems")
    parts = [total("relations", bad_relations(edges), F.col("n")), total("properties", missing_properties(edges, required), F.col("n")), total("seeds", seed_differences(nodes, seeds), F.lit(1)), total("names", duplicate_names(nodes), F.lit(1))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exit_code(checks: DataFrame) -> int:
    """0 if all checks pass, 1 if one doesn't, 2 without any check."""
    one = checks.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("problems") > 0).cast("int")), F.lit(0)).alias("bad")).first()
    return 2 if not one["n"] else int(one["bad"] > 0)


# --- structure

def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def source_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, edges, nodes): rows of both tables by source; one of the two may lack it."""
    e = edges.groupBy("source").agg(F.count("*").alias("edges"))
    n = nodes.groupBy("source").agg(F.count("*").alias("nodes"))
    return e.join(n, "source", "full").select("source", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("nodes", F.lit(0)).alias("nodes"))


def entities_per_source(edges: DataFrame) -> DataFrame:
    return edges.select("source", F.explode(F.array("head", "tail")).alias("name")).groupBy("source").agg(F.count_distinct("name").alias("entities"), (F.count("*") / 2).cast("long").alias("edges"))


def degrees(edges: DataFrame) -> DataFrame:
    """(name, in_degree, out_degree, degree) of every endpoint; one shuffle of pre-aggregated ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("head").alias("name"), F.lit(1).alias("o")), F.struct(F.col("tail").alias("name"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("name").agg(F.sum(1 - F.col("o")).alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def order_statistics(df: DataFrame, column: str) -> DataFrame:
    """n, min, mean, median (element n//2), p99 (element min(n-1, int(.99 n))), max: by index in the sorted values.

    Values are counted first, so the running position is over distinct values, not rows.
    """
    hist = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    run = hist.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    total = df.agg(F.count("*").alias("n"), F.min(column).alias("least"), F.avg(column).alias("mean"), F.max(column).alias("most"))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    return run.crossJoin(total).groupBy("n", "least", "mean", "most").agg(at(F.floor(F.col("n") / 2)).alias("median"), at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.99))).alias("p99")).select("n", "least", "mean", "median", "p99", "most")


def density(edges: DataFrame) -> DataFrame:
    s = graph.stats(edges)
    return s.select("nodes", "edges", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0)).alias("density"), F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(F.lit(0.0)).alias("average_degree"))


def multi_omics(edges: DataFrame) -> DataFrame:
    """modalities, samples, omics edges and the integration score."""
    kinds = ("expresses", "has_cnv", "has_methylation", "has_protein_abundance", "regulates")
    is_omics = F.col("relation").isin(*kinds)
    one = edges.agg(F.count_distinct(F.when(is_omics, F.col("relation"))).alias("modalities"), F.sum(is_omics.cast("long")).alias("omics_edges"), F.count("*").alias("edges"), F.count_distinct(F.when(F.startswith("head", F.lit("sample::")), F.col("head"))).alias("samples"))
    score = F.least(F.lit(1.0), F.col("modalities") / 5) * F.least(F.lit(1.0), F.col("samples") / 100) * (F.col("omics_edges") / F.col("edges"))
    return one.select("modalities", "samples", "omics_edges", score.alias("score"))


def semantics(edges: DataFrame) -> DataFrame:
    """sources, signed edges by sign (split at 0.1), share of neutral edges."""
    s = F.col("effect_sign")
    n = lambda c: F.sum(c.cast("long"))
    return edges.agg(F.count_distinct("source").alias("sources"), n(s > 0.1).alias("positive"), n(s < -0.1).alias("negative"), n((s <= 0.1) & (s >= -0.1)).alias("neutral"))


def evidence_coverage(edges: DataFrame) -> DataFrame:
    """edges, with evidence, mean evidence length, share with a structured part; needs column evidence."""
    e = F.coalesce(F.col("evidence"), F.lit(""))
    return edges.agg(F.count("*").alias("edges"), F.sum((e != "").cast("long")).alias("with_evidence"), F.avg(F.when(e != "", F.length(e))).alias("mean_length"), F.avg(F.get_json_object(e, "$.structured").isNotNull().cast("double")).alias("structured"))


def histogram(edges: DataFrame, column: str = "weight", bins: int = 10) -> DataFrame:
    v = F.col(column)
    return edges.filter(v.isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor(v * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))


def histogram_summary(edges: DataFrame, column: str = "weight") -> DataFrame:
    """n, missing, least and most of a column."""
    v = F.col(column)
    return edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(v.isNull().cast("long")), F.lit(0)).alias("missing"), F.min(v).alias("least"), F.max(v).alias("most"))


def perturbation_coverage(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds, seeds with a perturbation node, perturbation nodes and edges."""
    p = edges.filter(F.startswith("head", F.lit("pathway::perturbation::")))
    covered = p.filter("relation = 'targets_gene'").select(rules.gene_token(F.col("tail")).alias("gene")).distinct()
    want = seeds.select(F.upper("gene").alias("gene")).distinct()
    return p.agg(F.count_distinct("head").alias("nodes"), F.count("*").alias("edges")).crossJoin(want.agg(F.count("*").alias("seeds"))).crossJoin(want.join(covered, "gene", "left_semi").agg(F.count("*").alias("covered")))


def quality_score(nodes: int, edges: int, types: int, relations: int, modalities: int, omics_edges: int, sources: int, structured: float, direction: float, evidence: float, isolated: float, density_: float, seed_coverage: float, perturbations: int, consistent: float, orphan: float) -> dict[str, float]:
    """The six parts and their sum, each at one decimal and under its cap."""
    log = lambda n: math.log10(max(1, n))
    # Points, caps and the sizes that earn them.
    parts = {
        "structure": min(25.0, 8 * log(nodes) / 5 + 8 * log(edges) / 6 + 5 * types / 8 + 4 * relations / 15),
        "omics": min(20.0, 10 * modalities / 5 + 10 * min(1, omics_edges / 50_000)),
        "semantic": min(15.0, 5 * sources / 13 + 4 * structured + 3 * direction + 3 * evidence),
        "connectivity": max(2.0, min(20.0, 12 * (1 - isolated) + 8 * min(1, density_ * 1e7))),
        "perturbation": min(15.0, 10 * seed_coverage + 5 * min(1, perturbations / 50)),
        "consistency": min(5.0, 3 * consistent + 2 * (1 - orphan)),
    }
    parts = {k: round(v, 1) for k, v in parts.items()}
    return parts | {"total": round(sum(parts.values()), 1)}


def quality_measures(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row with what ``quality_score`` takes, from the tables: one pass over the edges, one over the nodes, and joins for
    isolated nodes and seeds. ``edges`` may lack evidence, which then counts as absent."""
    own = edges if "evidence" in edges.columns else edges.withColumn("evidence", F.lit(None).cast("string"))
    own = graph.with_evidence_flags(own)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    of_edges = own.agg(
        F.count("*").alias("edges"), F.count_distinct("relation").alias("relations"), F.count_distinct("source").alias("sources"),
        n(F.col("is_structured")).alias("structured"), n(F.abs("effect_sign") > 0.1).alias("signed"), n(F.length(F.coalesce("evidence", F.lit(""))) > 2).alias("told"),
        (n(blank(F.col("relation"))) + n(blank(F.col("source")))).alias("missing"))
    perturbation = F.startswith("name", F.lit("pathway::perturbation::"))
    of_nodes = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("type").alias("types"), n(perturbation).alias("perturbations"))
    want = seeds.select(F.upper("gene").alias("gene")).distinct()
    have = nodes.filter("type = 'gene'").select(F.upper(rules.gene_token(F.col("name"))).alias("gene")).distinct()
    of_seeds = want.agg(F.count("*").alias("seeds")).crossJoin(want.join(have, "gene", "left_semi").agg(F.count("*").alias("found")))
    alone = graph.isolated(nodes, edges).agg(F.count("*").alias("alone"))
    one = of_edges.crossJoin(of_nodes).crossJoin(of_seeds).crossJoin(alone).crossJoin(multi_omics(edges).select("modalities", F.coalesce("omics_edges", F.lit(0)).alias("omics_edges")))  # one row each
    share = lambda part, whole, digits=4: F.round(part / F.greatest(F.lit(1), whole), digits)
    edge, node = F.col("edges"), F.col("nodes")
    return one.select(
        "nodes", "edges", "types", "relations", "modalities", "omics_edges", "sources", share(F.col("structured"), edge).alias("structured"),
        share(F.col("signed"), edge).alias("direction"), share(F.col("told"), edge).alias("evidence"), share(F.col("alone"), node).alias("isolated"),
        share(edge, node * (node - 1), 8).alias("density_"), share(F.col("found"), F.col("seeds")).alias("seed_coverage"), "perturbations",
        ((edge - F.col("missing")) / F.greatest(F.lit(1), edge)).alias("consistent"), share(F.col("alone"), node).alias("orphan"))


def quality(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(part, score): the quality score of a graph. Only the one row of measures comes to the driver."""
    measures = quality_measures(edges, nodes, seeds).first().asDict()
    return edges.sparkSession.createDataFrame(list(quality_score(**measures).items()), "part string, score double")


def unexpected_keys(rows: DataFrame, properties: str, allowed: Sequence[str]) -> DataFrame:
    """(key, n) of keys in a column of JSON objects that aren't allowed; what is no object has none."""
    keys = rows.select(F.explode(F.json_object_keys(properties)).alias("key"))
    return keys.filter(~F.col("key").isin(*allowed)).groupBy("key").agg(F.count("*").alias("n"))


# --- experiments

def hop_breakdown(edges: DataFrame) -> DataFrame:
    """Per seed target of perturbation nodes: direct, two-hop and all edges."""
    p = edges.filter(F.startswith("head", F.lit("pathway::perturbation::")))
    gene = F.regexp_replace("head", "^pathway::perturbation::[^_]+_", "")
    two = F.col("relation") == "affects_shared_pathway_2hop"
    direct = F.startswith("relation", F.lit("affects_")) & ~two
    n = lambda c: F.sum(c.cast("long"))
    return p.groupBy(gene.alias("gene")).agg(n(direct).alias("direct"), n(two).alias("two_hop"), F.count("*").alias("total"))


def per_node_by_relation(edges: DataFrame) -> DataFrame:
    each = edges.groupBy("head", "relation").agg(F.count("*").alias("n"))
    return each.groupBy("relation").agg(F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def relation_targets(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation", rules.node_type(F.col("tail")).alias("tail_type")).agg(F.count("*").alias("n"))


def degree_terciles(edges: DataFrame) -> DataFrame:
    return degrees(edges).filter(F.startswith("name", F.lit("gene::"))).agg(F.expr("percentile_disc(0.33) WITHIN GROUP (ORDER BY degree)").alias("low"), F.expr("percentile_disc(0.67) WITHIN GROUP (ORDER BY degree)").alias("high"))


def stratified_genes(edges: DataFrame, seeds: DataFrame, n: int = 200, skip: int = 0) -> DataFrame:
    """(name): a third of ``n`` from each tercile of degree by name, seeds always; sorted and cut to n."""
    genes = degrees(edges).filter(F.startswith("name", F.lit("gene::")))
    seed = seeds.select(F.concat(F.lit("gene::"), F.upper("gene")).alias("name")).distinct()
    bounds = degree_terciles(edges)
    level = F.when(F.col("degree") <= F.col("low"), 0).when(F.col("degree") <= F.col("high"), 1).otherwise(2)
    rows = genes.crossJoin(bounds).select("name", level.alias("level")).join(seed, "name", "left_anti")
    out = seed.join(genes.select("name"), "name", "left_semi")
    for k in range(3):
        out = out.unionByName(rows.filter(F.col("level") == k).orderBy("name").offset(skip).limit(n // 3 + 10).select("name"))
    return out.orderBy("name").limit(n)


def source_contribution(edges: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Per source: mean share of its edges in the degree of genes that have any, 95 % half-width (population), genes covered."""
    ends = graph.incident(edges.select("head", "tail", "source")).filter(F.startswith("node", F.lit("gene::")))
    if genes is not None:
        ends = ends.join(genes.select(F.col("name").alias("node")), "node", "left_semi")
    each = ends.groupBy("node", "source").agg(F.count("*").alias("n"))
    degree = each.groupBy("node").agg(F.sum("n").alias("d"))
    r = each.join(degree, "node").withColumn("r", F.col("n") / F.col("d"))
    return r.groupBy("source").agg(F.avg("r").alias("mean"), (1.96 * F.stddev_pop("r") / F.sqrt(F.count("*"))).alias("ci95"), F.count("*").alias("coverage"))


def two_hop_paths(edges: DataFrame, origins: DataFrame, via: Sequence[str] = ("protein", "pathway")) -> DataFrame:
    """(origin, via_type, paths): undirected gene - protein or pathway - gene paths to another gene, counted and not listed.

    Edges are counted per (gene, middle) first; paths to other genes through a middle are its edges to genes less the origin's own.
    """
    keep = F.lit(False)
    for v in via:
        keep = keep | F.startswith("other", F.lit(v + "::"))
    half = graph.incident(edges.select("head", "tail")).filter(F.startswith("node", F.lit("gene::")) & keep).groupBy("node", "other").agg(F.count("*").alias("n"))
    middle = half.groupBy("other").agg(F.sum("n").alias("all"))
    mine = half.join(origins.select(F.col("name").alias("node")), "node", "left_semi").join(middle, "other")
    return mine.groupBy(F.col("node").alias("origin"), rules.node_type(F.col("other")).alias("via_type")).agg(F.sum(F.col("n") * (F.col("all") - F.col("n"))).cast("long").alias("paths"))


def three_hop_paths(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, paths): gene - protein - protein - gene with another gene at the end, edges distinct, counted by join of counts.
    A protein's edge to itself is a bridge too, once."""
    ends = graph.incident(edges.select("head", "tail"))
    half = ends.filter(F.startswith("node", F.lit("gene::")) & F.startswith("other", F.lit("protein::"))).groupBy(F.col("node").alias("gene"), F.col("other").alias("p")).agg(F.count("*").alias("n"))
    bridge = ends.filter(F.startswith("node", F.lit("protein::")) & F.startswith("other", F.lit("protein::")) & ((F.col("node") != F.col("other")) | F.col("is_out"))).groupBy(F.col("node").alias("p"), F.col("other").alias("q")).agg(F.count("*").alias("m"))
    all_ = half.groupBy(F.col("p").alias("q")).agg(F.sum("n").alias("all"))
    mine = half.join(origins.select(F.col("name").alias("gene")), "gene", "left_semi")
    walks = mine.join(bridge, "p").groupBy("gene", "q").agg(F.sum(F.col("n") * F.col("m")).alias("w")).join(all_, "q")
    back = half.select("gene", F.col("p").alias("q"), F.col("n").alias("own"))
    return walks.join(back, ["gene", "q"], "left").groupBy(F.col("gene").alias("origin")).agg(F.sum(F.col("w") * (F.col("all") - F.coalesce("own", F.lit(0)))).cast("long").alias("paths"))


def perturbation_overlap(edges: DataFrame) -> DataFrame:
    """Pairs of perturbation nodes of one gene: Jaccard of what they affect, by co-occurrence counts."""
    hits = edges.filter(F.startswith("head", F.lit("pathway::perturbation::")) & F.startswith("relation", F.lit("affects_"))).select(F.regexp_replace("head", "^pathway::perturbation::[^_]+_", "").alias("gene"), "head", "tail").distinct()
    size = hits.groupBy("gene", "head").agg(F.count("*").alias("n"))
    both = hits.alias("a").join(hits.alias("b"), ["gene", "tail"]).filter("a.head < b.head").groupBy("gene", F.col("a.head").alias("a"), F.col("b.head").alias("b")).agg(F.count("*").alias("common"))
    pairs = size.alias("x").join(size.alias("y"), "gene").filter("x.head < y.head").select("gene", F.col("x.head").alias("a"), F.col("y.head").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    out = pairs.join(both, ["gene", "a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.select("gene", "a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def perturbation_sparsity(edges: DataFrame) -> DataFrame:
    """Per perturbation node: edges, affects edges and distinct targets by type."""
    p = edges.filter(F.startswith("head", F.lit("pathway::perturbation::")))
    hit = F.startswith("relation", F.lit("affects_"))
    of = lambda t: F.count_distinct(F.when(hit & (rules.node_type(F.col("tail")) == t), F.col("tail"))).alias(f"{t}s")
    return p.groupBy("head").agg(F.count("*").alias("edges"), F.sum(hit.cast("long")).alias("affects"), of("gene"), of("protein"), of("pathway"))


def modality_ablation(edges: DataFrame) -> DataFrame:
    """(relation, removed, retained): what leaving one relation out removes."""
    total = edges.agg(F.count("*").alias("all"))
    return counts_by(edges, "relation").crossJoin(total).select(F.col("value").alias("relation"), F.col("n").alias("removed"), ((F.col("all") - F.col("n")) / F.col("all")).alias("retained"))


def modality_coverage(edges: DataFrame, omics: Sequence[str] = ("expresses", "has_cnv", "has_methylation", "has_protein_abundance", "regulates")) -> DataFrame:
    """(relation, kind, edges, genes): edges of each relation and the distinct genes they touch; kind is omics or knowledge."""
    gene = F.when(F.startswith("tail", F.lit("gene::")), F.col("tail")).when(F.startswith("head", F.lit("gene::")), F.col("head"))
    kind = F.when(F.col("relation").isin(*omics), F.lit("omics")).otherwise(F.lit("knowledge"))
    return edges.groupBy("relation", kind.alias("kind")).agg(F.count("*").alias("edges"), F.count_distinct(gene).alias("genes"))


def coverage_by_kind(edges: DataFrame, omics: Sequence[str] = ("expresses", "has_cnv", "has_methylation", "has_protein_abundance", "regulates")) -> DataFrame:
    """(kind, genes, share): distinct genes with an edge of either kind, and their share of all genes."""
    ends = graph.incident(edges.select("head", "tail", "relation")).filter(F.startswith("node", F.lit("gene::")))
    kind = F.when(F.col("relation").isin(*omics), F.lit("omics")).otherwise(F.lit("knowledge"))
    each = ends.select("node", kind.alias("kind")).distinct()
    total = ends.agg(F.count_distinct("node").alias("all"))  # one row
    return each.groupBy("kind").agg(F.count("*").alias("genes")).crossJoin(total).select("kind", "genes", (F.col("genes") / F.col("all")).alias("share"))


def expression_from_edges(edges: DataFrame) -> DataFrame:
    """(entity, sample, value): the weight of each sample's expresses edge to a gene; of several the last by all edge columns."""
    e = edges.filter((F.col("relation") == "expresses") & F.startswith("head", F.lit("sample::")) & F.startswith("tail", F.lit("gene::")))
    last = e.groupBy("tail", "head").agg(F.max_by("weight", F.struct("source", "weight", "confidence")).alias("value"))
    return last.select(rules.gene_token(F.col("tail")).alias("entity"), F.substring("head", 9, 1 << 30).alias("sample"), "value")


def gene_means(long: DataFrame) -> DataFrame:
    """(entity, score): of a gene-effect table the mean over samples without missing values, then the least of rows of one symbol."""
    each = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("entity").agg(F.avg("value").alias("mean"))
    return each.groupBy(rules.strip_symbol(F.col("entity")).alias("entity")).agg(F.min("mean").alias("score"))


#: Genes of a class that one task pairs with a seed.
CLASS_PART = 250
#: Tasks that make the pairs, at most.
MAX_PARTS = 2_000


def pathway_baseline(edges: DataFrame, seed_nodes: DataFrame) -> DataFrame:
    """(seed, gene, common): pathways that a gene shares with a seed.

    Genes of equal pathways are a class; pathways in common are counted once a pair of classes. As many rows as there are
    pairs of a seed and a gene come out, none of them shuffled: seeds are sent to each part of a class of genes. There are as
    many tasks as parts, since what is sent is small for what is made of it.
    """
    p = edges.filter("relation = 'participates'").select(F.col("head").alias("gene"), F.col("tail").alias("pathway")).distinct()
    sets = graph.cut(p.groupBy("gene").agg(F.sort_array(F.collect_list("pathway")).alias("own")))
    mine = graph.cut(sets.join(seed_nodes.select(F.col("seed").alias("gene")), "gene", "left_semi").select(F.col("gene").alias("seed"), F.col("own").alias("of_seed")))
    classes = sets.groupBy("own").agg(F.ceil(F.count("*") / CLASS_PART).cast("int").alias("parts"))
    ours = mine.select("of_seed").distinct().select("of_seed", F.explode("of_seed").alias("pathway"))
    common = graph.cut(ours.join(classes.select("own", "parts", F.explode("own").alias("pathway")), "pathway").groupBy("of_seed", "own", "parts").agg(F.count("*").alias("common")))
    met = graph.cut(common.select("own", "parts").distinct())
    tasks = max(1, min(MAX_PARTS, met.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]))
    sent = mine.join(common, "of_seed").select("seed", "own", "common", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = sets.join(met, "own").select("own", "gene", F.pmod(F.xxhash64("gene"), F.col("parts")).cast("int").alias("part")).repartition(tasks, "own", "part")
    sent = sent.repartition(tasks, "own", "part")  # either side may be broadcast, the other is dealt out
    return sent.join(members, ["own", "part"]).filter("seed <> gene").select("seed", "gene", "common")


def pearson(x: str, y: str) -> Column:
    """Pearson's r, null where one side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(long: DataFrame, seeds: DataFrame, least: int = 10, zero_fill: bool = False) -> DataFrame:
    """(seed, entity, r): Pearson correlation over samples that both have, ``least`` at least.

    The long table joins the few seed rows by sample; nothing is pivoted. ``zero_fill`` counts samples that one of the
    two has, the other as 0.
    """
    v = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("entity", "sample").agg(F.max("value").alias("value"))
    mine = v.join(seeds.select(F.col("seed").alias("entity")), "entity", "left_semi").select(F.col("entity").alias("seed"), "sample", F.col("value").alias("y"))
    pairs = v.withColumnRenamed("value", "x").join(mine, "sample").filter("entity <> seed")
    s = pairs.groupBy("seed", "entity").agg(F.count("*").alias("n"), pearson("x", "y").alias("r"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    if not zero_fill:
        return s.filter((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r")).select("seed", "entity", "n", "r")
    own = v.groupBy("entity").agg(F.count("*").alias("nx"), F.sum("value").alias("ax"), F.sum(F.col("value") * F.col("value")).alias("axx"))
    j = s.join(own, "entity").join(own.select(F.col("entity").alias("seed"), F.col("nx").alias("ny"), F.col("ax").alias("ay"), F.col("axx").alias("ayy")), "seed")
    n = F.col("nx") + F.col("ny") - F.col("n")
    r = F.try_divide(F.col("sxy") - F.col("ax") * F.col("ay") / n, F.sqrt((F.col("axx") - F.col("ax") ** 2 / n) * (F.col("ayy") - F.col("ay") ** 2 / n)))
    return j.filter(n >= least).select("seed", "entity", n.alias("n"), r.alias("r")).filter(F.col("r").isNotNull() & ~F.isnan("r"))


def value_counts(df: DataFrame, column: str, partition: str | None = None) -> DataFrame:
    """(partition,) _v, _c, _upto: distinct values, how many rows have each, and how many rows have it or less.

    Without ``partition`` the values are dealt out by ranges: each range runs by itself and then adds what the ranges
    before it hold, a row a range. No task sees all values.
    """
    keys = [partition] if partition else []
    hist = df.groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    if partition:
        return hist.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    hist = graph.cut(hist.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()))
    sums = hist.groupBy("_part").agg(F.sum("_c").alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = F.sum("_c").over(Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumn("_inside", inside).join(F.broadcast(before), "_part").select("_v", "_c", (F.col("_inside") + F.col("_before")).alias("_upto"))


def mean_ranks(df: DataFrame, column: str, name: str, partition: str | None = None) -> DataFrame:
    """Average ranks, by counting equal values first."""
    ranks = value_counts(df, column, partition).withColumn(name, F.col("_upto") - (F.col("_c") - 1) / 2).drop("_c", "_upto")
    on = F.col(column) == F.col("_v")
    if not partition:
        return df.join(ranks, on).drop("_v")
    ranks = ranks.withColumnRenamed(partition, "_p")
    return df.join(ranks, on & (F.col(partition) == F.col("_p"))).drop("_v", "_p")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return mean_ranks(mean_ranks(df, x, "_rx"), y, "_ry").agg(pearson("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def mann_whitney(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """n1, n2, u (of the first group), z with tie correction and continuity, p (one-sided: the first group is less).

    Equal values are counted per group first, so only a row a value is ranked.
    """
    first = is_first.cast("long")
    per = df.groupBy(F.col(value).alias("v")).agg(F.sum(first).alias("a"), F.sum(1 - first).alias("b"))
    ranks = value_counts(df, value).select(F.col("_v").alias("v"), "_c", (F.col("_upto") - (F.col("_c") - 1) / 2).alias("r"))
    c = F.col("_c").cast("double")
    s = per.join(ranks, "v").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("r")).alias("s"), F.sum(c * c * c - c).alias("t"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("s") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    out = s.select("n1", "n2", u.alias("u"), F.try_divide(u - n1 * n2 / 2 + 0.5, spread).alias("z"))
    return out.withColumn("p", normal_below(F.col("z")))


def normal_below(z: Column) -> Column:
    """The share of the standard normal distribution below z, by the continued fraction of its tail (exact to nine decimals)."""
    x = F.abs(z)
    tail = x
    for k in range(40, 0, -1):
        tail = x + F.lit(float(k)) / tail
    far = F.exp(-x * x / 2) / (F.lit(math.sqrt(2 * math.pi)) * tail)
    near, term = F.lit(0.0), x
    for k in range(30):
        near = near + term
        term = term * x * x / (2 * k + 3)
    near = F.lit(0.5) - near * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    above = F.when(x > 3, far).otherwise(near)
    return F.when(z > 0, 1 - above).otherwise(above)


def top_k_accuracy(ranking: DataFrame, truth: DataFrame, k: int, threshold: float, least_hits: int = 5) -> DataFrame:
    """precision, recall and mean score of the first ``k`` of a ranking (entity, place) by truth (entity, score); zeros below ``least_hits``."""
    known = truth.groupBy("entity").agg(F.min("score").alias("score"))
    top = ranking.filter(F.col("place") <= k).join(known, "entity")
    good = F.col("score") < threshold
    total = known.agg(F.sum(good.cast("long")).alias("all_good"))
    s = top.agg(F.count("*").alias("hits"), F.sum(good.cast("long")).alias("good"), F.avg("score").alias("mean")).crossJoin(total)
    ok = F.col("hits") >= least_hits
    return s.select("hits", F.when(ok, F.col("good") / F.col("hits")).otherwise(0.0).alias("precision"), F.when(ok & (F.col("all_good") > 0), F.col("good") / F.col("all_good")).otherwise(0.0).alias("recall"), F.when(ok, F.col("mean")).otherwise(0.0).alias("mean"))


def latency_summary(samples: Sequence[float]) -> dict[str, float]:
    """min, max, mean, p99 (element min(n-1, int(.99 n))) of measured seconds."""
    v = sorted(samples)
    return {"min": v[0], "max": v[-1], "mean": sum(v) / len(v), "p99": v[min(len(v) - 1, int(len(v) * 0.99))]}


def subgraph_latencies(edges: DataFrame, queries: Sequence[tuple[str, str]], nodes: Sequence[int] = (50, 100, 200, 500, 1000), most: Sequence[int] = (100, 300, 500, 1000, 2000), repeats: int = 5) -> DataFrame:
    """(max_nodes, max_edges, node, relation, mean, p99): seconds that keyword sub-graphs take over a grid of sizes."""
    out = []
    for n in nodes:
        for m in most:
            for node, relation in queries:
                took = []
                for _ in range(repeats):
                    began = time.perf_counter()
                    graph.keyword_subgraph(edges, node, relation, max_nodes=n, max_edges=m).collect()  # ``m`` rows at most
                    took.append(time.perf_counter() - began)
                s = latency_summary(took)
                out.append((n, m, node, relation, s["mean"], s["p99"]))
    return edges.sparkSession.createDataFrame(out, "max_nodes int, max_edges int, node string, relation string, mean double, p99 double")


def prediction_accuracy(rankings: DataFrame, truth: DataFrame, k: int = 100, threshold: float = -0.5, least_hits: int = 5) -> DataFrame:
    """(method, seed, hits, precision, recall, mean) of several rankings (method, seed, entity, place) by truth (entity, score)."""
    known = truth.groupBy("entity").agg(F.min("score").alias("score"))
    good = F.col("score") < threshold
    total = known.agg(F.sum(good.cast("long")).alias("all_good"))  # one row
    top = rankings.filter(F.col("place") <= k).join(known, "entity")
    s = top.groupBy("method", "seed").agg(F.count("*").alias("hits"), F.sum(good.cast("long")).alias("good"), F.avg("score").alias("m")).crossJoin(total)
    ok = F.col("hits") >= least_hits
    return s.select("method", "seed", "hits", F.when(ok, F.col("good") / F.col("hits")).otherwise(0.0).alias("precision"), F.when(ok & (F.col("all_good") > 0), F.col("good") / F.col("all_good")).otherwise(0.0).alias("recall"), F.when(ok, F.col("m")).otherwise(0.0).alias("mean"))
