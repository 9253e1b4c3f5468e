"""Building graphs: dedup, normalisation, omics and cell graphs, text graphs, augmentation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import graph

TRIPLE_KEY = ("head", "relation", "tail", "source", "version")


def dedup_triples(triples: DataFrame, order: Sequence[str | Column], canonical: bool = False) -> DataFrame:
    """The first triple, in ``order``, of each (head, relation, tail, source, version); ``canonical`` compares canonical relations.

    min_by over a struct is an aggregate with a map-side part, so hot keys shrink before the shuffle. A row that meets
    others holds no column twice: the key's are left to the key, and an order by all others is the row itself.
    """
    key = {c: F.col(c) for c in TRIPLE_KEY} | ({"relation": rules.canonical_relation(F.col("relation"))} if canonical else {})
    held = [c for c in triples.columns if c not in TRIPLE_KEY or (canonical and c == "relation")]
    named = [c for c in order if isinstance(c, str)]
    if len(named) == len(order) and set(named) == set(held):  # the least row is the least of one struct
        least = F.min(F.struct(*named))
    else:
        least = F.min_by(F.struct(*held), F.struct(*order))
    rows = triples.withColumns({f"_{k}": v for k, v in key.items()}).groupBy(*(f"_{k}" for k in TRIPLE_KEY)).agg(least.alias("_r"))
    return rows.select(*(F.col(f"_r.{c}") if c in held else F.col(f"_{c}").alias(c) for c in triples.columns))


def gene_dictionary(triples: DataFrame, seeds: DataFrame, from_ids: bool = True) -> DataFrame:
    """(symbol): seeds, and with ``from_ids`` every id that says it is a gene."""
    out = seeds.select(F.upper(rules.normalize_entity(F.col("gene"))).alias("symbol"))
    if from_ids:
        ends = triples.select(F.explode(F.array("head", "tail")).alias("id")).filter(F.startswith(F.lower("id"), F.lit("gene::")))
        out = out.unionByName(ends.select(rules.entity_symbol(F.col("id")).alias("symbol")))
    return out.filter("symbol <> ''").distinct()


def canonicalise(triples: DataFrame, symbols: DataFrame | None) -> DataFrame:
    """Ends and relation in canonical form; raw_relation keeps the original.

    The rules of ends are many patterns, and an end stands in many triples: they are evaluated once for each distinct id,
    which meets the symbols there, and the forms are joined back. An id has one form, so a hub's triples can be split.
    """
    ids = triples.select(F.explode(F.array("head", "tail")).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    known = None
    if symbols is not None:
        marks = symbols.select(F.col("symbol").alias("_s"), F.lit(True).alias("_known"))
        ids = ids.withColumn("_u", rules.entity_symbol(F.col("_id"))).join(marks, F.col("_u") == F.col("_s"), "left")
        known = F.col("_known")
    forms = ids.select("_id", rules.canonical_entity(F.col("_id"), known).alias("_form"))
    out = triples
    for end in ("head", "tail"):
        out = out.join(forms, F.col(end) == F.col("_id"), "left").withColumn(end, F.coalesce("_form", F.lit(""))).drop("_id", "_form")
    return out.withColumn("raw_relation", F.col("relation")).withColumn("relation", rules.canonical_relation(F.col("relation")))


def normalise(triples: DataFrame, symbols: DataFrame | None = None, drop_loops: bool = False, min_weight: float = 0.0, min_confidence: float = 0.0) -> DataFrame:
    """Triples as graph rows: canonical ends and relation, types, flip of Cell edges, type gate, sign of neutral edges.

    The order is ends, relation, types, flip, gate. ``kind`` is 'edge', or 'name' for rows that name a pathway (their
    raw relation says so) and become node attributes. Empty ends go; self-loops and weak edges go only if asked.
    """
    c = canonicalise(triples, symbols).filter("head <> '' and tail <> ''")
    if drop_loops:
        c = c.filter("head <> tail")
    if min_weight > 0:
        c = c.filter(F.col("weight") >= min_weight)
    if min_confidence > 0:
        c = c.filter(F.col("confidence") >= min_confidence)
    kind = F.when(F.lower(rules.normalize_entity(F.col("raw_relation"))) == "pathway_name", F.lit("name")).otherwise(F.lit("edge"))
    # the ends are canonical here, so their prefix alone gives the type; deriving the form again would outgrow generated code
    t = c.withColumns({"head_type": rules.node_type(F.col("head"), "Cell"), "tail_type": rules.node_type(F.col("tail"), "Cell"), "kind": kind})
    turn = rules.flips(F.col("head_type"), F.col("tail_type"))
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    t = t.select(
        swap("head", "tail").alias("head"), F.when(turn, F.lit("belongs_to")).otherwise(F.col("relation")).alias("relation"), swap("tail", "head").alias("tail"),
        swap("head_type", "tail_type").alias("head_type"), swap("tail_type", "head_type").alias("tail_type"), "raw_relation", "kind",
        *(x for x in triples.columns if x not in ("head", "relation", "tail", "effect_sign")),
        rules.or_else(F.col("effect_sign"), rules.relation_sign(F.col("raw_relation"))).alias("effect_sign"))
    return t.withColumn("relation", rules.gate_relation(F.col("relation"), F.col("head_type"), F.col("tail_type")))


def node_updates(rows: DataFrame) -> DataFrame:
    """(name, pathway_name) of rows that name pathways."""
    return rows.filter("kind = 'name'").select(F.col("head").alias("name"), rules.pathway_name(F.col("tail")).alias("pathway_name")).groupBy("name").agg(F.max("pathway_name").alias("pathway_name"))


def upsert_nodes(old: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Nodes by name: the last type, any seed mark, the last pathway name that isn't empty."""
    rows = old.unionByName(new)
    named = F.when(F.coalesce("pathway_name", F.lit("")) != "", F.col(order))
    return rows.groupBy("name").agg(F.max_by("type", order).alias("type"), F.bool_or("is_seed").alias("is_seed"), F.max_by("pathway_name", named).alias("pathway_name"))


def top_per_sample(long: DataFrame, k: int, threshold: float | None = None, by: str = "sample", strict: bool = False) -> DataFrame:
    """The ``k`` largest values of each sample (0: all), NaN last, then the threshold; ties by entity."""
    value = F.nanvl("value", F.lit(None).cast("double"))
    out = long.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(value.desc_nulls_last(), "entity")))
    if k > 0:
        out = out.filter(F.col("place") <= k)
    if threshold is not None:
        out = out.filter(F.col("value") > threshold if strict else ~(F.col("value") < threshold))
    return out


def top_of_sparse(stored: DataFrame, entities: DataFrame, samples: DataFrame, k: int, threshold: float | None = None, strict: bool = False) -> DataFrame:
    """What ``top_per_sample`` gives for the dense table: (entity, sample, value, place), of which cells that are not stored
    are 0. ``entities`` and ``samples`` have column label, each once.

    Entities are numbered in their order. Of each sample the numbers of its stored values other than 0 leave gaps, and
    the zeros in them come in the entities' order: the first k zeros are cut out of the gaps from the left, k numbers a
    sample at most. Places follow: values above 0, then zeros, then those below, then NaN and null. So as many rows as
    are stored, and k a sample, are all there is.
    """
    if k <= 0:
        raise ValueError("all values of a dense table are as many as its cells: k must be above 0")
    numbered = graph.in_order(entities.select(F.col("label").alias("entity")), "entity")
    n = numbered.count()
    value = F.nanvl("value", F.lit(None).cast("double"))
    own = stored.select("entity", "sample", "value").filter(F.col("value").isNull() | (F.col("value") != 0)).join(numbered, "entity")
    by = Window.partitionBy("sample")
    ranked = own.withColumn("place", F.row_number().over(by.orderBy(value.desc_nulls_last(), "entity")))
    ranked = ranked.withColumns({"above": F.sum((value > 0).cast("int")).over(by), "all": F.count("*").over(by), "before": F.lag("i", 1, 0).over(by.orderBy("i")), "nth": F.row_number().over(by.orderBy("i"))})
    zeros = F.lit(n) - F.col("all")
    place = F.col("place") + F.when(value > 0, F.lit(0)).otherwise(zeros)
    held = ranked.filter(place <= k).select("entity", "sample", "value", place.cast("int").alias("place"))
    # gaps before each stored value and after the last one; of a gap the zeros before it are its number less the stored ones
    gaps = ranked.select("sample", "above", (F.col("before") + 1).alias("a"), (F.col("i") - 1).alias("b"), (F.col("before") - F.col("nth") + 1).alias("passed"))
    last = ranked.groupBy("sample").agg(F.max("i").alias("i"), F.max("all").alias("all"), F.max("above").alias("above"))
    ends = samples.select(F.col("label").alias("sample")).join(last, "sample", "left").na.fill(0, ["i", "all", "above"])
    gaps = gaps.unionByName(ends.select("sample", F.coalesce("above", F.lit(0)).alias("above"), (F.col("i") + 1).alias("a"), F.lit(n).alias("b"), (F.col("i") - F.col("all")).alias("passed")))
    room = F.lit(k) - F.coalesce("above", F.lit(0)) - F.col("passed")
    some = gaps.withColumn("b", F.least("b", F.col("a") + room - 1)).filter(F.col("b") >= F.col("a"))
    filled = some.select("sample", F.coalesce("above", F.lit(0)).alias("above"), "passed", F.posexplode(F.sequence("a", "b")).alias("at", "i"))
    filled = filled.join(numbered, "i").select("entity", "sample", F.lit(0.0).alias("value"), (F.col("above") + F.col("passed") + F.col("at") + 1).cast("int").alias("place"))
    out = held.unionByName(filled)
    if threshold is not None:
        out = out.filter(F.col("value") > threshold if strict else ~(F.col("value") < threshold))
    return out


def omics_triples(long: DataFrame, spec: DataFrame, metadata: DataFrame | None = None, targets: DataFrame | None = None, strict_nan: bool = False) -> DataFrame:
    """Triples of a long omics table (name, entity, sample, value) by its specs: value edges, sample -> cell line and condition, targets.

    ``strict_nan`` lets a missing value through as weight 0; by default it is dropped.
    """
    rows = long.join(spec, "name")
    usable = F.col("value").isNotNull() & ~(F.col("value") < F.coalesce("min_value", F.lit(0.0)))
    if not strict_nan:
        usable = usable & ~F.isnan("value")
    place = F.row_number().over(Window.partitionBy("name", "sample").orderBy(F.nanvl("value", F.lit(None).cast("double")).desc_nulls_last(), "entity"))
    rows = rows.withColumn("place", place).filter((F.coalesce("top_k", F.lit(0)) <= 0) | (F.col("place") <= F.col("top_k"))).filter(usable)
    prefix = rules.modality_prefix(F.col("modality"))
    base = rules.normalize_entity(F.col("entity"))
    entity = F.concat(prefix, F.lit("::"), F.when(prefix == "protein", base).otherwise(F.upper(base)))
    sample = F.concat(F.lit("sample::"), rules.normalize_entity(F.col("sample")))
    weight = F.when(F.isnan("value"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value"))))
    conf = F.coalesce("confidence", F.lit(0.7))
    made = rows.select(sample.alias("head"), rules.modality_relation(F.col("modality")).alias("relation"), entity.alias("tail"), "source", "version", weight.alias("weight"), conf.alias("confidence"))
    if metadata is not None:
        samples = long.select("name", "sample").distinct().join(spec, "name").join(metadata, "sample")
        for column, relation, head in (("cell_line", "belongs_to", "Cell::"), ("condition", "has_condition", "condition::")):
            some = samples.filter(F.coalesce(column, F.lit("")) != "")
            made = made.unionByName(some.select(sample.alias("head"), F.lit(relation).alias("relation"), F.concat(F.lit(head), rules.normalize_entity(F.col(column))).alias("tail"), "source", "version", F.lit(1.0).alias("weight"), F.lit(0.9).alias("confidence")))
    if targets is not None:
        t = targets.join(spec.filter(rules.modality_prefix(F.col("modality")) == "mirna"), "name")
        made = made.unionByName(t.select(F.concat(F.lit("mirna::"), F.upper(rules.normalize_entity(F.col("mirna")))).alias("head"), F.lit("regulates").alias("relation"), rules.as_gene(F.col("gene")).alias("tail"), "source", "version", F.lit(0.7).alias("weight"), conf.alias("confidence")))
    return made


def cell_graph(long: DataFrame, perturbations: DataFrame, top_genes: int = 20, threshold: float = 0.5) -> DataFrame:
    """Edges of an expression table (entity, cell, value): perturbation <-> cell and gene <-> cell, weights as measured."""
    cells = long.select("cell").distinct().join(perturbations.select(F.col("cell_id").alias("cell"), "perturbation"), "cell", "left").withColumn("perturbation", F.coalesce("perturbation", F.lit("unknown")))
    edge = lambda h, r, t, w, c: F.struct(h.alias("head"), F.lit(r).alias("relation"), t.alias("tail"), w.alias("weight"), F.lit(c).alias("confidence"))
    cell, pert, gene = F.concat(F.lit("cell::"), "cell"), rules.query_node(F.col("perturbation")), F.concat(F.lit("gene::"), "entity")
    a = cells.select(F.explode(F.array(edge(pert, "belongs_to", cell, F.lit(1.0), 0.9), edge(cell, "associated_with", pert, F.lit(0.9), 0.8))).alias("e"))
    top = top_per_sample(long, top_genes, threshold, by="cell", strict=True)
    b = top.select(F.explode(F.array(edge(gene, "belongs_to", cell, F.col("value"), 0.9), edge(cell, "associated_with", gene, F.col("value"), 0.85))).alias("e"))
    return a.select("e.*").unionByName(b.select("e.*")).withColumn("effect_sign", F.lit(0.0))


def cell_profiles(long: DataFrame, perturbations: DataFrame, top_genes: int = 10) -> DataFrame:
    """(cell, profile): a text about each cell of an expression table (entity, cell, value): perturbation and first genes."""
    top = top_per_sample(long, top_genes, by="cell")
    genes = top.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("place", "entity"))).alias("g"))  # ``top_genes`` at most
    named = genes.join(perturbations.select(F.col("cell_id").alias("cell"), "perturbation"), "cell", "left")
    listed = F.array_join(F.transform("g", lambda x: x["entity"]), ", ")
    return named.select("cell", F.concat(F.lit("Cell "), "cell", F.lit(" under "), F.coalesce("perturbation", F.lit("unknown")), F.lit(". Most expressed genes: "), listed, F.lit(".")).alias("profile"))


def collectors(edges: DataFrame, seeds: DataFrame, max_affected: int = 120) -> tuple[DataFrame, DataFrame]:
    """What augmentation gathers while edges stream in, as tables that a later batch can be merged with: the seeds'
    heaviest neighbours (seed, other, relation, weight, confidence) and strengths (gene, pathway, strength)."""
    seed = seeds.select(F.concat(F.lit("gene::"), F.upper(rules.normalize_entity(F.col("gene")))).alias("seed")).distinct()
    near = graph.incident(edges).select(F.col("node").alias("seed"), "other", "relation", "weight", "confidence").join(seed, "seed", "left_semi").filter("other <> seed")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("weight"), "other", "relation", F.desc("confidence")))
    return near.withColumn("place", place).filter(F.col("place") <= max_affected).drop("place"), gene_pathway_strength(edges)


def merge_collectors(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], max_affected: int = 120) -> tuple[DataFrame, DataFrame]:
    """Both tables of two parts of an input: the heaviest of all neighbours, the best strength of each pair."""
    near = old[0].unionByName(new[0])
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("weight"), "other", "relation", F.desc("confidence")))
    return near.withColumn("place", place).filter(F.col("place") <= max_affected).drop("place"), old[1].unionByName(new[1]).groupBy("gene", "pathway").agg(F.max("strength").alias("strength"))


def text_graph(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokens: int = 100) -> DataFrame:
    """Chains of the distinct ones of each text's first ``tokens`` tokens: id, position, head, tail, types, weight, confidence."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "")
    own = docs.select(F.col(id_col), F.array_distinct(F.slice(words, 1, tokens)).alias("w")).filter(F.size("w") > 1)
    pairs = own.select(id_col, F.posexplode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("head"), F.expr("slice(w, 2, size(w) - 1)").alias("tail"))).alias("position", "p"))
    return pairs.select(id_col, "position", "p.head", "p.tail", rules.token_node_type(F.col("p.head")).alias("head_type"), rules.token_node_type(F.col("p.tail")).alias("tail_type"), F.lit(0.2).alias("weight"), F.lit(0.3).alias("confidence"))


def gene_pathway_strength(edges: DataFrame) -> DataFrame:
    """(gene, pathway, strength): the best mean of weight and confidence of participates edges either way."""
    is_g, is_p = (lambda c: F.startswith(c, F.lit("gene::"))), (lambda c: F.startswith(c, F.lit("pathway::")))
    ahead = is_g(F.col("head")) & is_p(F.col("tail"))
    back = is_g(F.col("tail")) & is_p(F.col("head"))
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("weight") + F.col("confidence")) / 2))
    p = edges.filter(ahead | back).filter(rules.canonical_relation(F.col("relation")) == "participates")  # long rules of few edges only
    ends = p.select(F.when(ahead, F.col("head")).otherwise(F.col("tail")).alias("gene"), F.when(ahead, F.col("tail")).otherwise(F.col("head")).alias("pathway"), strength.alias("strength"))
    return ends.groupBy("gene", "pathway").agg(F.max("strength").alias("strength"))


def strongest(strong: DataFrame, n: int) -> DataFrame:
    """Those of ``strong`` (gene, pathway, strength) that can be among the ``n`` best of a pathway for any partner.

    For a partner of strength t, the square root of strength times t never falls where strength rises, and is equal only
    for strengths that are equal but for their last digits. So n genes by name of each strength are enough, and strengths
    down to that of a pathway's n-th gene, a hair below included. Tasks cut their own rows before they meet.
    """
    level = F.row_number().over(Window.partitionBy("pathway", "strength").orderBy("gene"))
    some = graph.cut(strong.withColumn("_nth", level).filter(F.col("_nth") <= n).drop("_nth"))
    place = F.row_number().over(Window.partitionBy("pathway").orderBy(F.desc("strength"), "gene"))
    first = some.withColumn("_nth", place).filter(F.col("_nth") <= n)
    floors = first.groupBy("pathway").agg((F.min("strength") * (1 - 1e-12)).alias("_floor"))
    return some.join(floors, "pathway").filter(F.col("strength") >= F.col("_floor")).select(*strong.columns)


def shared_pathway(edges: DataFrame, seed_nodes: DataFrame, min_edge: float = 0.45, min_score: float = 0.5, cap: int = 80) -> DataFrame:
    """(seed, other, pathway, score, place): genes that share a pathway with a seed, best pathway each, ``cap`` per seed.

    A gene among a seed's ``cap`` best is among the ``cap`` best of the pathway that it has its score by, so seeds meet a
    pathway's ``strongest`` genes (one more, for the seed itself) and not all of its members: pairs grow with the seeds.
    """
    strong = graph.cut(gene_pathway_strength(edges).filter(F.col("strength") >= min_edge))
    mine = strong.join(seed_nodes.select(F.col("seed").alias("gene")), "gene", "left_semi").select(F.col("gene").alias("seed"), "pathway", F.col("strength").alias("s1"))
    best_of = strongest(strong, cap + 1) if min_edge > 1e-6 else strong  # products of less could be equal by underflow
    pairs = mine.join(best_of.select(F.col("gene").alias("other"), "pathway", F.col("strength").alias("s2")), "pathway").filter("seed <> other")
    scored = pairs.withColumn("score", F.least(F.lit(1.0), F.sqrt(F.col("s1") * F.col("s2")))).filter(F.col("score") >= min_score)
    best = scored.groupBy("seed", "other").agg(F.max_by(F.struct("pathway", "score"), F.struct("score", F.col("pathway"))).alias("b")).select("seed", "other", "b.*")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "other"))
    return best.withColumn("place", place).filter(F.col("place") <= cap)


def augment(edges: DataFrame, seeds: DataFrame, methods: Sequence[str] = rules.METHODS, max_affected: int = 120, max_shared: int = 80, min_edge: float = 0.45, min_score: float = 0.5) -> DataFrame:
    """Derived perturbation triples of each seed gene (column gene) and method: head, relation, tail, weight, confidence.

    A method edge, a target edge, one edge per neighbour of the seed (heaviest first, capped), and two-hop edges to genes
    that share a pathway. The first of equal (head, relation, tail) stays. Ranks are per seed; methods multiply after.
    """
    seed = seeds.select(F.upper(rules.normalize_entity(F.col("gene"))).alias("g")).filter("g <> ''").distinct().withColumn("seed", F.concat(F.lit("gene::"), "g"))
    seed = graph.cut(seed)  # known to be few before edges meet it
    every = lambda df: df.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    node = rules.perturbation_node(F.col("method"), F.col("g"))
    fixed = every(seed).select(node.alias("head"), F.explode(F.array(
        F.struct(F.lit("has_perturbation_method").alias("relation"), rules.method_node(F.col("method")).alias("tail"), F.lit(0.95).alias("weight"), F.lit(0.9).alias("confidence")),
        F.struct(F.lit("targets_gene").alias("relation"), F.col("seed").alias("tail"), F.lit(1.0).alias("weight"), F.lit(0.92).alias("confidence")))).alias("e")).select("head", "e.*")
    # both ways round: an edge between two seeds counts for each
    out = edges.select(F.col("head").alias("seed"), F.col("tail").alias("other"), "relation", "weight", "confidence", F.lit(0).alias("way"))
    back = edges.filter("head <> tail").select(F.col("tail").alias("seed"), F.col("head").alias("other"), "relation", "weight", "confidence", F.lit(1).alias("way"))
    ok = F.lit(False)
    for p in ("gene::", "protein::", "pathway::", "Cell::"):
        ok = ok | F.startswith("other", F.lit(p))
    near = out.unionByName(back).join(seed, "seed").filter(ok & (F.col("other") != F.col("seed")))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("weight"), "way", "other", "relation", F.desc("confidence")))
    near = near.withColumn("place", place).filter(F.col("place") <= max_affected)
    scaled = lambda c: F.greatest(F.lit(0.2), F.least(F.lit(1.0), rules.or_else(F.col(c), 0.6) * 0.85))
    relation = F.concat(F.lit("affects_"), rules.canonical_relation(F.col("relation")))
    # equal triples of a seed meet before methods multiply them; heads of plain methods can't be equal
    first = near.groupBy("g", relation.alias("relation"), "other").agg(F.min_by(F.struct("weight", "confidence"), "place").alias("w"), F.min("place").alias("o"))
    affects = every(first).select(node.alias("head"), "relation", F.col("other").alias("tail"), scaled("w.weight").alias("weight"), scaled("w.confidence").alias("confidence"), "o")
    if len(set(methods)) < len(methods) or not all(re.fullmatch("[A-Z0-9]+", m) for m in methods):
        affects = affects.groupBy("head", "relation", "tail").agg(F.min_by(F.struct("weight", "confidence"), "o").alias("w")).select("head", "relation", "tail", "w.*")
    affects = affects.drop("o")
    hop2 = shared_pathway(edges, seed, min_edge, min_score, max_shared).join(seed, "seed")
    lift = lambda base: F.least(F.lit(1.0), F.lit(base) * (F.lit(0.7) + F.lit(0.6) * F.col("score")))
    shared = every(hop2).select(node.alias("head"), F.lit("affects_shared_pathway_2hop").alias("relation"), F.col("other").alias("tail"), lift(0.58).alias("weight"), lift(0.62).alias("confidence"))
    return fixed.unionByName(affects).unionByName(shared)
