"""Graph reads: neighbourhoods, sub-graphs, ranked candidates, connectivity. All are DataFrame -> DataFrame.

``edges`` has head, relation, tail, weight, confidence, effect_sign and keeps parallel edges; ``nodes`` has name, type,
is_seed. Numbers that are null or 0 read as their defaults (weight 1, confidence 0.5, sign +1).
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules

# Defaults of the ranking.
MAX_HOPS, MIN_SCORE, DECAY, PATHWAY_BOOST = 3, 0.01, 0.78, 1.12
PREFIXES = ("gene::", "pathway::", "protein::")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the interpreter does
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share, removed when the driver's interpreter ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "/tmp/lattica-checkpoints"
    path = f"{shared.rstrip('/')}/lattica-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that what reads it twice makes it once."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *order: str, name: str = "i") -> DataFrame:
    """Numbers the rows 1, 2, 3, ... in column ``name``: range-sorted and written with their places; only the partitions' row
    counts are summed up in one task. Without ``order`` rows keep the order they are read in."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = cut(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_part", "_before", "_at")


def signal() -> Column:
    return F.greatest(F.lit(0.0), rules.or_else(F.col("weight"), 1.0) * rules.or_else(F.col("confidence"), 0.5))


def sign() -> Column:
    return rules.or_else(F.col("effect_sign"), 1.0)


def node_table(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    names = edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    typed = names.withColumn("type", rules.node_type(F.col("name")))
    if seeds is None:
        return typed.withColumn("is_seed", F.lit(False))
    marks = seeds.select(F.concat(F.lit("gene::"), F.upper(rules.normalize_entity(F.col("gene")))).alias("name")).distinct().withColumn("is_seed", F.lit(True))
    return typed.join(marks, "name", "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))


def with_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with head_type, tail_type, head_is_seed, tail_is_seed; unknown nodes are entities."""
    out = edges
    for side in ("head", "tail"):
        n = nodes.select(F.col("name").alias(side), F.col("type").alias(f"{side}_type"), F.col("is_seed").alias(f"{side}_is_seed"))
        out = out.join(n, side, "left")
    return out.withColumns({f"{s}_type": F.coalesce(f"{s}_type", F.lit("entity")) for s in ("head", "tail")} | {f"{s}_is_seed": F.coalesce(f"{s}_is_seed", F.lit(False)) for s in ("head", "tail")})


def neighbours(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    """Every out-edge of every node within ``depth - 1`` hops, each node expanded once: depth, head, relation, tail, signal, sign.

    A level is one equi-join of the frontier with the edges; nodes seen before leave the next frontier by an anti join.
    """
    spark = edges.sparkSession
    lean = edges.select("head", "relation", "tail", signal().alias("signal"), sign().alias("sign"))
    frontier = spark.createDataFrame([(node,)], "head string")
    seen, out = frontier, None
    for level in range(1, depth + 1):
        step = lean.join(frontier, "head").select(F.lit(level).alias("depth"), "head", "relation", "tail", "signal", "sign")
        out = step if out is None else out.unionByName(step)
        if level < depth:
            frontier = step.select(F.col("tail").alias("head")).distinct().join(seen, "head", "left_anti")
            frontier = cut(frontier)
            seen = seen.unionByName(frontier)
    return out


def around(edges: DataFrame, origins: DataFrame, hops: int) -> DataFrame:
    """The edges that walks of up to ``hops`` edges from ``origins`` (column origin) can take, a null apart.

    Heads are found forwards, a scan of the ends and a join a step; what no origin comes to isn't shuffled. For origins that
    are few beside the graph: with all nodes as origins it gives all edges.
    """
    seen = frontier = cut(origins.select(F.col("origin").alias("head")).filter("head is not null").distinct())
    for _ in range(1, hops):
        step = edges.select("head", "tail").join(frontier, "head", "left_semi").select(F.col("tail").alias("head")).filter("head is not null").distinct()
        frontier = cut(step.join(seen, "head", "left_anti"))
        seen = seen.unionByName(frontier)
    return edges.join(seen, "head", "left_semi")


def evidence_counts(edges: DataFrame, origins: DataFrame, depth: int = 3) -> DataFrame:
    """(origin, evidence): how many rows ``neighbours`` gives for each origin, without making them.

    Nodes without out-edges count nothing and aren't walked to. The others have numbers, and a node's neighbours are lists
    of numbers, one a count of out-edges and stretch of 1,024: what meets by origin is a list for each node on the way and
    not a row for each walk, and is shuffled once, by origin alone.
    """
    degree = in_order(edges.groupBy(F.col("head").alias("name")).agg(F.count("*").alias("n")), "name")
    degree = cut(degree.select("name", "n", "i"))
    arcs = edges.select("head", "tail").distinct().join(degree, F.col("tail") == F.col("name")).select("head", "n", "i")
    arcs = arcs.withColumn("part", F.floor(F.row_number().over(Window.partitionBy("head", "n").orderBy("i")) / 1024))
    lists = arcs.groupBy("head", "n", "part").agg(F.collect_list("i").alias("to"))  # 1,024 at most
    lists = cut(lists.join(degree.select(F.col("name").alias("head"), F.col("i").alias("node")), "head").select("node", "n", "to"))
    start = origins.select("origin").distinct().join(degree, F.col("origin") == F.col("name"))
    found = start.select("origin", "n", F.array("i").alias("to"))
    seen = frontier = start.select("origin", F.col("i").alias("node"))
    for level in range(1, depth):
        step = frontier.join(lists, "node").select("origin", "n", "to")
        if level < depth - 1:
            step = cut(step)
            frontier = cut(step.select("origin", F.explode("to").alias("node")).distinct().join(seen, ["origin", "node"], "left_anti"))
            seen = seen.unionByName(frontier)
        found = found.unionByName(step)
    reached = found.repartition("origin").select("origin", "n", F.explode("to").alias("node"))
    once = reached.groupBy("origin", "node").agg(F.first("n").alias("n"))  # a node has one n
    return once.groupBy("origin").agg(F.sum("n").alias("evidence"))


def wanted(prefixes: Sequence[str], node: str = "node") -> Column:
    keep = F.lit(not prefixes)
    for p in prefixes:
        keep = keep | F.startswith(node, F.lit(p))
    return keep


def lift(boost: float, node: str = "node") -> Column:
    return F.when(F.startswith(node, F.lit("pathway::")), F.lit(boost)).otherwise(F.lit(1.0))


def walk_bounds(lean: DataFrame, max_hops: int, prefixes: Sequence[str], decay: float, boost: float) -> DataFrame:
    """(node, b1, b2, ...): the most by which a walk that stands at a node can still be multiplied, decay and boost included,
    to end at a wanted node after one hop, after one or two, and so on; null where none is so near.

    Made backwards from the wanted ends, once for all origins; a level is one join and one aggregate over the edges.
    """
    ends = lean.select(F.col("next").alias("node")).distinct()
    here = F.when(wanted(prefixes), lift(max(boost, 1.0))).otherwise(F.lit(0.0))
    known, best = None, ends.select("node", here.alias("ahead"))
    for k in range(1, max_hops):
        step = lean.join(best.select(F.col("node").alias("next"), "ahead"), "next").groupBy("node").agg(F.max(F.col("s") * F.col("ahead") * decay).alias(f"b{k}")).filter(F.col(f"b{k}") > 0)
        known = cut(step if known is None else step.join(known, "node", "left"))
        best = ends.join(known.select("node", f"b{k}"), "node", "left").select("node", F.greatest(here, F.coalesce(f"b{k}", F.lit(0.0))).alias("ahead"))
    return known


#: Edges of a node that travel in one row.
STRETCH = 1_024
#: Walks that one task makes rows of and sorts, and tasks at most.
WALKS, MAX_TASKS = 1_000_000, 10_000


def _ends(lean: DataFrame, prefixes: Sequence[str], boost: float) -> DataFrame:
    """(node, kind, reach, rest, s, d): each node's edges to wanted nodes as lists of STRETCH at most, boosted signals
    (``reach``) falling, so that what passes a floor is the beginning of a list. A wanted node's name is ``kind`` and ``rest``."""
    kind = F.when(F.contains("next", F.lit("::")), F.concat(F.substring_index("next", "::", 1), F.lit("::"))).otherwise(F.lit(""))
    rows = lean.filter(wanted(prefixes, "next")).select("node", "next", kind.alias("kind"), (F.col("s") * lift(max(boost, 1.0), "next")).alias("reach"), "s", "d")
    place = F.row_number().over(Window.partitionBy("node", "kind").orderBy(F.desc("reach"), "next"))
    rows = rows.withColumn("part", F.floor((place - 1) / STRETCH)).withColumn("rest", F.substr("next", F.length("kind") + 1))
    lists = rows.groupBy("node", "kind", "part").agg(F.sort_array(F.collect_list(F.struct("reach", "rest", "s", "d")), asc=False).alias("e"))
    return cut(lists.select("node", "kind", "e.reach", "e.rest", "e.s", "e.d"))


def _by_origin(ended: DataFrame, states: Sequence[DataFrame], ends: DataFrame) -> DataFrame:
    """``ended`` dealt by origin, so that a task makes about WALKS rows at most, whatever the number of shuffle partitions: as
    rows, walks take many times the room of their lists. They are counted from above, without making them."""
    sizes = ends.groupBy("node").agg(F.sum(F.size("reach")).alias("n"))
    at = states[0].select("node")
    for s in states[1:]:
        at = at.unionByName(s.select("node"))
    walks = at.groupBy("node").agg(F.count("*").alias("m")).join(sizes, "node").agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0] or 0.0
    tasks = min(MAX_TASKS, int(walks / WALKS) + 1)
    if tasks <= int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return ended.repartition("origin")
    return ended.repartition(tasks, "origin")


def ranked_candidates(edges: DataFrame, origins: DataFrame, max_hops: int = MAX_HOPS, min_score: float = MIN_SCORE, prefixes: Sequence[str] = PREFIXES, decay: float = DECAY, boost: float = PATHWAY_BOOST) -> DataFrame:
    """(origin, node, hops, raw_signal, score, direction_sign): the best walk from each origin (column ``origin``) to each node.

    The signal of a walk is the product of its edges' signals, its direction the product of their signs, its score
    ``signal * decay^(hops-1)``, times ``boost`` for pathways. Signals aren't negative, so the best walk of h hops
    extends the best one of h-1 hops to the node before: one row per (origin, node) and hop is enough, where the walks
    themselves grow exponentially. Ties prefer the positive direction, then fewer hops. Walks may come back to a node.

    A walk ends where neither its own node nor any within the hops left can reach ``min_score``, by the bounds that
    ``walk_bounds`` gives each node. Walks that can go on are rows, the best of each (origin, node) and hop. Walks that end at
    a wanted node leave their last node but one as the beginning of its list of edges (``_ends``) and are shuffled once, by
    origin; only there are they rows.
    """
    lean = edges.select("head", "tail", signal().alias("s"), sign().alias("d"))
    # parallel edges: only the best of a pair can be on a best walk, which also thins hubs before the joins
    lean = cut(lean.groupBy("head", "tail").agg(F.max(F.struct("s", "d")).alias("e")).select(F.col("head").alias("node"), F.col("tail").alias("next"), "e.s", "e.d"))
    max_hops, decay = max(1, max_hops), max(0.01, decay)
    ends = _ends(lean, prefixes, boost)
    bounds = [f"b{k}" for k in range(1, max_hops)]
    if bounds:
        ahead = walk_bounds(lean, max_hops, prefixes, decay, boost).select(F.col("node").alias("next"), *bounds)
        lean = cut(lean.join(ahead, "next"))  # a node without bounds leads nowhere
    floor = F.lit(min_score * (1 - 1e-9))
    state = origins.select("origin", F.col("origin").alias("node"), F.lit(1.0).alias("signal"), F.lit(1.0).alias("direction"))
    ended, states = None, []
    for h in range(1, max_hops + 1):
        states.append(state)
        decayed = F.col("signal") * F.lit(decay ** (h - 1))
        met = state.join(ends, "node").filter(decayed * F.get("reach", F.lit(0)) >= floor)
        met = met.withColumn("n", F.size(F.filter("reach", lambda r: decayed * r >= floor)))
        step = met.select("origin", F.lit(h).alias("hops"), "signal", "direction", "kind", *(F.slice(c, F.lit(1), F.col("n")).alias(c) for c in ("rest", "s", "d")))
        ended = step if ended is None else ended.unionByName(step)
        if h == max_hops:
            break
        far = lean.select("node", "next", "s", "d", F.col(f"b{max_hops - h}").alias("far")).filter(F.col("far") > 0)
        walked = state.join(far, "node").select("origin", F.col("next").alias("node"), (F.col("signal") * F.col("s")).alias("signal"), (F.col("direction") * F.col("d")).alias("direction"), "far")
        best = walked.filter(decayed * F.col("far") >= floor).groupBy("origin", "node").agg(F.max(F.struct("signal", "direction")).alias("b"))
        state = cut(best.select("origin", "node", "b.signal", "b.direction"))
    rows = _by_origin(ended, states, ends).select("origin", "hops", "signal", "direction", "kind", F.inline(F.arrays_zip("rest", "s", "d")))
    rows = rows.select("origin", F.concat("kind", "rest").alias("node"), "hops", (F.col("signal") * F.col("s")).alias("signal"), (F.col("direction") * F.col("d")).alias("direction"))
    decayed = F.col("signal") * F.pow(F.lit(decay), F.col("hops") - 1)
    scored = rows.filter(F.col("node") != F.col("origin")).withColumn("score", F.when(F.startswith("node", F.lit("pathway::")), decayed * boost).otherwise(decayed)).filter(F.col("score") >= min_score)
    # rows of an origin are together already; a number to sort by first, as names begin alike
    top = scored.groupBy("origin", F.xxhash64("node").alias("near"), "node").agg(F.max(F.struct("score", (-F.col("hops")).alias("h"), "signal", "direction")).alias("t"))
    return top.select("origin", "node", (-F.col("t.h")).alias("hops"), F.col("t.signal").alias("raw_signal"), "t.score", F.col("t.direction").alias("direction_sign"))


def incident(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: node, other, is_out, and the edge's columns. A self-loop is there twice."""
    out = edges.withColumns({"node": F.col("head"), "other": F.col("tail"), "is_out": F.lit(True)})
    return out.unionByName(edges.withColumns({"node": F.col("tail"), "other": F.col("head"), "is_out": F.lit(False)}))


EDGE_ORDER = ("head", "relation", "tail", "source", "weight", "confidence", "effect_sign")


def one_hop(edges: DataFrame, node: str, max_edges: int = 300) -> DataFrame:
    """Out-edges, then in-edges, of one node, ``max_edges`` at most, in the order of all edge columns."""
    near = incident(edges.filter((F.col("head") == node) | (F.col("tail") == node))).filter(F.col("node") == node)
    return near.orderBy(F.desc("is_out"), *EDGE_ORDER).limit(max_edges).select("head", "relation", "tail", "weight", "confidence", "is_out")


def keyword_match(edges: DataFrame, node: str = "", relation: str = "", mode: str = "and") -> DataFrame:
    """Edges with node_hit and relation_hit, of which the asked-for ones all (and) or at least one (or) hold."""
    node_hit = F.contains(F.lower("head"), F.lit(node.lower())) | F.contains(F.lower("tail"), F.lit(node.lower())) if node else F.lit(False)
    rel_hit = F.contains(F.lower("relation"), F.lit(relation.lower())) if relation else F.lit(False)
    asked = [h for h, q in ((F.col("node_hit"), node), (F.col("relation_hit"), relation)) if q]
    keep = F.lit(True)
    if asked:
        keep = asked[0]
        for h in asked[1:]:
            keep = keep & h if mode == "and" else keep | h
    return edges.withColumns({"node_hit": node_hit, "relation_hit": rel_hit}).filter(keep)


def matched_by() -> Column:
    return F.when(F.col("node_hit") & F.col("relation_hit"), "both").when(F.col("node_hit"), "node").when(F.col("relation_hit"), "relation").otherwise("none")


def keyword_subgraph(edges: DataFrame, node: str = "", relation: str = "", mode: str = "and", max_nodes: int = 200, max_edges: int = 500) -> DataFrame:
    """The first ``max_edges`` matching edges in the order of all edge columns, of which both ends are among the first
    ``max_nodes`` nodes to appear."""
    return first_subgraph(keyword_match(edges, node, relation, mode), max_nodes, max_edges)


def first_subgraph(matched: DataFrame, max_nodes: int = 200, max_edges: int = 500) -> DataFrame:
    """``keyword_subgraph`` of edges that ``keyword_match`` or an index has found. Only a top-k leaves the scan; all after it
    is one pass over twice ``max_edges`` rows: each end's first place, the nodes' order by it, the edges both of whose ends
    are early enough."""
    max_nodes, max_edges = max(10, max_nodes), max(10, max_edges)
    first = matched.orderBy(*EDGE_ORDER).limit(max_edges).withColumn("seq", F.row_number().over(Window.orderBy(*EDGE_ORDER)))
    ends = first.select("*", F.posexplode(F.array("head", "tail")).alias("side", "name"))
    ends = ends.withColumn("at", F.min(F.col("seq") * 2 + F.col("side")).over(Window.partitionBy("name")))
    ends = ends.withColumn("nth", F.dense_rank().over(Window.orderBy("at")))
    both = ends.groupBy("seq").agg(F.max("nth").alias("nth"), *(F.first(c).alias(c) for c in ("head", "relation", "tail", "weight", "confidence", "node_hit", "relation_hit")))
    return both.filter(F.col("nth") <= max_nodes).select("seq", "head", "relation", "tail", "weight", "confidence", matched_by().alias("matched_by"))


def match_stats(edges: DataFrame, node: str = "", relation: str = "", mode: str = "and") -> DataFrame:
    return hit_counts(keyword_match(edges, node, relation, mode))


def hit_counts(hits: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return hits.agg(F.count("*").alias("matched"), one(F.col("node_hit")).alias("node_hits"), one(F.col("relation_hit")).alias("relation_hits"), one(F.col("node_hit") & F.col("relation_hit")).alias("both_hits"))


def visual_sample(edges: DataFrame, nodes: DataFrame, max_nodes: int = 80, max_edges: int = 200) -> DataFrame:
    """Edges among the first ``max_nodes`` nodes by name, ``max_edges`` at most."""
    first = nodes.orderBy("name").limit(max_nodes).select("name")
    both = edges.join(F.broadcast(first.withColumnRenamed("name", "head")), "head", "left_semi").join(F.broadcast(first.withColumnRenamed("name", "tail")), "tail", "left_semi")
    return both.orderBy(*EDGE_ORDER).limit(max_edges).select("head", "relation", "tail", "weight", "confidence")


def visualise(edges: DataFrame, nodes: DataFrame, max_nodes: int = 80, max_edges: int = 200) -> DataFrame:
    """``visual_sample``, or if that is empty the first edges as ``keyword_subgraph`` gives them."""
    first = cut(visual_sample(edges, nodes, max_nodes, max_edges))
    if not first.isEmpty():
        return first
    return keyword_subgraph(edges, max_nodes=max_nodes, max_edges=max_edges).select("head", "relation", "tail", "weight", "confidence")


def with_evidence_flags(edges: DataFrame) -> DataFrame:
    """Adds has_evidence and is_structured from column evidence."""
    e = F.coalesce(F.col("evidence"), F.lit(""))
    return edges.withColumns({"has_evidence": e != "", "is_structured": F.get_json_object(e, "$.structured").isNotNull()})


def linked(edges: DataFrame, nodes: DataFrame, prefix: str, limit: int, min_signal: float = 0.02) -> DataFrame:
    """For each of ``nodes`` (column node) the best linked nodes with ``prefix`` either way: node, other, signal, place."""
    keep = rules.is_biological_pathway(F.col("other")) if prefix == "pathway::" else F.startswith("other", F.lit(prefix))
    near = incident(edges.select("head", "tail", signal().alias("signal"))).filter(keep & (F.col("signal") >= min_signal))
    best = near.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node", "other").agg(F.max("signal").alias("signal"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("signal"), "other"))
    return best.withColumn("place", place).filter(F.col("place") <= limit)


def resolve_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): a gene's symbol; for a number, the first symbol among out- then in-neighbours; else the token."""
    token = rules.gene_token(F.col("node"))
    base = nodes.select("node").distinct().withColumn("token", token)
    odd = cut(base.filter((F.col("token") != "") & ~rules.is_symbol_like(F.col("token"))).select("node"))  # known to be few before edges are read
    near = incident(edges.select("head", "tail")).join(odd, "node", "left_semi").withColumn("alias", rules.gene_token(F.col("other")))
    first = F.min(F.when(rules.is_symbol_like(F.col("alias")), F.struct((~F.col("is_out")).alias("z"), "other", "alias")))  # rules of the odd nodes' edges only
    found = near.groupBy("node").agg(first.alias("m")).select("node", F.col("m.alias").alias("alias"))
    return base.join(found, "node", "left").select("node", F.when(F.col("token") == "", F.col("node")).when(rules.is_symbol_like(F.col("token")), F.col("token")).otherwise(F.coalesce("alias", "token")).alias("label"))


def filter_options(edges: DataFrame, nodes: DataFrame, limit: int = 200) -> DataFrame:
    """(kind, value): the first ``limit`` names of each type and relations, sorted."""
    limit = max(10, limit)
    values = nodes.select(F.col("type").alias("kind"), F.col("name").alias("value")).unionByName(edges.select(F.lit("relation").alias("kind"), F.col("relation").alias("value")).distinct())
    return values.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("value"))).filter(F.col("n") <= limit).drop("n")


def stats(edges: DataFrame) -> DataFrame:
    n = edges.select(F.explode(F.array("head", "tail")).alias("name")).agg(F.countDistinct("name").alias("nodes"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(n)  # one row each


def _stars(pairs: DataFrame, max_rounds: int) -> DataFrame:
    """(u, v): the least node u of the component of each other node v; large-star/small-star rounds with cut lineage."""
    current, before = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()), None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("m").alias("u"), "v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        current = cut(small.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), "v"))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return current
        before = state
    raise RuntimeError("connected components did not converge")


def _hashed(names: DataFrame) -> tuple[DataFrame, int]:
    """(name, id): a hash of each name, and the salt with which no two names share one; null has none."""
    for salt in range(10):
        ids = cut(names.withColumn("id", F.when(F.col("name").isNotNull(), F.xxhash64("name", F.lit(salt)))))
        if ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return ids, salt
    raise RuntimeError("names kept sharing a hash")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(name, component): weakly connected components by their least name.

    Names have numbers. One edge of each node is enough for all but a few components to be whole: star rounds run over
    those, as many rows as nodes. All other edges are read once more, with their ends' components, of which only the
    distinct pairs that differ are left for a second run.
    """
    everyone, salt = _hashed(edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct())
    number = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c, F.lit(salt)))
    arcs = cut(edges.select(number("head").alias("u"), number("tail").alias("v")).filter("u <> v"))
    one = arcs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").groupBy("u").agg(F.min("v").alias("v"))
    ids = everyone.select("id").filter("id is not null")
    label = lambda trees: trees.select(F.col("v").alias("id"), F.col("u").alias("low"))
    found = cut(ids.join(label(_stars(one, max_rounds)), "id", "left").select("id", F.coalesce("low", "id").alias("low")))
    half = arcs.join(found.select(F.col("id").alias("u"), F.col("low").alias("a")), "u").select("a", "v").distinct()
    across = half.join(found.select(F.col("id").alias("v"), F.col("low").alias("b")), "v").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    merged = label(_stars(across, max_rounds)).toDF("low", "root")
    last = found.join(merged, "low", "left").select("id", F.coalesce("root", "low").alias("root"))
    placed = cut(everyone.join(last, "id", "left").select("name", "root"))
    least = placed.filter("root is not null").groupBy("root").agg(F.min("name").alias("component"))
    return placed.join(least, "root", "left").select("name", "component")


def component_sizes(edges: DataFrame, top: int = 5) -> DataFrame:
    sizes = components(edges).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), "component").limit(top)


def simple(edges: DataFrame) -> DataFrame:
    """Distinct (head, tail) without self-loops."""
    return edges.select("head", "tail").filter("head <> tail").distinct()


def in_triangles(pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v, ...) whose ends' types can lie in a triangle: some type is met by edges of both.

    Pairs of types are as many as the rules know at most. A graph whose types only ever meet in chains, as samples, genes
    and proteins do, keeps no edge.
    """
    typed = pairs.withColumns({"ut": rules.node_type(F.col("u")), "vt": rules.node_type(F.col("v"))})
    met = typed.select(F.explode(F.array(F.struct(F.col("ut").alias("a"), F.col("vt").alias("b")), F.struct(F.col("vt").alias("a"), F.col("ut").alias("b")))).alias("e")).select("e.*").distinct()
    met = cut(met.coalesce(1))  # types squared rows at most
    side = lambda a, b: met.toDF(a, b)
    closed = side("ut", "vt").join(side("vt", "third"), "vt").join(side("third", "ut"), ["third", "ut"]).select("ut", "vt").distinct()
    return typed.join(F.broadcast(closed), ["ut", "vt"], "left_semi").drop("ut", "vt")


def clustering(edges: DataFrame) -> DataFrame:
    """(name, clustering) of the directed simple graph: directed triangles over 2 (d (d-1) - 2 r), d the total degree, r the reciprocal edges.

    Each undirected triangle is found once, from its two edges that leave its node of lowest degree, so a hub's many
    neighbours are never paired; it then counts for its three corners. Only edges of types that can close a triangle are
    paired, by their ends' numbers in the order of degree, not by names.
    """
    way = F.when(F.col("head") < F.col("tail"), 1).otherwise(2)
    pairs = edges.filter("head <> tail").groupBy(F.least("head", "tail").alias("u"), F.greatest("head", "tail").alias("v")).agg(F.bit_count(F.bit_or(way)).alias("w"))  # 2 for reciprocal pairs
    pairs = cut(pairs)
    degree = pairs.select(F.explode(F.array("u", "v")).alias("name"), "w").groupBy("name").agg(F.sum("w").alias("d"), F.sum((F.col("w") == 2).cast("long")).alias("r"))
    some = cut(in_triangles(pairs))
    ends = some.select(F.explode(F.array("u", "v")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    numbered = cut(in_order(ends, "n", "name").select("name", "i"))
    number = lambda end, i: numbered.select(F.col("name").alias(end), F.col("i").alias(i))
    ranked = some.join(number("u", "a"), "u").join(number("v", "b"), "v")
    up = cut(ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w"))
    x, y, z = up.toDF("a", "b", "wx"), up.toDF("a", "c", "wy"), up.toDF("b", "c", "wz")
    closed = x.join(y, "a").filter("b < c").join(z, ["b", "c"])
    corners = closed.select(F.explode(F.array("a", "b", "c")).alias("i"), (F.col("wx") * F.col("wy") * F.col("wz")).alias("t"))
    triangles = corners.groupBy("i").agg(F.sum("t").cast("double").alias("t")).join(numbered, "i").select("name", "t")
    room = 2 * (F.col("d") * (F.col("d") - 1) - 2 * F.col("r"))
    return degree.join(triangles, "name", "left").select("name", F.when(F.coalesce("t", F.lit(0.0)) > 0, F.col("t") / room).otherwise(F.lit(0.0)).alias("clustering"))


def _giant(comps: DataFrame) -> DataFrame:
    """(component, size) of the largest component; of equal ones the first by its least name."""
    return comps.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)


def _edges_of(edges: DataFrame, comps: DataFrame, giant: DataFrame) -> DataFrame:
    return edges.join(comps.join(F.broadcast(giant), "component").select(F.col("name").alias("head")), "head", "left_semi")  # one row


def giant_component(edges: DataFrame) -> DataFrame:
    """The edges of the largest weakly connected component; of equal ones the first by its least name."""
    comps = cut(components(edges))
    return _edges_of(edges, comps, _giant(comps))


def shortest_paths(edges: DataFrame, max_nodes: int | None = 5_000) -> DataFrame:
    """(average, diameter) over directed shortest paths of the giant component; -1 and -1 unless that is strongly
    connected and of ``max_nodes`` at most (None: of any size). The edges of a larger one aren't gathered."""
    comps = cut(components(edges))
    giant = cut(_giant(comps))
    if max_nodes is not None and not giant.filter(F.col("size") > max_nodes).isEmpty():
        return edges.sparkSession.createDataFrame([(-1.0, -1)], "average double, diameter int")
    return path_lengths(simple(_edges_of(edges, comps, giant)), max_nodes)


def path_lengths(arcs: DataFrame, max_nodes: int | None = 5_000) -> DataFrame:
    """``shortest_paths`` of the whole graph of ``arcs`` (head, tail).

    64 origins are the bits of one number: a row (node, word, bits) says which of them have come to the node. A level
    joins the newly set bits with the arcs and takes their OR by (tail, word), so it shuffles nodes times n / 64 rows at
    most and no table of pairs is ever made. The average is the sum of level times new bits.
    """
    arcs = cut(arcs)
    names = arcs.select(F.explode(F.array("head", "tail")).alias("node")).distinct()
    n, spark = names.count(), arcs.sparkSession
    none = spark.createDataFrame([(-1.0, -1)], "average double, diameter int")
    if n < 2 or (max_nodes is not None and n > max_nodes):
        return none
    numbered = in_order(names, "node").withColumn("nth", F.col("i") - 1)
    reached = cut(numbered.select("node", F.expr("nth div 64").alias("word"), F.expr("shiftleft(1L, cast(nth % 64 as int))").alias("bits")))
    frontier, pairs, total, longest = reached, n, 0, 0
    while True:
        step = frontier.join(arcs, F.col("node") == F.col("head")).groupBy(F.col("tail").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        known = reached.select("node", "word", F.col("bits").alias("known"))
        fresh = step.join(known, ["node", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))).drop("known")
        frontier = cut(fresh.filter("bits <> 0"))
        new = frontier.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).first()[0]
        if not new:
            break
        longest += 1
        pairs, total = pairs + new, total + new * longest
        reached = cut(reached.unionByName(frontier).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    if pairs != n * n:
        return none
    return spark.createDataFrame([(total / (n * (n - 1)), longest)], "average double, diameter int")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    return nodes.join(ends, "name", "left_anti")


def compose(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keyed union of two edge tables: parallel edges are numbered within (head, tail), and equal numbers take the right's attributes."""
    rest = [c for c in left.columns if c not in ("head", "tail")]
    number = F.row_number().over(Window.partitionBy("head", "tail").orderBy(*rest))
    a = left.withColumn("key", number).select("head", "tail", "key", F.struct(*rest).alias("a"))
    b = right.select(*left.columns).withColumn("key", number).select("head", "tail", "key", F.struct(*rest).alias("b"))
    merged = a.join(b, ["head", "tail", "key"], "full").withColumn("e", F.coalesce("b", "a"))
    return merged.select("head", "tail", *(F.col(f"e.{c}").alias(c) for c in rest))
