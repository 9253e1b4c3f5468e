"""Graph operators that no SQL is held against, on small graphs by brute force."""

import random
from itertools import product

from lattica.operators import build, evaluate, graph, predict, retrieval
from lattica.plans.queries import QUERIES
from lattica.plans.views import edges as all_edges
from lattica.sources import files
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def least_reachable(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    low = {}
    for start in sorted(near):
        todo = [start] if start not in low else []
        while todo:
            n = todo.pop()
            if n not in low:
                low[n] = start
                todo += near[n]
    return low


def arcs(spark, pairs):
    return spark.createDataFrame(pairs, "head string, tail string")


def test_deep_components(spark):
    rng = random.Random(3)
    names = [f"n{i:04d}" for i in rng.sample(range(10_000), 400)]
    pairs = list(zip(names[:150], names[1:150])) + [(b, a) for a, b in zip(names[150:200], names[151:200])]  # paths
    pairs += [(rng.choice(names[200:]), rng.choice(names[200:])) for _ in range(110)] + [("self", "self"), pairs[0]]
    want = least_reachable(pairs)
    assert {r["name"]: r["component"] for r in graph.components(arcs(spark, pairs)).collect()} == want
    sizes = sorted(((-list(want.values()).count(c), c) for c in set(want.values())))[:5]
    assert [(-r["size"], r["component"]) for r in graph.component_sizes(arcs(spark, pairs)).collect()] == sizes


def test_components_of_all_edges(spark):
    pairs = [tuple(r) for r in all_edges(spark, SF).select("head", "tail").distinct().collect()]
    assert {r["name"]: r["component"] for r in QUERIES["g12_all_components"](spark, SF).collect()} == least_reachable(pairs)


def test_shortest_paths(spark):
    n = 7
    pairs = [(str(i), str((i + 1) % n)) for i in range(n)] + [("0", "3"), ("0", "3"), ("2", "2")]
    far = {(str(i), str(j)): 0 if i == j else 99 for i in range(n) for j in range(n)}
    far |= {p: 1 for p in pairs if p[0] != p[1]}
    for k, i, j in product(map(str, range(n)), repeat=3):
        far[i, j] = min(far[i, j], far[i, k] + far[k, j])
    got = graph.shortest_paths(arcs(spark, pairs)).first()
    assert abs(got["average"] - sum(far.values()) / (n * (n - 1))) < 1e-9 and got["diameter"] == max(far.values())
    assert tuple(graph.shortest_paths(arcs(spark, pairs[1:])).first()) == (-1.0, -1)


def test_path_lengths_of_many_words(spark):
    """150 origins are three words of bits; a ring with chords, by search from each node."""
    n = 150
    near = {i: {(i + 1) % n, i * 7 % n} - {i} for i in range(n)}
    total, longest = 0, 0
    for start in range(n):
        far, todo = {start: 0}, [start]
        for v in todo:
            for w in near[v] - far.keys():
                far[w] = far[v] + 1
                todo.append(w)
        total, longest = total + sum(far.values()), max(longest, *far.values())
    got = graph.path_lengths(arcs(spark, [(str(i), str(j)) for i in near for j in near[i]])).first()
    assert abs(got["average"] - total / (n * (n - 1))) < 1e-9 and got["diameter"] == longest
    assert graph.path_lengths(arcs(spark, [("a", "b")]), 1).first()["diameter"] == -1


def test_walks(spark):
    """The best walks by enumeration of all of them, with bounds that prune and prefixes that few nodes have."""
    rng = random.Random(12)
    names = [f"gene::{i}" for i in range(5)] + ["pathway::a", "protein::p", "x::1", "x::2"]
    rows = [(rng.choice(names), rng.choice(names), round(rng.random(), 2), rng.choice([1.0, -1.0])) for _ in range(40)]
    e = spark.createDataFrame(rows, "head string, tail string, weight double, effect_sign double").withColumn("confidence", F.lit(1.0))
    origins = spark.createDataFrame([(n,) for n in [*names[:3], "x::1", "nowhere"]], "origin string")
    for hops, floor, prefixes in ((3, 0.01, graph.PREFIXES), (3, 0.3, ("pathway::",)), (2, 0.05, ()), (1, 0.0, ("gene::",)), (4, 0.2, ("gene::", "x::"))):
        want, level = {}, [(o, o, 1.0, 1.0) for o in [*names[:3], "x::1"]]
        for h in range(1, hops + 1):
            level = [(o, t, s * (w or 1.0), d * g) for o, v, s, d in level for a, t, w, g in rows if a == v]
            for o, v, s, d in level:
                score = s * 0.78 ** (h - 1) * (1.12 if v.startswith("pathway::") else 1.0)
                if v != o and score >= floor and (not prefixes or v.startswith(prefixes)):
                    want[o, v] = max(want.get((o, v), (0.0,)), (round(score, 9), -h, d))
        got = {(r["origin"], r["node"]): (round(r["score"], 9), -r["hops"], r["direction_sign"]) for r in graph.ranked_candidates(e, origins, hops, floor, prefixes).collect()}
        assert got == want


def test_three_hop_paths(spark):
    rng = random.Random(4)
    name = lambda: rng.choice(["gene::", "protein::", "protein::"]) + rng.choice("abcd")
    pairs = [(name(), name()) for _ in range(60)]
    ends = [(k, a, b) for k, p in enumerate(pairs) for a, b in {p, p[::-1]}]
    want = {}
    for (i, g, p), (j, p2, q), (k, q2, h) in product(ends, repeat=3):
        if len({i, j, k}) == 3 and p == p2 and q == q2 and g[0] == h[0] == "g" and p[0] == q[0] == "p" and g != h:
            want[g] = want.get(g, 0) + 1
    origins = spark.createDataFrame([(f"gene::{c}",) for c in "abcd"], "name string")
    assert {r["origin"]: r["paths"] for r in evaluate.three_hop_paths(arcs(spark, pairs), origins).collect() if r["paths"]} == want


def test_evidence_coverage(spark):
    df = spark.createDataFrame([("",), (None,), ("abcd",), ('{"structured": 1}',)], "evidence string")
    assert tuple(evaluate.evidence_coverage(df).first()) == (4, 2, 10.5, 0.25)


KNOCKED = "pathway::perturbation::KO_TP53"


def small_graph(spark, more=()):
    rows = [
        ("Cell::A549", "associated_with", "gene::TP53", 0.9, 0.9, 1.0), (KNOCKED, "targets_gene", "gene::TP53", 1.0, 0.9, -1.0), ("gene::TP53", "activates", "gene::MDM2", 0.8, 0.9, 1.0),
        ("gene::TP53", "inhibits", "gene::EGFR", 0.7, 0.8, -1.0), ("gene::TP53", "activates", "protein::P21", 0.9, 0.9, 1.0), ("gene::MDM2", "associated_with", "gene::1234", 0.9, 0.9, 1.0),
        ("sample::S1", "expresses", "gene::EGFR", 0.5, 0.7, 0.0), *more]
    return spark.createDataFrame([(h, r, t, "s", "v", w, c, e) for h, r, t, w, c, e in rows], "head string, relation string, tail string, source string, version string, weight double, confidence double, effect_sign double")


def no_seeds(spark):
    return spark.createDataFrame([("TP53",)], "gene string")


def test_prediction_steps(spark):
    e = small_graph(spark)
    made = predict.predict(e, no_seeds(spark), "Cell::A549", "KO_TP53", top_k=3)
    genes = [tuple(r) for r in made.genes.orderBy("place").select("label", "hops", "from_perturbation", "effect").collect()]
    assert genes[0] == ("TP53", 1, True, "增强") and {g[0] for g in genes} == {"TP53", "MDM2", "EGFR"}  # the numbered gene is hidden
    assert all(r["delta"] == round(r["delta"], 4) for r in made.genes.collect())
    assert made.pathways.count() == 0 and [r["node"] for r in made.proteins.collect()] == ["protein::P21"]
    # pathways of the genes, or two hops from them
    linked = small_graph(spark, [("gene::EGFR", "participates", "pathway::growth", 0.9, 0.9, 1.0)])
    assert [r["node"] for r in predict.predict(linked, no_seeds(spark), "Cell::A549", "KO_TP53").pathways.collect()] == ["pathway::growth"]
    genes = spark.createDataFrame([("gene::A", 0.5, 1, -1.0, False)], "node string, score double, hops int, direction_sign double, from_perturbation boolean")
    far = spark.createDataFrame([("gene::A", "x", "protein::B", 1.0, 0.8, -1.0), ("protein::B", "x", "pathway::C", 1.0, 0.5, 1.0)], "head string, relation string, tail string, weight double, confidence double, effect_sign double")
    walked = predict.pathways_from_walks(far, genes, 5).first()
    assert (walked["node"], walked["hops"], walked["direction_sign"]) == ("pathway::C", 3, 1.0) and abs(walked["score"] - 0.5 * 0.4 * 0.78 * 1.12 * 0.85) < 1e-6
    # an answer of numbers alone is shown
    ids = spark.createDataFrame([("gene::12", "12", 0.5), ("gene::13", "13", 0.4)], "node string, label string, score double")
    assert predict.hide_ids(ids).count() == 2 and predict.hide_ids(ids.union(spark.createDataFrame([("gene::A", "AB", 0.1)]))).count() == 1
    # many direct hits leave no room for others
    rows = spark.createDataFrame([(f"gene::G{i}", f"G{i}", 0.5, False) for i in range(12)], "node string, label string, score double, from_perturbation boolean")
    few, many = (spark.createDataFrame([(f"G{i}",) for i in range(n)], "direct_label string") for n in (7, 8))
    assert predict.lift_direct(rows, few, 5).count() == 12 and predict.lift_direct(rows, many, 5).count() == 8
    assert predict.lift_direct(rows, many, 5).filter("from_perturbation and score = 0.675").count() == 8


def test_answers(spark):
    e = small_graph(spark, [("gene::EGFR", "participates", "pathway::growth", 0.9, 0.9, 1.0)])
    docs = spark.createDataFrame([(0, "TP53 controls MDM2. Rain fell."), (1, "The harbour opened in spring. The tide table names the hours.")], "doc_id long, text string")
    made = predict.answer(e, no_seeds(spark), docs, "A549: what does knockout of TP53 do?")
    assert made.kind == "prediction" and made.text.startswith("KO_TP53 in A549: 3 genes, 1 pathways.") and "TP53" in made.text and "growth" in made.text
    assert made.documents.first()["doc_id"] == 0 and made.evidence == 6 + 1 and abs(made.confidence - (0.4 + 0.04 * 3 + 0.02 * 1)) < 1e-9 and not made.assumed
    plain = predict.answer(e, no_seeds(spark), docs, "Which tide table names hours?")
    assert plain.kind == "sentences" and plain.text == "The harbour opened in spring. The tide table names the hours."


def test_answers_fall_through(spark):
    """Which cell an answer is for, and when there is none: all questions at once and one by one."""
    rows = [
        ("Cell::A549", "associated_with", "gene::TP53", 0.9, 0.9, 1.0), ("Cell::LONE77", "associated_with", "protein::P21", 0.9, 0.9, 1.0), ("Cell::PATH88", "associated_with", "pathway::growth", 0.9, 0.9, 1.0),
        ("gene::TP53", "activates", "gene::MDM2", 0.8, 0.9, 1.0), ("Cell::WEAK99", "associated_with", "gene::FAINT", 0.1, 0.03, 1.0)]
    e = spark.createDataFrame([(h, r, t, "s", "v", w, c, s) for h, r, t, w, c, s in rows], "head string, relation string, tail string, source string, version string, weight double, confidence double, effect_sign double")
    docs = spark.createDataFrame([(0, "Rain fell.\nEGFR was inhibited."), (1, "The tide table names the hours.")], "doc_id long, text string")
    asked = [
        (1, "knockout of EGFR?"),  # no cell: the first default has no node, the second one answers
        (2, "LONE77: inhibit EGFR"),  # proteins alone are an answer
        (3, "PATH88: inhibit EGFR"),  # and so are pathways
        (4, "NOWHERE11: inhibit EGFR"),  # a named cell without rows: sentences
        (5, "knockout of TP53?"),  # TP53 reads as a cell line, as letters before two digits do: no gene is left
        (6, "what rains, tide or table?"),  # no gene
        (7, "EGFR oe in WEAK99"),  # a score between a quarter of the floor and the floor
        (8, None), (9, "zzz qqq")]
    questions = spark.createDataFrame(asked, "query_id long, question string")
    got = {r["query_id"]: r for r in predict.answer_all(e, no_seeds(spark), docs, questions).answers.collect()}
    assert {k: (r["kind"], r["cell"], r["assumed"], r["genes"], r["pathways"], r["proteins"]) for k, r in got.items()} == {
        1: ("prediction", "Cell::A549", True, 2, 0, 0), 2: ("prediction", "Cell::LONE77", False, 0, 0, 1), 3: ("prediction", "Cell::PATH88", False, 0, 1, 0), 4: ("sentences", None, False, 0, 0, 0),
        5: ("none", None, False, 0, 0, 0), 6: ("sentences", None, False, 0, 0, 0), 7: ("prediction", "Cell::WEAK99", False, 1, 0, 0), 8: ("none", None, False, 0, 0, 0), 9: ("none", None, False, 0, 0, 0)}
    assert got[1]["text"].startswith("KO_EGFR in A549 (no cell was named): 2 genes, 0 pathways.\n1. ") and got[4]["text"] == "EGFR was inhibited." and got[6]["text"] == "The tide table names the hours."
    assert got[7]["perturbation"] == "OE_EGFR" and got[1]["evidence"] == 2 + got[1]["documents"]
    for k in (1,):
        one = predict.answer(e, no_seeds(spark), docs, dict(asked)[k])
        assert (one.kind, one.text, one.confidence, one.evidence, one.assumed) == tuple(got[k][c] for c in ("kind", "text", "confidence", "evidence", "assumed"))
    assert predict.answer(e, no_seeds(spark), docs, "knockout of EGFR?", cells=("none1", "none2")).kind == "sentences"
    assert predict.answer_all(e, no_seeds(spark), docs, questions.limit(0)).answers.count() == 0


def test_predict_many_pairs(spark):
    """A table of pairs gives each pair what it gets alone."""
    rng = random.Random(8)
    names = [f"gene::G{i}" for i in range(30)] + [f"gene::{i}" for i in range(6)] + [f"protein::P{i}" for i in range(8)] + [f"pathway::w{i}" for i in range(5)]
    cells, perts = [f"Cell::C{i}" for i in range(4)], [f"pathway::perturbation::KO_{i}" for i in range(4)]
    pick = lambda of: of[int(len(of) * rng.random() ** 1.5)]
    rows = [(pick(cells[:3] + perts[:3] + names[:44]), rng.choice(["activates", "inhibits"]), pick(names), round(rng.random(), 3), round(rng.random(), 3), rng.choice([1.0, -1.0, 0.0])) for _ in range(260)]
    rows += [(f"sample::S{i}", "expresses", pick(names[:36]), 0.5, 0.5, 0.0) for i in range(40)] + [("Cell::C2", "x", names[0], 1.0, 1.0, 1.0)]
    e = small_graph(spark, rows)
    pairs = [(c, f"KO_{i}") for c in cells for i in range(4)] + [("Cell::C0", "pathway::perturbation::KO_1"), ("Cell::C0", "KO_1"), (None, "KO_1")]
    seeds = spark.createDataFrame([("G1",), ("G2",), ("G5",)], "gene string")
    prior = spark.createDataFrame([("P1", -0.4), ("P2", 2.0)], "protein string, log2_fc double")
    shown = lambda rows: sorted(repr(sorted((k, v) for k, v in r.asDict().items() if k not in predict.KEY)) for r in rows)
    for options, alone in (({}, [pairs[0], pairs[6], pairs[16]]), ({"top_k": 3, "min_score": 0.2}, [pairs[1]]), ({"target_genes": ["g3", "G4"], "calibration": prior}, [pairs[12]])):
        made = predict.predict_all(e, seeds, spark.createDataFrame(pairs, "cell string, perturbation string"), **options)
        whole = {name: getattr(made, name).collect() for name in ("genes", "pathways", "proteins")}
        assert all(whole.values()) and len({(r["cell"], r["perturbation"]) for r in whole["proteins"]}) > 10
        for c, p in alone:
            one = predict.predict(e, seeds, c, p, **options)
            for name, rows in whole.items():
                assert shown(getattr(one, name).collect()) == shown(r for r in rows if (r["cell"], r["perturbation"]) == (c, p))


def test_collectors_merge(spark):
    e = all_edges(spark, SF)
    seeds = e.filter(F.startswith("head", F.lit("gene::"))).select(F.expr("substr(head, 7)").alias("gene")).distinct().orderBy("gene").limit(5)
    half = F.pmod(F.xxhash64("head", "tail"), F.lit(2)) == 0
    merged = build.merge_collectors(build.collectors(e.filter(half), seeds, 20), build.collectors(e.filter(~half), seeds, 20), 20)
    for a, b in zip(merged, build.collectors(e, seeds, 20)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_omics_chunks(spark):
    long = spark.createDataFrame([("d", f"G{i}", f"s{j}", float(i * j % 7)) for i in range(9) for j in range(6)], "name string, entity string, sample string, value double")
    spec = spark.createDataFrame([("d", "expression", "d", "v", 3, 0.1, 0.7)], "name string, modality string, source string, version string, top_k int, min_value double, confidence double")
    whole = build.omics_triples(long, spec)
    parts = list(files.omics_chunks(long, spec, 20))
    assert len(parts) == 3 and sorted(map(repr, whole.collect())) == sorted(repr(r) for p in parts for r in p.collect())


def test_quality_latency_and_store(spark):
    q = evaluate.quality_score(1_000_000, 9_000_000, 7, 11, 5, 60_000, 13, 1.0, 1.0, 1.0, 0.0, 1e-5, 1.0, 70, 1.0, 0.0)
    assert q["total"] == 95.0 or q["total"] <= 100.0
    assert q["omics"] == 20.0 and q["perturbation"] == 15.0 and q["consistency"] == 5.0
    grid = evaluate.subgraph_latencies(small_graph(spark), [("tp53", ""), ("", "activ")], nodes=(10,), most=(10, 20), repeats=2).collect()
    assert len(grid) == 4 and all(0 < r["mean"] <= r["p99"] for r in grid)
    assert evaluate.latency_summary([3.0, 1.0, 2.0]) == {"min": 1.0, "max": 3.0, "mean": 2.0, "p99": 3.0}
    store = spark.createDataFrame([(4, "old", None)], "doc_id long, text string, metadata map<string,string>")
    got = retrieval.add_documents(store, spark.createDataFrame([("b",), ("a",), (" ",), (None,)], "text string"), {"k": "v"}).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [(4, "old"), (5, "a"), (6, "b")] and got[2]["metadata"] == {"k": "v"}


def test_normal_below(spark):
    import math

    zs = [-8.0, -3.5, -3.0, -1.0, -0.1, 0.0, 0.5, 2.9, 3.1, 6.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(evaluate.normal_below(F.col("z"))).collect()]
    assert all(abs(p - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-9 for z, p in zip(zs, got))
