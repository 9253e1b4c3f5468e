"""What queries send between tasks and which sizes they take."""

import math
import random
from collections import Counter
from itertools import combinations

import duckdb
import pytest
from lattica.operators import build, evaluate, graph, predict, retrieval
from lattica.plans import formats, queries
from pyspark.sql import functions as F


@pytest.fixture
def joins_shuffled(spark):
    """Small tables are joined as large ones are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled_rows(spark, run):
    """What ``run()`` gives, and how many rows were written to shuffles meanwhile."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def written():
        none = jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = set(written())
    made = run()
    return made, sum(n for k, n in written().items() if k not in before)


def test_clustering_by_hand(spark):
    """All triangles of a graph of several types, some edges both ways or many times over, counted by hand."""
    rng = random.Random(3)
    names = [f"{t}::{i}" for t in ("gene", "protein", "sample") for i in range(9)] + ["x", "y"]
    arcs = [(h, t) for h in names for t in names if rng.random() < 0.2 and {h[:4], t[:4]} != {"samp", "prot"}]
    made = spark.createDataFrame(arcs + arcs[:40], "head string, tail string")
    got = {r["name"]: r["clustering"] for r in graph.clustering(made).collect()}
    one = {a for a in arcs if a[0] != a[1]}
    w = lambda a, b: ((a, b) in one) + ((b, a) in one)
    want = {}
    for n in {x for a in one for x in a}:
        near = [m for m in names if w(n, m)]
        d, r = sum(w(n, m) for m in near), sum(w(n, m) == 2 for m in near)
        t = sum(w(n, a) * w(a, b) * w(n, b) for a, b in combinations(near, 2))
        want[n] = t / (2 * (d * (d - 1) - 2 * r)) if t else 0.0
    assert any(want.values()) and got == pytest.approx(want)


def test_clustering_pairs_no_chains(spark, joins_shuffled):
    """Genes between samples and proteins have no triangle, so no two edges are paired."""
    chain = [(f"sample::{s}", f"gene::{g}") for g in range(60) for s in range(60)] + [(f"gene::{g}", f"protein::{p}") for g in range(60) for p in range(60)]
    edges = graph.cut(spark.createDataFrame(chain, "head string, tail string"))
    got, rows = shuffled_rows(spark, lambda: graph.clustering(edges).collect())
    assert len(got) == 180 and not any(r["clustering"] for r in got)
    assert rows < 4 * len(chain)  # its pairs of edges are over 10 times as many


def test_path_lengths_of_many(spark, tmp_path):
    """More suppliers than the graph statistics take: all pairs of them, as in SQL."""
    spark.range(5_001).selectExpr("id + 1 AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    sql = queries.ORACLE_SQL["g12_path_lengths"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = queries.g12_path_lengths(spark, str(tmp_path)).first()
    assert tuple(got) == duckdb.sql(sql).fetchall()[0] and got["diameter"] > 10


def layers(spark):
    """40 samples that all have 30 genes, each of which acts on 40 proteins of one cell."""
    pairs = [(f"sample::{s}", f"gene::{g}") for s in range(40) for g in range(30)] + [(f"gene::{g}", f"protein::{p}") for g in range(30) for p in range(40)] + [(f"protein::{p}", "Cell::c") for p in range(40)]
    edges = graph.cut(spark.createDataFrame([(h, t, 1.0, 0.5 + i % 7 / 20, 0.0) for i, (h, t) in enumerate(pairs)], "head string, tail string, weight double, confidence double, effect_sign double"))
    return edges, graph.cut(edges.filter("head like 'sample::%'").selectExpr("head AS origin").distinct())


def test_evidence_sends_lists(spark, joins_shuffled):
    """48,000 walks reach the proteins; what is shuffled are lists of them."""
    edges, origins = layers(spark)
    got, rows = shuffled_rows(spark, lambda: graph.evidence_counts(edges, origins).collect())
    assert len(got) == 40 and {r["evidence"] for r in got} == {30 + 30 * 40 + 40}
    assert rows < 15_000


def test_stream_files(spark, tmp_path):
    """A batch of a stream has a file for each of its share of the tasks, and a key lies in one of them."""
    path = str(tmp_path / "in")
    rows = spark.range(400).selectExpr("concat('h', id % 40) AS head", "id")
    assert formats.dealt(rows, 2, path, "head") == 2
    placed = spark.read.parquet(path).selectExpr("head", "input_file_name() AS f").distinct()
    assert placed.count() == 40 and placed.select("f").distinct().count() == 4


def test_shared_pathways_meet_the_strongest(spark, joins_shuffled):
    """Seeds and members of one pathway: each seed's best by hand, equal scores by name, without all pairs being made."""
    rng = random.Random(5)
    strength = {f"gene::G{i}": rng.choice((0.5, 0.6, 0.6 + 1e-16, 0.7, 0.9)) for i in range(900)}
    other = {g: rng.random() for g in list(strength)[::3]}
    rows = [(g, p, s) for p, of in (("pathway::a", strength), ("pathway::b", other)) for g, s in of.items()]
    edges = graph.cut(spark.createDataFrame([(g, "participates", p, s, s) for g, p, s in rows], "head string, relation string, tail string, weight double, confidence double"))
    seeds = spark.createDataFrame([(g,) for g in list(strength)[:300]], "seed string")
    got, rows = shuffled_rows(spark, lambda: build.shared_pathway(edges, seeds, cap=7).collect())
    found = {}
    for r in got:
        found.setdefault(r["seed"], []).append((r["place"], r["other"], r["pathway"]))
    for seed in list(strength)[:300:23]:
        best = []
        for g in strength:
            mine = [(math.sqrt(of[seed] * of[g]), p) for p, of in (("pathway::a", strength), ("pathway::b", other)) if seed in of and g in of and min(of[seed], of[g]) >= 0.45]
            if g != seed and mine and max(mine)[0] >= 0.5:
                best.append((-max(mine)[0], g, max(mine)[1]))
        assert sorted(found[seed]) == [(i, g, p) for i, (_, g, p) in enumerate(sorted(best)[:7], 1)]
    assert rows < 20_000  # pairs are over 300,000


def test_components_shuffle_few_rows(spark, joins_shuffled):
    """Dense graphs side by side, null and lone names among them: components by hand, edges shuffled about twice."""
    pairs = [(f"{c}{i:02}", f"{c}{j:02}") for c in "abc" for i in range(60) for j in range(60)] + [("a00", "x"), ("y", "y"), ("z", None), ("q", "p")]
    edges = graph.cut(spark.createDataFrame(pairs, "head string, tail string"))
    got, rows = shuffled_rows(spark, lambda: {r["name"]: r["component"] for r in graph.components(edges).collect()})
    assert got == {n: f"{n[0]}00" for n in {x for p in pairs for x in p if x and x[0] in "abc"}} | {"x": "a00", "y": "y", "z": "z", "p": "p", "q": "p", None: None}
    assert rows < 2 * len(pairs)  # every round shuffled all of them


def test_dedup_sends_columns_once(spark, joins_shuffled):
    """What meets by key has the key once and the other columns once."""
    rows = spark.range(20_000).selectExpr("concat('gene::', id) AS head", "'acts' AS relation", "concat('protein::', id) AS tail", "'s' AS source", "'v1' AS version", "rand(1) AS weight", "0.5D AS confidence")
    rows = graph.cut(rows.unionByName(rows.withColumn("weight", F.col("weight") + 1)))
    made = build.dedup_triples(rows, ["weight", "confidence"])
    assert made.columns == rows.columns and made.count() == 20_000 and made.agg(F.max("weight")).first()[0] < 1
    aggregates = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert len(aggregates) == 1 and "min_by" not in aggregates[0] and "version" not in aggregates[0].split("AS _r")[0].split("min(")[1]


def test_pathway_baseline_shuffles_no_pairs(spark, joins_shuffled):
    """Every seed with every gene that it shares pathways with, by hand; 130,000 pairs come out and none is shuffled."""
    of = {f"g{i}": {"a"} | ({"b"} if i % 3 == 0 else set()) | ({f"own{i}"} if i % 50 == 0 else set()) for i in range(1_300)} | {"lone": {"c"}}
    edges = graph.cut(spark.createDataFrame([(g, "participates", p) for g, own in of.items() for p in own] * 2, "head string, relation string, tail string"))
    seeds = [f"g{i}" for i in range(0, 1_300, 13)] + ["lone", "none"]
    got, rows = shuffled_rows(spark, lambda: evaluate.pathway_baseline(edges, spark.createDataFrame([(s,) for s in seeds], "seed string")).collect())
    want = {(s, g): len(of[s] & of[g]) for s in seeds if s in of for g in of if s != g and of[s] & of[g]}
    assert len(got) == len(want) and {(r["seed"], r["gene"]): r["common"] for r in got} == want
    assert rows < 30_000


def test_walks_end_as_lists(spark, joins_shuffled, monkeypatch):
    """Walks to a node that leads nowhere are shuffled as lists and not one by one, and long lists are cut without loss."""
    arcs = [(f"sample::{s}", f"gene::{g}", 1.0) for s in range(30) for g in range(30)] + [(f"gene::{g}", f"protein::{g}_{p}", (p + 1) / 60) for g in range(30) for p in range(60)]
    edges = graph.cut(spark.createDataFrame(arcs, "head string, tail string, weight double").withColumns({"confidence": F.lit(1.0), "effect_sign": F.lit(-1.0)}))
    origins = spark.createDataFrame([(f"sample::{s}",) for s in range(30)], "origin string")
    want = {(f"sample::{s}", n): (h, w, d) for s in range(30) for g in range(30) for n, h, w, d in [(f"gene::{g}", 1, 1.0, -1.0)] + [(f"protein::{g}_{p}", 2, (p + 1) / 60, 1.0) for p in range(60) if 0.78 * (p + 1) / 60 >= 0.1]}
    for stretch in (1024, 7):
        monkeypatch.setattr(graph, "STRETCH", stretch, raising=False)
        got, rows = shuffled_rows(spark, lambda: graph.ranked_candidates(edges, origins, min_score=0.1).collect())
        assert {(r["origin"], r["node"]): (r["hops"], r["raw_signal"], r["direction_sign"]) for r in got} == want and len(got) == len(want)
        assert rows < len(want)  # each walk was a row before


def test_counts_stay_with_documents(spark, monkeypatch):
    """Terms are counted and weighed where a document lies, rare ones joined by term; an id of two rows is one document."""
    rng = random.Random(8)
    texts = [(i, " ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(150))) for i in range(200)] + [(3, "w1 unseen")]
    asked = [(q, " ".join(f"w{rng.randrange(300)}" for _ in range(12))) for q in range(6)]
    count = lambda rows: {i: Counter(" ".join(t for j, t in rows if j == i).split()) for i, _ in rows}
    tf = count(texts)
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        raw = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    weights = {i: unit(c) for i, c in tf.items()}
    want = {(i, t): w for i, ws in weights.items() for t, w in ws.items()}
    best = {(q, i): sum(x * weights[i].get(t, 0.0) for t, x in unit(c).items()) for q, c in count(asked).items() for i in weights}
    top = {(q, i) for q, _ in asked for i in sorted(weights, key=lambda i: (-round(best[q, i], 9), -i))[:5]}
    docs, queries = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    for known in (100_000, 40):
        monkeypatch.setattr(retrieval, "MAX_KNOWN", known, raising=False)
        got, rows = shuffled_rows(spark, lambda: retrieval.tfidf(docs).collect())
        assert {(r["doc_id"], r["term"]): r["weight"] for r in got} == pytest.approx(want) and len(got) == len(want)
        assert rows < len(want)  # each count was shuffled before
        found, rows = shuffled_rows(spark, lambda: retrieval.search(docs, queries).collect())
        assert {(r["query_id"], r["doc_id"]) for r in found} == top and rows < len(want)


def test_predictions_shuffle_their_own_part(spark):
    """A pair's prediction shuffles what its two anchors come to, not the rest of the graph; labels of numbers still look both ways."""
    near = [("sample::S1", "expresses", "gene::ABCD"), ("sample::S1", "expresses", "gene::7157"), ("gene::ABCD", "activates", "protein::P1"),
            ("gene::ABCD", "participates", "pathway::W"), ("pathway::perturbation::KO_ABCD", "targets_gene", "gene::ABCD"), ("gene::TPX", "inhibits", "gene::7157")]
    far = [(f"sample::F{i}", "expresses", f"gene::G{i % 97}X") for i in range(3_000)] + [(f"gene::G{i % 97}X", "activates", f"protein::Q{i}") for i in range(3_000)]
    rows = [(*e, 0.9, 0.9, 1.0) for e in near + far]
    edges = graph.cut(spark.createDataFrame(rows, "head string, relation string, tail string, weight double, confidence double, effect_sign double"))
    seeds = spark.createDataFrame([("ABCD",)], "gene string")
    made, sent = shuffled_rows(spark, lambda: (lambda p: (p.genes.collect(), p.pathways.collect(), p.proteins.collect()))(predict.predict(edges, seeds, "sample::S1", "KO_ABCD")))
    assert {r["label"] for r in made[0]} == {"ABCD", "TPX"}
    assert [r["node"] for r in made[1]] == ["pathway::W"] and [r["node"] for r in made[2]] == ["protein::P1"]
    assert sent < 1_000  # far more edges lie elsewhere


def test_around(spark):
    """Walks of a graph with cycles and nulls are the same over the part that they can take."""
    rng = random.Random(5)
    arcs = [(f"gene::{rng.randrange(60)}", f"gene::{rng.randrange(60)}", rng.random(), 1.0, rng.choice((-1.0, 1.0))) for _ in range(90)] + [(None, "gene::1", 1.0, 1.0, 1.0), ("gene::1", None, 1.0, 1.0, 1.0)]
    edges = spark.createDataFrame(arcs, "head string, tail string, weight double, confidence double, effect_sign double")
    origins = spark.createDataFrame([("gene::1",), ("gene::2",), (None,)], "origin string")
    for hops in (1, 2, 3):
        part = graph.around(edges, origins, hops)
        walks = lambda e, hops=hops: sorted(map(tuple, graph.ranked_candidates(e, origins.dropna(), hops, 0.001).collect()))
        assert walks(part) == walks(edges) and part.count() < edges.count()


def test_equal_queries_are_searched_once(spark, joins_shuffled):
    """Queries that differ only in terms that no document has meet the documents once, and all get the same hits."""
    docs = spark.createDataFrame([(i, "alpha beta " + "gamma " * (i % 7)) for i in range(200)], "doc_id long, text string")
    asked = [(q, f"alpha gamma unknown{q}" if q % 2 else "beta") for q in range(300)] + [(300, "alpha alpha gamma"), (301, "nothing")]
    found, sent = shuffled_rows(spark, lambda: retrieval.search(docs, spark.createDataFrame(asked, "query_id long, query string"), 3).collect())
    hits = {}
    for r in sorted(found, key=lambda r: r["place"]):
        hits.setdefault(r["query_id"], []).append((r["doc_id"], r["similarity"]))
    assert set(hits) == set(range(302)) and all(len(h) == 3 for h in hits.values())
    assert all(hits[q] == hits[q % 2] for q in range(300)) and hits[300] != hits[1] and hits[301] == [(199, 0.0), (198, 0.0), (197, 0.0)]
    alone = retrieval.search(docs, spark.createDataFrame([asked[1]], "query_id long, query string"), 3).collect()
    assert hits[1] == [(r["doc_id"], r["similarity"]) for r in sorted(alone, key=lambda r: r["place"])]
    assert sent < 15_000  # 300 queries of 200 documents are 60,000 pairs


def test_pathway_baseline_is_dealt_out(spark):
    """Few genes of a pathway make many pairs: not one task makes them all, and none is lost."""
    edges = spark.createDataFrame([(f"gene::{g}", "participates", f"pathway::{p}") for g in range(2_000) for p in {0, g % 3}], "head string, relation string, tail string")
    seeds = spark.createDataFrame([(f"gene::{g}",) for g in range(0, 40)], "seed string")
    made = evaluate.pathway_baseline(edges, seeds)
    got = Counter(r["common"] for r in made.collect())
    both = sum(1 for s in range(40) for g in range(2_000) if s != g and s % 3 and s % 3 == g % 3)
    assert sum(got.values()) == 40 * 1_999 and got[2] == both
    assert made.select(F.spark_partition_id().alias("task"), "common").groupBy("task").count().count() >= 4


def test_walks_are_dealt_by_their_number(spark, monkeypatch):
    """Many walks go to more tasks than there are shuffle partitions, with the same result."""
    rng = random.Random(8)
    arcs = [(f"sample::{rng.randrange(40)}", f"gene::{rng.randrange(30)}") for _ in range(300)] + [(f"gene::{g}", f"protein::{rng.randrange(50)}") for g in range(30) for _ in range(20)]
    edges = graph.cut(spark.createDataFrame([(*a, rng.random(), 1.0, rng.choice((-1.0, 1.0))) for a in arcs], "head string, tail string, weight double, confidence double, effect_sign double"))
    origins = edges.select(F.col("head").alias("origin")).distinct()
    plain = sorted(map(tuple, graph.ranked_candidates(edges, origins).collect()))
    monkeypatch.setattr(graph, "WALKS", 100)
    made = graph.ranked_candidates(edges, origins)
    assert sorted(map(tuple, made.collect())) == plain
    assert made.select(F.spark_partition_id().alias("task")).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
