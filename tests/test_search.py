"""The name index against scans of all edges, and what it reads."""

import random
import re

import pytest
from lattica.operators import graph, search
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(6)
    names = [f"{t}::{n}{i}" for t, n in (("gene", "AB"), ("Gene", "ab"), ("protein", "Éa"), ("pathway", "long name ")) for i in range(60)] + ["x", "", "AB", "gene::%_", None]
    rows = [(rng.choice(names), rng.choice(["activates", "inhibits", "INHIBITS_too"]), rng.choice(names), "s", "v", float(rng.randint(0, 3)), 0.5, 0.0) for _ in range(900)]
    rows += rows[:20] + [("gene::AB7", "activates", "gene::AB7", "s", "v", 1.0, 0.5, 0.0)]
    return spark.createDataFrame(rows, "head string, relation string, tail string, source string, version string, weight double, confidence double, effect_sign double")


@pytest.fixture(scope="module")
def index(edges, tmp_path_factory):
    return search.NameIndex.build(edges, str(tmp_path_factory.mktemp("index") / "names"))


def shown(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("node, relation, mode", [
    ("ab1", "", "and"), ("GENE::AB", "", "and"), ("éA5", "inhib", "and"), ("b1", "", "and"), ("x", "ACT", "and"), ("nothing here", "", "and"), ("%_", "", "and"), ("g name 3", "too", "or"), ("", "too", "and"), ("", "", "or"), ("::", "", "or")])
def test_match(edges, index, node, relation, mode, monkeypatch):
    want = shown(graph.keyword_match(edges, node, relation, mode))
    assert shown(index.match(node, relation, mode)) == want
    monkeypatch.setattr(search, "MAX_PUSHED", 0)
    assert shown(index.match(node, relation, mode)) == want


def test_subgraph_and_stats(edges, index):
    for args in (("ab1", "", "and"), ("ab", "inhib", "and"), ("zzz", "", "and")):
        assert shown(index.subgraph(*args, max_nodes=12, max_edges=40)) == shown(graph.keyword_subgraph(edges, *args, max_nodes=12, max_edges=40))
        assert index.stats(*args).collect() == graph.match_stats(edges, *args).collect()


def test_reads_are_pruned(spark, tmp_path, monkeypatch):
    """Of many files of the index only those with the rarest gram and the keys found are read."""
    rows = [(f"gene::G{i:05d}", "activates", f"protein::Q{i % 977:05d}", "s", "v", 1.0, 0.5, 0.0) for i in range(20_000)]
    edges = spark.createDataFrame(rows, "head string, relation string, tail string, source string, version string, weight double, confidence double, effect_sign double")
    monkeypatch.setattr(search, "ROWS_PER_FILE", 1_000)
    index = search.NameIndex.build(edges, str(tmp_path / "names"))

    def rows_read(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(key", plan)
        total, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
                continue
            if node.nodeName().startswith("Scan"):
                total += node.metrics().apply("numOutputRows").value()
            if "QueryStage" in node.nodeName():
                todo.append(node.plan())
            todo += [node.children().apply(k) for k in range(node.children().size())]
        return total

    found = index.match("g00123")
    assert found.count() == 1 and rows_read(index.match("g00123")) < 20_000 * 2 / 10
    assert index.names("g00123").count() == 1


def test_edges_are_made_once(spark, edges, tmp_path):
    """Building reads the edges' own plan once, however many tables and ranges come from them."""
    made = spark.sparkContext.accumulator(0)

    def seen(head):
        made.add(1)
        return head

    counted = edges.withColumn("head", F.udf(seen, "string").asNondeterministic()("head"))
    search.NameIndex.build(counted, str(tmp_path / "names"))
    assert made.value == edges.count()


def test_hub_lies_across_files(spark, tmp_path, monkeypatch):
    """Files stay small and hold narrow ranges, but the edges of one name aren't one task's, and ranges are bounded in number."""
    rows = [("gene::HUB" if i % 2 else f"gene::G{i:05d}", "activates", f"protein::Q{i:05d}", "s", "v", 1.0, 0.5, 0.0) for i in range(8_000)]
    edges = spark.createDataFrame(rows, "head string, relation string, tail string, source string, version string, weight double, confidence double, effect_sign double")
    monkeypatch.setattr(search, "ROWS_PER_FILE", 500)
    for ranges in (200, 4):
        monkeypatch.setattr(search, "MAX_RANGES", ranges)
        index = search.NameIndex.build(edges, str(tmp_path / f"names{ranges}"))
        of_file = index.table("out").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.count_if(F.col("key") == "gene::hub").alias("hub")).orderBy("low", "high").collect()
        assert len(of_file) == min(ranges, 17) and sum(r["n"] for r in of_file) == 8_000
        assert max(r["hub"] for r in of_file) < 3_000
        assert all(a["high"] <= b["low"] for a, b in zip(of_file, of_file[1:]))
        assert shown(index.match("hub")) == shown(graph.keyword_match(edges, "hub"))


def test_no_edges(edges, tmp_path):
    index = search.NameIndex.build(edges.limit(0), str(tmp_path / "names"))
    assert index.match("ab1").count() == index.match("a").count() == index.names("ab1").count() == 0
