"""Streams across batches, and what readers see while tables are replaced."""

import random

import pytest
from lattica.sources import sinks, snapshots
from lattica.streaming import micro

TRIPLE = "head string, relation string, tail string, source string, version string, evidence string, weight double, confidence double, effect_sign double"


def write(spark, rows, path):
    made = spark.createDataFrame([(h, r, t, "s", "v1", "{}", w, 0.5, 0.0) for h, r, t, w in rows], TRIPLE)
    made.coalesce(1).write.mode("append").parquet(path)


def shown(spark, path):
    return sorted(map(tuple, micro.read_edges(spark, path).select("head", "relation", "tail", "weight").collect()))


def test_copies_in_other_batches(spark, tmp_path):
    """Twelve batches of the same size: of each key the least row of its first batch stays; a batch updates its own keys only."""
    source, path, rng = str(tmp_path / "in"), str(tmp_path / "out"), random.Random(1)
    words = ["activates", "stimulates", "up-regulates", "inhibits", None]
    files = [[(f"gene::{rng.randint(0, 60)}", rng.choice(words), f"gene::{rng.randint(0, 3)}", float(rng.randint(1, 9))) for _ in range(50)] for _ in range(12)]
    first = {}
    for part in (files[:5], files[5:]):  # the second run goes on with the first one's load
        for rows in part:
            write(spark, rows, source)
        batches = micro.run_stream(spark, source, TRIPLE, path, canonical=False)
        assert len([b for b in batches if b["numInputRows"]]) == len(part)
        for b in batches:
            state = b["stateOperators"][0]
            state = state if isinstance(state, dict) else state.__dict__
            assert (state.get("numRowsUpdated", state.get("_numRowsUpdated"))) <= 50

    for rows in files:
        fresh = {}
        for h, r, t, w in rows:
            if (h, r, t) not in first:
                fresh[h, r, t] = min(w, fresh.get((h, r, t), 99.0))
        first |= fresh
    got = {(h, r, t): w for h, r, t, w in map(tuple, micro.read_edges(spark, path).select("head", "relation", "tail", "weight").collect())}
    assert got == first and snapshots.current(spark, path)[1] == 12
    names = {r["name"] for r in micro.read_nodes(spark, path).collect()}
    assert names == {k[0] for k in first} | {k[2] for k in first}


def test_replace_is_all_or_nothing(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        micro.read_edges(spark, path)
    write(spark, [("gene::A", "activates", "gene::B", 1.0)], source)
    micro.run_stream(spark, source, TRIPLE, path)
    old = shown(spark, path)
    seen = []

    def watched(rows):
        seen.append(shown(spark, path))  # a reader while the batch is under way
        if len(seen) == 3:
            raise ValueError("the third batch fails")
        return rows

    for w in (2.0, 3.0):
        write(spark, [(f"gene::N{w}", "activates", "gene::B", w)], source)
    with pytest.raises(Exception, match="the third batch fails"):
        micro.run_stream(spark, source, TRIPLE, path, normalise=watched, replace=True)
    two = shown(spark, path)
    assert seen[0] == old and len(seen[1]) == 1 and len(seen[2]) == 2 == len(two) and snapshots.current(spark, path)[1] == 2
    micro.run_stream(spark, source, TRIPLE, path)  # goes on where the failed one stopped
    assert len(shown(spark, path)) == 3


def test_replace_graph_keeps_its_readers(spark, tmp_path):
    path = str(tmp_path / "graph")
    rows = lambda n: spark.createDataFrame([(f"gene::{k}", "activates", "gene::0", 1.0) for k in range(n)], "head string, relation string, tail string, weight double")
    sinks.replace_graph(rows(4).select("head"), rows(4), path)
    reader = snapshots.read(spark, path, "edges")
    sinks.replace_graph(rows(9).select("head"), rows(9), path)
    assert reader.count() == 4 and snapshots.read(spark, path, "edges").count() == 9 == snapshots.read(spark, path, "nodes").count()
    broken = rows(5).selectExpr("head", "relation", "tail", "raise_error('no') AS weight")
    with pytest.raises(Exception, match="no"):
        sinks.replace_graph(rows(5).select("head"), broken, path)
    assert snapshots.read(spark, path, "edges").count() == 9
    sinks.replace_graph(rows(2).select("head"), rows(2), path)
    assert len(list((tmp_path / "graph").glob("load-*"))) == 2


def test_a_batch_is_written_once(spark, tmp_path, monkeypatch):
    """A batch that needs no rules goes to the graph's tables alone, and state holds a row's key once; rows of equal weight are told apart by their other columns."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("gene::A", "activates", "gene::B", "s", "v1", e, 0.5, 0.5, 0.0) for e in ("z", "k", "m")]
    spark.createDataFrame(rows, TRIPLE).coalesce(1).write.parquet(source)
    held = micro.first_rows(spark.read.parquet(source))._jdf.queryExecution().analyzed().toString()
    assert "head#" in held and "struct(weight" in held and "struct(head" not in held

    def never(df):
        raise AssertionError("a second copy of the batch")

    monkeypatch.setattr(micro, "cut", never)
    micro.run_stream(spark, source, TRIPLE, path)
    assert [tuple(r) for r in micro.read_edges(spark, path).select("head", "relation", "tail", "evidence").collect()] == [("gene::A", "activates", "gene::B", "k")]
    assert {r["name"] for r in micro.read_nodes(spark, path).collect()} == {"gene::A", "gene::B"}
