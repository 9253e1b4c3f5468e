"""Manifests as tables and graphs that load themselves."""

import json
import random

from lattica.operators import evaluate, graph
from lattica.sources import bootstrap, catalog, snapshots
from pyspark.sql import functions as F

ENTRY = "n long, name string, source string, status string"


def upserted(old, new):
    out = {}
    for _, name, source, status in sorted(old, key=lambda e: e[0]) + sorted(new, key=lambda e: e[0]):
        out[name] = (source, status)  # a dict keeps a key's first place
    return [(name, *e) for name, e in out.items()]


def test_upsert(spark):
    """Against a dict, names repeated in both tables, numbers of both overlapping or apart, and with either side empty."""
    rng = random.Random(3)
    made = lambda n, first: [(first + i, f"e{rng.randrange(8)}", str(rng.random()), rng.choice(["ok", "failed", None])) for i in range(n)]
    for old, new in ((made(12, 0), made(9, 0)), (made(5, 40), made(9, -7)), ([], made(6, 5)), (made(6, 5), []), ([], [])):
        got = catalog.upsert(spark.createDataFrame(old, ENTRY), spark.createDataFrame(new, ENTRY)).orderBy("n").select("name", "source", "status")
        assert list(map(tuple, got.collect())) == upserted(old, new)
        good = catalog.prune(got)
        assert list(map(tuple, good.collect())) == [e for e in upserted(old, new) if e[2] != "failed"]


def test_round_trip_and_arrival(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"other")
    sha = hashlib.sha256(b"one").hexdigest()
    entries = [{"name": "a", "path": str(tmp_path / "a.txt"), "sha256": sha.upper(), "note": "unknown keys go"}, {"name": "b", "path": f"file://{tmp_path}/b.txt", "sha256": sha}, {"name": "c", "path": str(tmp_path / "c.txt"), "status": "ok"}, {"name": "d", "path": str(tmp_path / "in" / "a.txt")}, {"name": "e"}]
    (tmp_path / "m.json").write_text(json.dumps({"datasets": entries}))
    read = catalog.read(spark, str(tmp_path / "m.json"))
    catalog.write(read, str(tmp_path / "again"))
    assert catalog.read(spark, str(tmp_path / "again")).orderBy("n").collect() == read.orderBy("n").collect() and read.count() == 5
    got = catalog.arrived(read, str(tmp_path / "{*.txt,in/*.txt}")).orderBy("n").select("name", "status", "bytes")
    assert list(map(tuple, got.collect())) == [("a", "ok", 3), ("b", "damaged", 3), ("c", "missing", None), ("d", "ok", 5), ("e", "missing", None)]


def test_bootstrap(spark, tmp_path):
    at = str(tmp_path / "graph")
    nodes, edges = bootstrap.available_graph(spark, at, str(tmp_path / "none.csv"))
    assert nodes.count() == edges.count() == 0 and snapshots.current(spark, at) is None
    csv = tmp_path / "t.csv"
    csv.write_text("head,tail,weight,more,evidence\n gene::A ,Cell::b,,x,\"said \"\"so\"\",\nover two lines\"\ngene::A,,1,x,y\n,gene::B,1,x,y\ngene::C,protein::D,much,x,\ngene::C,protein::D,0,x,\n")
    nodes, edges = bootstrap.available_graph(spark, at, str(csv))
    csv.unlink()
    again = bootstrap.available_graph(spark, at, str(csv))
    for n, e in ((nodes, edges), again):
        assert sorted(map(tuple, n.select("name", "is_seed").collect())) == [(x, False) for x in ("Cell::b", "gene::A", "gene::C", "protein::D")]
        got = sorted(map(tuple, e.select("head", "relation", "weight", "confidence", "effect_sign", "source", "evidence").collect()))
        assert got == [("gene::A", "associated_with", 1.0, 0.5, 1.0, "unknown", 'said "so",\nover two lines'), ("gene::C", "associated_with", 0.0, 0.5, 1.0, "unknown", ""), ("gene::C", "associated_with", 1.0, 0.5, 1.0, "unknown", "")]


def test_quality_of_an_empty_graph(spark):
    edges = spark.createDataFrame([], "head string, relation string, tail string, source string, weight double, confidence double, effect_sign double")
    got = {r["part"]: r["score"] for r in evaluate.quality(edges, graph.node_table(edges), spark.createDataFrame([], "gene string")).collect()}
    assert got == {"structure": 0.0, "omics": 0.0, "semantic": 0.0, "connectivity": 12.0, "perturbation": 0.0, "consistency": 2.0, "total": 14.0}


def test_unexpected_keys(spark):
    rows = spark.createDataFrame([('{"a":1,"b":{"c":2}}',), ('{"b":1}',), ("[1]",), ("no json",), ("",), (None,)], "p string")
    assert evaluate.unexpected_keys(rows, "p", ("a",)).collect() == [("b", 2)]
    assert evaluate.unexpected_keys(rows.filter(F.lit(False)), "p", ()).count() == 0
