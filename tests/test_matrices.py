"""Sparse matrices and chunks: what is never made dense, and what is read once."""

import random
import re

import pytest
from lattica.operators import build, graph
from lattica.sources import files


def market(tmp_path, rng, n_rows, n_columns, cells):
    at = rng.sample([(r, c) for r in range(1, n_rows + 1) for c in range(1, n_columns + 1)], cells)
    lines = ["%%MatrixMarket matrix coordinate real general", "% made up", f"{n_rows} {n_columns} {cells}"] + [f"{r} {c} {rng.choice([0, 0.5, 1, 2.5, -1, -3])}" for r, c in at]
    (tmp_path / "m.mtx").write_text("\n".join(lines) + "\n")
    (tmp_path / "rows.tsv").write_text("".join(f"g{rng.random():.6f}\tx\n" for _ in range(n_rows)))
    return str(tmp_path / "m.mtx"), str(tmp_path / "rows.tsv")


@pytest.mark.parametrize("n_rows, n_columns, cells", [(12, 6, 30), (5, 4, 20), (30, 5, 3), (4, 3, 0)])
def test_top_of_sparse(spark, tmp_path, n_rows, n_columns, cells):
    path, rows_path = market(tmp_path, random.Random(cells), n_rows, n_columns, cells)
    stored, rows, columns = files.market_cells(spark, path, rows_path)
    dense = files.matrix_market(spark, path, rows_path)
    assert dense.count() == n_rows * n_columns
    for k in (1, 4, n_rows + 3):
        for threshold, strict in ((None, False), (0.0, False), (0.0, True), (-2.0, True)):
            want = build.top_per_sample(dense, k, threshold, strict=strict)
            got = build.top_of_sparse(stored, rows, columns, k, threshold, strict)
            show = lambda df: sorted((r["sample"], r["place"], r["entity"], r["value"] + 0.0) for r in df.collect())
            assert show(got) == show(want)
    with pytest.raises(ValueError):
        build.top_of_sparse(stored, rows, columns, 0)


def test_sparse_nan_and_null(spark):
    stored = spark.createDataFrame([("b", "s", float("nan")), ("c", "s", None), ("d", "s", -1.0), ("e", "s", 2.0)], "entity string, sample string, value double")
    names = spark.createDataFrame([(x,) for x in "abcde"], "label string")
    got = build.top_of_sparse(stored, names, spark.createDataFrame([("s",), ("t",)], "label string"), 5).collect()
    assert sorted((r["sample"], r["place"], r["entity"]) for r in got) == [*(("s", k + 1, e) for k, e in enumerate("eadbc")), *(("t", k + 1, e) for k, e in enumerate("abcde"))]


def test_numbers_follow_order(spark):
    rng = random.Random(5)
    names = [f"{rng.random():.9f}" for _ in range(500)]
    got = graph.in_order(spark.createDataFrame([(x,) for x in names], "x string").repartition(7), "x").collect()
    assert sorted((r["i"], r["x"]) for r in got) == [(k + 1, x) for k, x in enumerate(sorted(names))]


def test_chunks_read_their_folders(spark):
    long = spark.createDataFrame([(n, f"G{i}", f"s{j}", float(i * j % 7)) for n in "de" for i in range(9) for j in range(40)] + [("unknown", "G", "s", 1.0)], "name string, entity string, sample string, value double")
    spec = spark.createDataFrame([("d", "expression", "d", "v", 3, 0.1, 0.7), ("e", "cnv", "e", "v", 0, 0.1, 0.7)], "name string, modality string, source string, version string, top_k int, min_value double, confidence double")
    for chunk in (0, 50, 100, 1):
        parts = list(files.omics_chunks(long, spec, chunk, slots=16))
        assert sorted(map(repr, build.omics_triples(long, spec).collect())) == sorted(repr(r) for p in parts for r in p.collect())
        assert len(parts) == 2 if chunk == 0 else len(parts) > 4
        for p in parts:
            plan = p._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"PartitionFilters: \[[^\]]*name[^\]]*slot", plan)
