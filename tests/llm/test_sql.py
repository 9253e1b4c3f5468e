"""Queries of the training-data operators against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from lattica.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = ", ".join(f'"{c}"' for c in got.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, duck.execute(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall()))
