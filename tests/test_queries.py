"""Every query of the graph library against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from lattica.plans import formats, loads  # noqa: F401  add their queries
from lattica.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def compare(df, duck, sql):
    names = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in names)} FROM ({sql})").fetchall()
    got = [tuple(map(same, r)) for r in df.select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(map(same, r))) for r in want)
    return len(got)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    compare(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
