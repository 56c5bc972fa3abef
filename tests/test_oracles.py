"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from matchspark import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return round(float(v), 6) if isinstance(v, (decimal.Decimal, int)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cur = duck.execute(ORACLES[name])
    named = [c[0] for c in cur.description]
    assert sorted(named) == columns
    want = sorted(repr([plain(r[named.index(c)]) for c in columns]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
