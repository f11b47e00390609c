"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import registry


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        at = f"{small}/{f}" if os.path.isfile(f"{small}/{f}") else f"{small}/{f}/*.parquet"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{at}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    out = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
