"""Registered queries against their SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from inkstone.plans.queries import ALL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", list(ALL))
def test_same_as_sql(spark, duck, name):
    query, sql = ALL[name]
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = sorted(([r[c] for c in cols] for r in df.collect()), key=str)
    rel = duck.sql(sql)
    want = sorted(([row[rel.columns.index(c)] for c in cols] for row in rel.fetchall()), key=str)
    assert got == want
