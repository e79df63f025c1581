"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [df.columns.index(c) for c in want.columns]
    got = sorted((tuple(plain(r[i]) for i in at) for r in df.collect()), key=repr)
    assert got == sorted((plain(r) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
