"""Every registered query with SQL against DuckDB, and the rest for a stable schema."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from spark_filings.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, DATA)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rounded(map(tuple, got.select(*want.columns).collect())) == rounded(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(__spark_entry__.queries())
