"""Every query with SQL gives the rows DuckDB gives, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from featurespark import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.8g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.8g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert set(entry.oracle_sql()) <= set(entry.queries())
