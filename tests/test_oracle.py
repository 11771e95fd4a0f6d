"""Every query with SQL is held against DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import pytest

from quarrystone import queries

DIR = "/root/testdata/sf0.001"
SQL = queries.all_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return round(v, 6) if isinstance(v, float) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = queries.all_queries()[name](spark, DIR)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[name])
    assert got == table([c[0] for c in res.description], res.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.all_queries()) - set(SQL)))
def test_other_queries_run(spark, name):
    rows = queries.all_queries()[name](spark, DIR).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries.all_queries())
