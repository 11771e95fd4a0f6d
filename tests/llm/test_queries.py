import glob
import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", ["p2_counts", "p2_found", "p2_links", "p6_found", "p6_items"])
def test_query_equals_sql(spark, con, name):
    from quarrystone.llm.queries import QUERIES, SQL

    df = QUERIES[name](spark, DIR)
    res = con.execute(SQL[name])
    assert df.columns == [c[0] for c in res.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, res.fetchall()))


@pytest.mark.parametrize("name", ["p4_subset", "p4_coverage", "p6_clean", "p7_mix", "p7_shares", "p8_found", "p8_rates"])
def test_other_queries_give_rows(spark, name):
    from quarrystone.llm.queries import QUERIES

    assert QUERIES[name](spark, DIR).count() > 0
