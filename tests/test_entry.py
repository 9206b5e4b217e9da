"""Every registered query of the engine against its SQL."""

import duckdb
import pytest

import __spark_entry__
from millrace import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    rel = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(x[names.index(c)] for c in cols)) for x in rel.fetchall())
    assert got == want
    spark.catalog.clearCache()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
