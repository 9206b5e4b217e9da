"""The registered queries against their SQL, on the driver's smallest tables."""

import duckdb
import pytest

from millrace.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    rel = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols and len(got) > 0
    assert got == sorted(repr(tuple(x[names.index(c)] for c in cols)) for x in rel.fetchall())
