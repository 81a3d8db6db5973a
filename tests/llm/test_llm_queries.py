"""The operators' queries against their SQL."""

import os
import duckdb
import pytest

from geostrata.llm import queries

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    sql = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in sql.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(str, (r[c] for c in names))) for r in df.collect()) == sorted(tuple(map(str, r)) for r in sql.fetchall())
