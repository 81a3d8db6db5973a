"""Registered queries against their SQL on the smallest tables."""

import os
import math

import duckdb
import pytest

import __spark_entry__ as entry
from geostrata import queries

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{round(float(v), 5) + 0.0:.5f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    sql = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in sql.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(same(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(map(same, r)) for r in sql.fetchall())


def test_others_have_brute_force():
    """The queries that SQL can't express; test_outputs.py and test_density.py hold their operators against plain Python."""
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"subareas_hdbscan", "skater_regions", "hdbscan_labels", "boundaries"}


def test_entry(spark):
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
