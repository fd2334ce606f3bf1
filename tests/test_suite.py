"""Every query that has a SQL counterpart, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools_check import TABLES, normal

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_every_counterpart_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    rel = con.sql(SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    ours = normal([tuple(r[c] for c in cols) for r in df.collect()])
    theirs = normal([tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()])
    assert ours == theirs
