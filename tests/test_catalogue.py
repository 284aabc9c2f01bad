"""Every query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from ontoloom.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"q55_align_vectors"}


def value(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else tuple(map(value, x)) if isinstance(x, list) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    got = df.select(*columns).collect()
    assert sorted(map(repr, (tuple(map(value, r)) for r in got))) == sorted(map(repr, (tuple(map(value, r)) for r in want)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
