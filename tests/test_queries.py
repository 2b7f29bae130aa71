"""Every registered query with a SQL twin gives the twin's rows on the smallest tables."""

import collections
import os

import duckdb
import pytest

from larkspur.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, list):
        return tuple(map(value, v))
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def check(spark, duck, queries, sql, name):
    df = queries[name](spark, FOLDER)
    names = sorted(df.columns)
    got = collections.Counter(tuple(value(r[c]) for c in names) for r in df.collect())
    rows = duck.sql(sql[name])
    assert sorted(rows.columns) == names
    at = [rows.columns.index(c) for c in names]
    assert got == collections.Counter(tuple(value(r[i]) for i in at) for r in rows.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    check(spark, duck, catalog.queries(), catalog.oracle_sql(), name)


def test_every_query_has_a_twin():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
