"""Queries with SQL twins, on the smallest tables."""

import os

import pytest

from larkspur.llm import queries as Q

from ..test_queries import FOLDER, check, duck  # noqa: F401


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, name):  # noqa: F811
    check(spark, duck, Q.queries(), Q.oracle_sql(), name)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    assert Q.queries()[name](spark, FOLDER).count() >= 0
