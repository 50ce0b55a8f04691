"""Every named query with a SQL twin, both sides over the smallest supplied tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from oracle_check import compare, duck

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(con, QUERIES[name](spark, SMALL), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_returns_rows(spark, name):
    assert len(QUERIES[name](spark, SMALL).collect()) > 0


def test_entry(spark):
    assert len(entry.entry(spark).collect()) > 0


def test_no_query_uses_a_cross_join(spark):
    for name in ("tag_rates", "stability_index", "resume_merge", "feature_class_counts", "lift"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
