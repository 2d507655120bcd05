"""Every registered query: equal to its SQL, JVM-side only, no product of two tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import compare
from checks.oracle import oracle_sql
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"
ORACLE = oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    assert compare(df, SF, ORACLE[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
