"""Every query against its SQL."""

import pytest
from oracle_check import connect, mismatch

import __spark_entry__ as entry

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALLEST)


def test_every_query_has_sql():
    assert set(entry.graph_queries()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.graph_queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SMALLEST)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "InArrow"):
        assert bad not in plan, plan
    assert mismatch(df, con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "rank", "pos"] and df.count() == 200
