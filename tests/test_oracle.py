"""Every registered query against its SQL on the smallest supplied tables."""

import pytest

from check_results import connect, differences
from quarterwise.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def newest(spark):
    """The id of the last execution so far; Spark keeps a bounded list, so places in it mean nothing."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    listed = store.executionsList(max(store.executionsCount() - 1, 0), 1)
    return listed.apply(0).executionId() if listed.size() else -1


def executed_after(spark, last):
    """Texts of the physical plans of executions newer than `last`, read from the end of the list."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans, at, step = [], store.executionsCount(), 32
    while at > 0:
        low = max(at - step, 0)
        listed = store.executionsList(low, at - low)
        new = [e for i in range(listed.size()) if (e := listed.apply(i)).executionId() > last]
        plans += [e.physicalPlanDescription() for e in new]
        if len(new) < listed.size():
            break
        at = low
    return plans


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_result(spark, con, name):
    last = newest(spark)
    assert differences(QUERIES[name](spark, SF), con, ORACLE[name]) == []
    plans = executed_after(spark, last)
    assert plans
    # every plan that ran, those of stored intermediates included
    for plan in plans:
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
            assert node not in plan


def test_entry_has_rows(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns[:2] == ["Company", "Date"] and df.count() > 0
