"""Plan shape of every registered query: no nested-loop or cartesian joins,
no Python evaluation in the plan, table chains collapse into one scan."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

BAD = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
       "FlatMapGroupsInPandas", "MapInPandas")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_plan_has_no_nested_loops_or_python(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [b for b in BAD if b in plan] == []


def test_migrations_push_filters_into_the_scan(spark):
    df = entry.queries()["migrate_lineitem_up"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_returnflag), GreaterThan(l_quantity,0.0)" in plan
