"""Plan shape of every registered query: no cartesian products, no nested
loop joins, no Python UDF nodes, no window over a single partition."""

import pytest

import __spark_entry__ as E
from opslens.suite import CASES

from .conftest import SF_SMALL

BAD = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
       "FlatMapGroupsInPandas", "MapInPandas", "SinglePartition"]


@pytest.mark.parametrize("name", sorted(CASES))
def test_plan_shape(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in BAD:
        assert bad not in plan, f"{name}: {bad} in plan"


def test_scan_prunes_columns(spark):
    df = E.queries()["c3_io_share"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # lineitem is read for the four I/O columns the share needs, not all 11.
    assert "l_shipdate" not in plan and "l_tax" not in plan
