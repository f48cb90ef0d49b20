"""Production path: landed views on disk -> health check -> result table."""

import os

from opslens.operators import report as R
from opslens.sources.bindings import relation
from opslens.sources.results import read_results
from tools.oracle_check import rows_of

from .conftest import SF_SMALL

AS_OF = "2001-08-02 00:00:00"


def _rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def test_landed_health_check_equals_in_memory(spark, tmpdir_path):
    land = os.path.join(tmpdir_path, "landing")
    for n in R.HEALTH_CHECK_INPUTS:
        relation(spark, SF_SMALL, n).write.parquet(os.path.join(land, n))
    out = os.path.join(tmpdir_path, "findings")
    landed = R.run_health_check(spark, land, AS_OF, out_path=out)
    in_memory = R.gated_findings(
        spark, {n: relation(spark, SF_SMALL, n) for n in R.HEALTH_CHECK_INPUTS}, AS_OF)
    assert _rows(landed) == _rows(in_memory)
    written = read_results(spark, out)
    assert _rows(written.select(landed.columns)) == _rows(landed)
    # Another run of the day takes the place of the first.
    R.run_health_check(spark, land, AS_OF, out_path=out)
    assert read_results(spark, out).count() == landed.count()


def test_landed_discovery_report_equals_in_memory(spark, tmpdir_path):
    from opslens.operators import discovery as K
    land = os.path.join(tmpdir_path, "landing_k")
    for n in R.DISCOVERY_INPUTS:
        relation(spark, SF_SMALL, n).write.parquet(os.path.join(land, n))
    landed = R.run_discovery_report(spark, land)
    in_memory = K.report_lines(spark, K.discovery_metrics(*[relation(spark, SF_SMALL, n) for n in R.DISCOVERY_INPUTS]))
    assert _rows(landed) == _rows(in_memory) and landed.count() > 0


def test_each_view_is_scanned_once(spark, tmpdir_path):
    """The rules of all checks share one scan per view; version rules read the
    instances on their own (their versions, and the servers)."""
    from collections import Counter

    from opslens.sources.loader import load_fleet
    land = os.path.join(tmpdir_path, "landing_once")
    for n in R.HEALTH_CHECK_INPUTS:
        relation(spark, SF_SMALL, n).limit(5).write.parquet(os.path.join(land, n))
    plan = R.health_check_findings(spark, load_fleet(spark, land, R.HEALTH_CHECK_INPUTS), AS_OF)._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    views = Counter(leaves.apply(i).relation().location().rootPaths().mkString("").split("/")[-1]
                    for i in range(leaves.size()) if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation")
    assert views.pop("instances") <= 3
    assert views == Counter({n: 1 for n in R.HEALTH_CHECK_INPUTS if n != "instances"})
