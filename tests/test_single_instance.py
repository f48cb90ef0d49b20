"""keys=[]: the reference's own single-instance shape (no fleet columns)."""

import pytest

from opslens.operators import (backup as D, database as B, discovery as K, ha as H, index as G, instance as A,
                               job as I, security as S, session as E, storage as C, wait as W)
from opslens.sources.bindings import relation

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def one(spark):
    def f(name):
        df = relation(spark, SF_SMALL, name)
        srv = df.select("server_name").first()[0]
        df = df.filter(df.server_name == srv).drop("snapshot_id")
        # An instance knows its own name; every other relation loses the key.
        return df if name == "instances" else df.drop("server_name")
    return f


CASES = {
    "C3": lambda s, o: C.io_share(o("io_file_stats"), o("databases"), keys=[]),
    "C5": lambda s, o: C.drive_latency(o("io_file_stats"), o("master_files"), keys=[]),
    "C9": lambda s, o: C.file_growth_checks(o("master_files"), keys=[]),
    "F1": lambda s, o: W.wait_listing(s, o("wait_stats"), keys=[]),
    "B3": lambda s, o: B.config_checks(o("config"), o("instances"), keys=[]),
    "B5": lambda s, o: B.db_setting_checks(o("databases"), o("instances"), keys=[]),
    "B8": lambda s, o: B.trace_flag_checks(o("trace_flags"), o("instances"), o("databases"), keys=[]),
    "D6": lambda s, o: D.no_log_backup(o("databases"), o("backupset"), keys=[]),
    "E4": lambda s, o: E.sessions_in_database(o("processes"), o("databases"), keys=[]),
    "G1": lambda s, o: G.busiest_write_database(o("io_file_stats"), o("databases"), keys=[]),
    "G9": lambda s, o: G.procedure_cpu(o("cached_plans"), o("query_stats"), keys=[]),
    "A4": lambda s, o: A.identity_checks(o("instances"), o("schedulers"), o("config"), keys=[]),
    "A5": lambda s, o: A.support_level(s, o("instances"), keys=[]),
    "J2": lambda s, o: S.script_users(o("principals"), o("logins"), keys=[]),
    "K3": lambda s, o: K.space_used(o("master_files"), o("databases"), keys=[]),
    "H2": lambda s, o: H.ag_health(o("availability_groups"), keys=[]),
    "I1": lambda s, o: I.maintenance_job_steps(o("jobs"), o("job_steps"), keys=[]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_single_instance(spark, one, name):
    df = CASES[name](spark, one)
    assert "snapshot_id" not in df.columns
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # With no fleet key, per-instance aggregates are single rows joined by a
    # broadcast of that one row; an unbounded cartesian product never appears.
    assert "CartesianProduct" not in plan
