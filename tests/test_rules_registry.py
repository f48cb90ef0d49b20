"""Checks run together give what each gives alone, for every server."""

from opslens.operators import checks as K, report as R
from opslens.plans.rules import run_checks
from opslens.sources.bindings import relation
from tools.oracle_check import rows_of

from .conftest import SF_SMALL

AS_OF = "2001-08-02 00:00:00"


def _rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def test_together_as_alone(spark):
    t = {n: relation(spark, SF_SMALL, n) for n in R.HEALTH_CHECK_INPUTS}
    alone = [row for check in K.ALL for row in _rows(run_checks([check], t, as_of=AS_OF))]
    assert sorted(alone, key=repr) == _rows(run_checks(K.ALL, t, as_of=AS_OF))


def test_servers_that_a_source_does_not_know(spark):
    snap = "server_name string, snapshot_id int"
    t = {"jobs": spark.createDataFrame([("a", 0, "sa"), ("a", 0, "x"), ("b", 0, None)], f"{snap}, owner_name string"),
         "packages": spark.createDataFrame([("c", 0, "SA")], f"{snap}, owner_name string"),
         "databases": spark.createDataFrame([("a", 0, "d", 9, 1, "y"), ("d", 0, "d", 9, None, "sa")],
                                            f"{snap}, name string, database_id long, source_database_id int, owner_name string")}
    got = {(r.server_name, r.check_id): (r.severity, r.observed) for r in run_checks([K.OWNERS], t).collect()}
    assert got == {("a", "B7.job_owner"): ("warn", "1"), ("b", "B7.job_owner"): ("ok", "0"), ("c", "B7.package_owner"): ("ok", "0"),
                   ("d", "B7.database_owner"): ("ok", "0")}


def test_backups_without_a_database_and_equal_names(spark):
    snap = "server_name string, snapshot_id int"
    databases = spark.createDataFrame([("a", 0, "x", 5, 1), ("a", 0, "x", 6, 1), ("a", 0, "y", 7, 2), ("a", 0, "s", 8, 3)],
                                      f"{snap}, name string, database_id long, recovery_model int").selectExpr("*", "cast(null as int) as source_database_id")
    backups = spark.createDataFrame([("a", 0, "x", "L", None, "2001-08-01 00:00:00"), ("a", 0, "x", "L", "FULL", None), ("a", 0, "x", "L", "FULL", "2001-08-01 00:00:00"),
                                     ("a", 0, "gone", "L", "FULL", None), ("b", 0, "x", "D", "FULL", None), ("a", 0, "s", "D", "FULL", "2001-08-01 00:00:00")],
                                    f"{snap}, database_name string, type string, recovery_model string, backup_finish_date string") \
        .selectExpr("server_name", "snapshot_id", "database_name", "type", "recovery_model", "cast(backup_finish_date as timestamp_ntz) as backup_finish_date")
    t = {"databases": databases, "backupset": backups}
    got = {r.check_id: r.observed for r in run_checks([K.NO_LOG_BACKUP, K.NO_FULL_BACKUP, K.OLD_LOG_BACKUP], t, as_of=AS_OF).collect()}
    # Two databases named x with two bad log backups each, one of y; without a full backup: x twice and y.
    assert got == {"D6.no_log_backup": "5", "D9.no_full_backup": "3", "D7.stale_log_backup": "0"}
