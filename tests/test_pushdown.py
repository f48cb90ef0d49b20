"""On landed parquet (production shape), predicates reach the scan and
snapshot-date partitions are pruned."""

import datetime as dt
import os

from pyspark.sql import functions as F

from opslens.operators import backup as D, index as G, storage as C
from opslens.session import cluster_conf
from opslens.sources import loader as L


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_event_class_filter_is_pushed(spark, tmpdir_path):
    rows = [("s", 0, 90 + i % 8, "db", "f", "a", "h", "l", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), 10, 1)
            for i in range(16)]
    schema = ("server_name string, snapshot_id int, event_class int, database_name string, file_name string, "
              "application_name string, host_name string, login_name string, start_time timestamp_ntz, "
              "end_time timestamp_ntz, duration_us long, integer_data long")
    p = os.path.join(tmpdir_path, "trace")
    spark.createDataFrame(rows, schema).write.parquet(p)
    dim = spark.createDataFrame([("s", 0, 92, "Data File Auto Grow")],
                                "server_name string, snapshot_id int, trace_event_id int, event_name string")
    plan = _plan(C.autogrow_events(L.load_snapshot(spark, p), dim))
    assert "GreaterThanOrEqual(event_class,92), LessThanOrEqual(event_class,95)" in plan.split("PushedFilters: [")[1]


def test_backup_type_filter_and_pruned_columns(spark, tmpdir_path):
    bs = spark.createDataFrame([("s", 0, "db", 1, "n", "D", "FULL", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), "x" * 50)],
                               "server_name string, snapshot_id int, database_name string, media_set_id long, name string, "
                               "type string, recovery_model string, backup_start_date timestamp_ntz, "
                               "backup_finish_date timestamp_ntz, description string")
    mf = spark.createDataFrame([("s", 0, 1, 1, "d", "D:/b.bak")], "server_name string, snapshot_id int, media_set_id long, "
                               "family_sequence_number int, logical_device_name string, physical_device_name string")
    pb, pm = os.path.join(tmpdir_path, "bs"), os.path.join(tmpdir_path, "mf")
    bs.write.parquet(pb)
    mf.write.parquet(pm)
    plan = _plan(D.backup_history(L.load_snapshot(spark, pb), L.load_snapshot(spark, pm)))
    assert "EqualTo(type,D)" in plan
    assert "description" not in plan  # unused wide column never read


def test_plan_xml_contains_filter_is_pushed(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "plans")
    spark.createDataFrame([("s", 0, 200, "<ShowPlanXML/>")], "server_name string, snapshot_id int, usecounts long, "
                          "query_plan string").write.parquet(p)
    plan = _plan(G.plan_missing_indexes(L.load_snapshot(spark, p)))
    assert "StringContains(query_plan,MissingIndexes)" in plan


def test_snapshot_date_partitions_are_pruned(spark, tmpdir_path):
    df = spark.createDataFrame([("s", 0, dt.datetime(2024, 1, d), "C9", "ok", "0", "m") for d in (1, 2, 3)],
                               "server_name string, snapshot_id int, snapshot_ts timestamp, check_id string, "
                               "severity string, observed string, message string")
    out = os.path.join(tmpdir_path, "findings")
    L.write_result(df, out)
    back = L.load_snapshot(spark, out).filter(F.col("snapshot_date") == "2024-01-02")
    plan = _plan(back)
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan and back.count() == 1


def test_cluster_conf_enables_adaptive_skew_handling():
    c = cluster_conf(1000, 4)
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert c["spark.sql.shuffle.partitions"] == "12000"
