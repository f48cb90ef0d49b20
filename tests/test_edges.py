"""Hand-made edge rows: NULLs, empty inputs, zero denominators,
ties, single wait type, offsets 0 and -1, missing log files."""

import datetime as dt

from pyspark.sql import functions as F

from opslens.operators import backup as D, session as E, storage as C, wait as W
from opslens.plans.shape import lookup_join, top_n

SNAPC = "server_name string, snapshot_id int"


def test_single_wait_type_share_is_100(spark):
    w = spark.createDataFrame([("s", 0, "CXPACKET", 5, 1000, 100), ("s", 0, "SLEEP_TASK", 9, 9000, 0)],
                              f"{SNAPC}, wait_type string, waiting_tasks_count long, wait_time_ms long, "
                              "signal_wait_time_ms long")
    r = W.wait_listing(spark, w).collect()
    assert len(r) == 1 and str(r[0].percentage) == "100.00" and str(r[0].wait_s) == "1.00"


def test_zero_task_waits_ranked_but_not_listed(spark):
    w = spark.createDataFrame([("s", 0, "CXPACKET", 0, 5000, 0), ("s", 0, "WRITELOG", 3, 1000, 0)],
                              f"{SNAPC}, wait_type string, waiting_tasks_count long, wait_time_ms long, "
                              "signal_wait_time_ms long")
    r = W.wait_listing(spark, w).collect()
    assert [(x.wait_type, x.rn) for x in r] == [("WRITELOG", 2)]


def test_drive_latency_zero_reads_is_zero(spark):
    io = spark.createDataFrame([("s", 0, 1, 1, 0, 0, 0, 0, 0, 0, 0)],
                               f"{SNAPC}, database_id long, file_id long, num_of_reads long, num_of_writes long, "
                               "io_stall_read_ms long, io_stall_write_ms long, num_of_bytes_read long, "
                               "num_of_bytes_written long, io_stall long")
    files = spark.createDataFrame([("s", 0, 1, 1, "c:/x", "C:/")],
                                  f"{SNAPC}, database_id long, file_id long, physical_name string, "
                                  "volume_mount_point string")
    r = C.drive_latency(io, files).collect()[0]
    assert (r.drive, r.read_latency_ms, r.overall_latency_ms, r.avg_bytes_per_transfer) == ("C:", 0, 0, 0)


def test_database_without_log_file_drops_out(spark):
    f = spark.createDataFrame([("s", 0, "a", 0, 2048, 1024), ("s", 0, "a", 1, 256, 10), ("s", 0, "b", 0, 2048, 0)],
                              f"{SNAPC}, database_name string, type int, size long, space_used long")
    r = {x.database_name: x for x in C.database_space(f).collect()}
    assert set(r) == {"a"}
    assert (r["a"].total_size_data, r["a"].percent_fill_data, r["a"].total_size_log) == (16, "50.000", 2)


def test_top_n_ties_break_on_name(spark):
    df = spark.createDataFrame([("s", 0, n, 5) for n in "dcba"], f"{SNAPC}, database_name string, v long")
    r = top_n(df, None, [F.col("v").desc(), F.col("database_name")], 3).collect()
    assert sorted(x.database_name for x in r) == ["a", "b", "c"]


def test_top_n_without_keys_is_global(spark):
    df = spark.createDataFrame([("s1", 0, "a", 1), ("s2", 0, "b", 9), ("s3", 0, "c", 5)],
                               f"{SNAPC}, database_name string, v long")
    r = top_n(df, [], [F.col("v").desc(), F.col("database_name")], 2).collect()
    assert [x.database_name for x in r] == ["b", "c"]


def test_io_share_sums_to_100(spark):
    io = spark.createDataFrame([("s", 0, d, d, 7 * d, d) for d in range(1, 8)],
                               f"{SNAPC}, database_id long, file_id long, num_of_reads long, num_of_writes long")
    dbs = spark.createDataFrame([("s", 0, d, f"db{d}", None) for d in range(1, 8)],
                                f"{SNAPC}, database_id long, name string, source_database_id int")
    r = C.io_share(io, dbs, n=100).collect()
    assert len(r) == 7 and abs(sum(float(x.pct) for x in r) - 100) <= 0.05


def _sessions(spark, start):
    ses = spark.createDataFrame([("s", 0, 51, "running", "l", None, "h", "app")],
                                f"{SNAPC}, session_id long, status string, loginame string, login_time timestamp_ntz, "
                                "host_name string, program_name string")
    req = spark.createDataFrame([("s", 0, 51, "running", 0, "SELECT", 1, 5, start, 125000, 7, 0, -1, 2500, None, 0, 2, 1)],
                                f"{SNAPC}, spid long, status string, blocked long, command string, dbid long, "
                                "percent_complete long, start_time timestamp_ntz, estimated_completion_time long, "
                                "sql_handle long, statement_start_offset long, statement_end_offset long, "
                                "waittime long, wait_type string, open_tran long, isolation_level long, cpu long") \
        .withColumn("wait_resource", F.lit("KEY: 1"))
    for c in ("last_request_start_time", "last_request_end_time", "reads", "writes", "logical_reads", "lock_timeout", "row_count"):
        ses = ses.withColumn(c, F.lit(None).cast("long"))
    # The same handle is another statement on another server, and in another snapshot of this one.
    txt = spark.createDataFrame([("s", 0, 7, "SELECT 1  ", 11), ("t", 0, 7, "other", 12), ("s", 1, 7, "later", 13)],
                                f"{SNAPC}, sql_handle long, text string, object_id long")
    dbs = spark.createDataFrame([("s", 0, 1, "db")], f"{SNAPC}, database_id long, name string")
    jobs = spark.createDataFrame([("s", 0, "0x1", "j")], f"{SNAPC}, job_hex string, name string")
    return ses, req, txt, dbs, jobs


def test_active_session_duration_and_statement(spark):
    start = dt.datetime(2024, 1, 31, 22, 58, 59)
    got = E.active_sessions(*_sessions(spark, start), as_of="2024-02-01 00:00:00").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.objectid, r.wait_resource) == (11, "KEY: 1")
    # 62 minute boundaries -> 1 hr 2 min; 3661 second boundaries -> 1 sec
    assert r.duration == "1 hr 2 min 1 sec"
    # end -1: LEN*2 ignores trailing blanks, then (16 - 0)/2 + 1 = 9 characters
    assert r.running_statement == "SELECT 1 "
    assert (r.eta_min, r.wait_time_sec, r.transaction_isolation_level) == (2, 2, "ReadCommitted")


def test_active_session_null_start_gives_null_duration(spark):
    r = E.active_sessions(*_sessions(spark, None), as_of="2024-02-01 00:00:00").collect()[0]
    assert r.duration is None


def test_lead_blocker_statement_start_zero(spark):
    p = spark.createDataFrame([("s", 0, 51, 0, "x", "y", 0, 1, "c", "w", 0, None), ("s", 0, 52, 51, "x", "y", 0, 1, "c", "w", 0, None)],
                              f"{SNAPC}, spid long, blocked long, loginame string, hostname string, open_tran long, "
                              "dbid long, command string, waittype string, waittime long, last_batch timestamp_ntz")
    p = p.withColumn("status", F.lit("runnable"))
    r = spark.createDataFrame([("s", 0, 51, 7, 0, 6)], f"{SNAPC}, spid long, sql_handle long, "
                              "statement_start_offset long, statement_end_offset long")
    t = spark.createDataFrame([("s", 0, 7, "abcdef"), ("t", 0, 7, "ghijkl")], f"{SNAPC}, sql_handle long, text string")
    d = spark.createDataFrame([("s", 0, 1, "a_long_database_name")], f"{SNAPC}, database_id long, name string")
    out = E.lead_blockers(p, r, t, d).collect()
    assert len(out) == 1 and out[0].spid == 51
    # start 0 / length 3 keeps positions 0..2 -> two characters
    assert out[0].sql_statement == "ab" and out[0].blk == "0  " and out[0].dbname == "a_long_dat"


def test_backup_checks_on_empty_history(spark):
    dbs = spark.createDataFrame([("s", 0, 5, "db5", 1, None)],
                                f"{SNAPC}, database_id long, name string, recovery_model int, source_database_id int")
    bs = spark.createDataFrame([], f"{SNAPC}, database_name string, type string, recovery_model string, "
                                   "backup_finish_date timestamp_ntz")
    assert D.no_log_backup(dbs, bs).collect()[0].observed == "1"
    assert D.no_full_backup(dbs, bs).collect()[0].observed == "1"
    assert D.stale_log_backup(dbs, bs, "2024-01-01 00:00:00").count() == 0


def test_lookup_join_keeps_every_row_under_a_hot_key(spark):
    fact = spark.range(0, 5000).select((F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))).alias("k"),
                                       F.col("id").alias("v"))
    dim = spark.range(0, 5000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    out = lookup_join(fact, dim, ["k"], "left")
    assert out.count() == 5000
    assert out.filter(F.col("w").isNull()).count() == 0
    assert out.agg(F.sum("w")).collect()[0][0] == fact.join(dim, "k").agg(F.sum("w")).collect()[0][0]


def test_lookup_join_spreads_rows_without_a_key(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = spark.range(0, 10_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
        dim = spark.range(0, 10_000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
        out = lookup_join(fact, dim, ["k"], "left")
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 10_000 and max(sizes) < 3 * 10_000 / len(sizes) and len(sizes) > 4
        assert out.filter("k is not null and w <> 10 * k").count() == 0 and out.filter("w is not null").count() == 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_progress_keeps_servers_and_snapshots_apart(spark):
    r = spark.createDataFrame([("a", 0, 1, "BACKUP DATABASE", 7), ("b", 1, 2, "BACKUP DATABASE", 7)],
                              f"{SNAPC}, spid long, command string, sql_handle long") \
        .withColumns({"start_time": F.lit(None).cast("timestamp_ntz"), "percent_complete": F.lit(1), "estimated_completion_time": F.lit(1000)})
    t = spark.createDataFrame([("a", 0, 7, "text of a"), ("b", 0, 7, "old text of b"), ("b", 1, 7, "text of b")],
                              f"{SNAPC}, sql_handle long, text string")
    out = D.backup_restore_progress(r, t, "2024-01-01 00:00:00").collect()
    assert sorted((x.server_name, x.query) for x in out) == [("a", "text of a"), ("b", "text of b")]
