"""Family C — storage and I/O.

Every fact input (file I/O counters, trace events, VLF rows) is aggregated to
one row per (fleet key, database[, file]) *before* it meets a dimension, so
joins and windows only ever see per-database rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tsql import money, pages_to_mb_trunc, safe_idiv, scaled, str10
from ..plans.rules import run_checks
from ..plans.shape import kcols, top_n, with_total
from . import checks as K
from .checks import TEMPDB_ID, UNLIMITED_2TB, VLF_LIMIT

# File type codes and their descriptions.
TYPE_DESC = {0: "ROWS", 1: "LOG", 2: "FILESTREAM", 4: "FULLTEXT"}


def _type_desc(c="type"):
    expr = F.when(F.col(c) == 0, TYPE_DESC[0])
    for code, desc in TYPE_DESC.items():
        if code:
            expr = expr.when(F.col(c) == code, desc)
    return expr


def _io_by_db(io: DataFrame, keys) -> DataFrame:
    k = kcols(keys)
    return io.groupBy(*k, "database_id").agg(
        F.sum("num_of_reads").alias("num_of_reads"),
        F.sum("num_of_writes").alias("num_of_writes"),
        F.sum("num_of_bytes_read").alias("num_of_bytes_read"),
        F.sum("num_of_bytes_written").alias("num_of_bytes_written"))


def _live_databases(databases: DataFrame, keys) -> DataFrame:
    """Databases that are not database snapshots."""
    return databases.filter(F.col("source_database_id").isNull()) \
        .select(*kcols(keys), "database_id", F.col("name").alias("database_name"))


def top_databases_by_io(io: DataFrame, databases: DataFrame, metric: str, n: int = 3,
                        keys=None) -> DataFrame:
    """Top ``n`` databases per server by summed ``metric``
    (``num_of_reads`` or ``num_of_writes``); snapshots excluded."""
    k = kcols(keys)
    agg = _io_by_db(io, keys).select(*k, "database_id", metric)
    per_db = agg.join(_live_databases(databases, keys), k + ["database_id"], "inner") \
        .groupBy(*k, "database_name").agg(F.sum(metric).alias(metric))
    top = top_n(per_db, keys, [F.col(metric).desc(), F.col("database_name")], n)
    return top.withColumn(metric + "_text", money(F.col(metric)))


def top_databases_by_reads(io, databases, n=3, keys=None):
    return top_databases_by_io(io, databases, "num_of_reads", n, keys)


def top_databases_by_writes(io, databases, n=3, keys=None):
    return top_databases_by_io(io, databases, "num_of_writes", n, keys)


def _io_share(io: DataFrame, databases: DataFrame, value: F.Column, n: int, keys) -> DataFrame:
    k = kcols(keys)
    names = databases.select(*k, "database_id", F.col("name").alias("database_name"))
    per_db = io.groupBy(*k, "database_id").agg(value.alias("io_value"))
    shared = with_total(per_db, keys, "io_value", "_total")
    shared = shared.withColumn(
        "pct", (F.col("io_value").cast("double") / F.col("_total").cast("double") * 100)
        .cast("decimal(5,2)")).drop("_total")
    shared = shared.join(names, k + ["database_id"], "left")
    return top_n(shared, keys, [F.col("pct").desc(), F.col("database_id")], n)


def io_share(io: DataFrame, databases: DataFrame, n: int = 3, keys=None) -> DataFrame:
    """Per database ``io_avg`` = (reads + writes) / 2 as decimal(20,2) and
    its percentage of the server total (all databases, snapshots included),
    then the top ``n`` by percentage."""
    v = (F.sum(F.col("num_of_reads") + F.col("num_of_writes")) / F.lit(2.0)).cast("decimal(20,2)")
    out = _io_share(io, databases, v, n, keys).withColumnRenamed("io_value", "io_avg")
    return out.withColumn("io_avg_text", money(F.col("io_avg")))


def io_mb_share(io: DataFrame, databases: DataFrame, n: int = 3, keys=None) -> DataFrame:
    """C4: as C3 with (bytes read + written) / 1048576 as MB."""
    v = (F.sum(F.col("num_of_bytes_read") + F.col("num_of_bytes_written")).cast("double")
         / F.lit(1048576.0)).cast("decimal(20,2)")
    out = _io_share(io, databases, v, n, keys).withColumnRenamed("io_value", "io_in_mb")
    return out.withColumn("io_in_mb_text", money(F.col("io_in_mb")))


def drive_latency(io: DataFrame, files: DataFrame, keys=None, volumes: DataFrame | None = None) -> DataFrame:
    """Per drive letter and mount point: read/write/overall latency (ms)
    and bytes per read/write/transfer, integer division guarded for zero.
    ``volumes``: the mount point of each file (database_id, file_id), landed
    by itself; a file without a volume drops out, as in the source. Without
    it, ``files`` carries the mount point."""
    k = kcols(keys)
    if volumes is not None:
        mounted = volumes.select(*k, "database_id", "file_id", "volume_mount_point")
        files = files.drop("volume_mount_point").join(mounted, k + ["database_id", "file_id"], "inner")
    per_file = io.groupBy(*k, "database_id", "file_id").agg(
        *[F.sum(c).alias(c) for c in ("num_of_reads", "num_of_writes", "io_stall_read_ms",
                                      "io_stall_write_ms", "num_of_bytes_read",
                                      "num_of_bytes_written", "io_stall")])
    f = files.select(*k, "database_id", "file_id",
                     F.left(F.upper("physical_name"), F.lit(2)).alias("drive"),
                     "volume_mount_point")
    j = per_file.join(f, k + ["database_id", "file_id"], "inner")
    t = j.groupBy(*k, "drive", "volume_mount_point").agg(
        *[F.sum(c).alias(c) for c in ("num_of_reads", "num_of_writes", "io_stall_read_ms",
                                      "io_stall_write_ms", "num_of_bytes_read",
                                      "num_of_bytes_written", "io_stall")])
    r, w = F.col("num_of_reads"), F.col("num_of_writes")
    return t.select(
        *k, "drive", "volume_mount_point",
        safe_idiv("io_stall_read_ms", r).alias("read_latency_ms"),
        safe_idiv("io_stall_write_ms", w).alias("write_latency_ms"),
        safe_idiv("io_stall", r + w).alias("overall_latency_ms"),
        safe_idiv("num_of_bytes_read", r).alias("avg_bytes_per_read"),
        safe_idiv("num_of_bytes_written", w).alias("avg_bytes_per_write"),
        safe_idiv(F.col("num_of_bytes_read") + F.col("num_of_bytes_written"), r + w)
        .alias("avg_bytes_per_transfer"))


def _fill_text(used_pages, size_pages):
    pct = (used_pages.cast("double") * 100.0 / size_pages.cast("double")).cast("decimal(18,6)")
    return F.substring(pct.cast("string"), 1, 6)


def database_space(files: DataFrame, keys=None) -> DataFrame:
    """Per database the data (type 0) and log (type 1) totals in MB with
    per-row truncation, used, left and fill text (6 characters); databases
    without both a data and a log file are left out."""
    k = kcols(keys)
    mb, used = pages_to_mb_trunc("size"), pages_to_mb_trunc("space_used")
    agg = files.filter(F.col("type").isin(0, 1)).groupBy(*k, "database_name").agg(
        F.sum(F.when(F.col("type") == 0, mb)).alias("total_size_data"),
        F.sum(F.when(F.col("type") == 0, used)).alias("space_util_data"),
        F.sum(F.when(F.col("type") == 0, F.col("size"))).alias("_dsize"),
        F.sum(F.when(F.col("type") == 0, F.col("space_used"))).alias("_dused"),
        F.sum(F.when(F.col("type") == 1, mb)).alias("total_size_log"),
        F.sum(F.when(F.col("type") == 1, used)).alias("space_util_log"),
        F.sum(F.when(F.col("type") == 1, F.col("size"))).alias("_lsize"),
        F.sum(F.when(F.col("type") == 1, F.col("space_used"))).alias("_lused"),
        F.count_if(F.col("type") == 0).alias("_nd"), F.count_if(F.col("type") == 1).alias("_nl"))
    agg = agg.filter((F.col("_nd") > 0) & (F.col("_nl") > 0))
    note = F.lit("less than 1% used")
    return agg.select(
        *k, "database_name", "total_size_data", "space_util_data",
        (F.col("total_size_data") - F.col("space_util_data")).alias("space_data_left"),
        F.when(F.col("total_size_data") == 0, F.lit(None).cast("string"))
        .otherwise(_fill_text(F.col("_dused"), F.col("_dsize"))).alias("percent_fill_data"),
        F.when(F.col("total_size_data") == 0, note).alias("fill_note"),
        "total_size_log", "space_util_log",
        (F.col("total_size_log") - F.col("space_util_log")).alias("space_log_left"),
        F.when(F.col("total_size_log") == 0, note)
        .otherwise(_fill_text(F.col("_lused"), F.col("_lsize"))).alias("percent_fill_log"),
        (F.col("total_size_log") + F.col("total_size_data")).alias("total_db_size"),
        (F.col("space_util_data") + F.col("space_util_log")).alias("total_size_used"),
        ((F.col("total_size_log") + F.col("total_size_data"))
         - (F.col("space_util_data") + F.col("space_util_log"))).alias("total_size_left"))


def database_size_by_type(databases: DataFrame, files: DataFrame, keys=None) -> DataFrame:
    """Per database the page sums of row, log, filestream and full-text
    files as MB (float), and rows+log in GB (NULL if either is missing)."""
    k = kcols(keys)
    sizes = files.filter(F.col("type").isin(0, 1, 2, 4)).groupBy(*k, "database_id") \
        .pivot("type", [0, 1, 2, 4]).agg(F.sum("size")) \
        .withColumnsRenamed({"0": "row_size", "1": "log_size", "2": "stream_size", "4": "text_size"})
    j = databases.select(*k, "database_id", F.col("name").alias("database_name")) \
        .join(sizes, k + ["database_id"], "left")
    mb = lambda c: F.col(c).cast("double") * 8 / 1024
    return j.select(*k, "database_name", mb("row_size").alias("row_size_mb"),
                    mb("log_size").alias("log_size_mb"),
                    (mb("row_size") / 1024 + mb("log_size") / 1024).alias("db_size_gb"),
                    mb("stream_size").alias("stream_size_mb"),
                    mb("text_size").alias("text_index_size_mb"))


def _growth_text():
    return F.when(F.col("is_percent_growth"), F.concat(str10(F.col("growth")), F.lit("  %"))) \
        .otherwise(F.concat(str10(F.expr("(growth * 8) div 1024")), F.lit(" mb")))


def _file_listing(files: DataFrame, keys, other_label: bool) -> DataFrame:
    td = _type_desc()
    label = F.when(td == "ROWS", "Data").when(F.lower(td) == "log", "Log")
    if other_label:
        label = label.otherwise(td)
    return files.select(
        *kcols(keys), "database_name", "physical_name", label.alias("file_type"),
        (F.col("size").cast("double") / 128).cast("decimal(18,2)").alias("initial_mb"),
        _growth_text().alias("growth_increment"), "max_size", "growth", "state_desc")


def file_growth(files: DataFrame, keys=None) -> DataFrame:
    """Per file listing: type label, initial MB, growth increment text and
    the maximum-size verdict."""
    out = _file_listing(files, keys, True)
    g, m = F.col("growth"), F.col("max_size")
    verdict = (F.when((m == 0) | (g == 0), "*** No growth allowed ***")
               .when((m == -1) & (g > 0), "File will grow until disk full")
               .when((m == UNLIMITED_2TB) & (g > 0), "File will grow to max size of 2TB")
               .when((m > 0) & (g > 0), "*** File growth limited to fixed size ***"))
    return out.withColumn("max_size_text", verdict).drop("max_size", "growth")


def file_growth_checks(files: DataFrame, keys=None) -> DataFrame:
    """Findings — files without growth, else fixed-size files, else ok;
    and files growing by exactly 1 MB (not percent)."""
    return run_checks([K.FILE_GROWTH], {"master_files": files}, keys)


def tempdb_files(files: DataFrame, keys=None) -> DataFrame:
    """C8's listing for tempdb (database_id 2); other types get NULL."""
    return _file_listing(files.filter(F.col("database_id") == TEMPDB_ID), keys, False) \
        .drop("max_size", "growth")


def tempdb_file_count(files: DataFrame, keys=None) -> DataFrame:
    """C11: two tempdb files in total means one data file; else the count of
    tempdb data files."""
    return run_checks([K.TEMPDB_COUNT], {"master_files": files}, keys)


def tempdb_uniformity(files: DataFrame, keys=None) -> DataFrame:
    """Within each tempdb file type all initial sizes equal, and all
    growth increments equal (the intent of the source's cursor)."""
    return run_checks([K.TEMPDB_UNIFORM], {"master_files": files}, keys)


def vlf_counts(log_info: DataFrame, keys=None) -> DataFrame:
    """C13 listing: virtual log files per database."""
    k = kcols(keys)
    return log_info.groupBy(*k, "database_name").agg(F.count(F.lit(1)).alias("vlf_count"))


def vlf_check(log_info: DataFrame, limit: int = VLF_LIMIT, keys=None) -> DataFrame:
    """C13 finding: number of databases with more than ``limit`` VLFs."""
    return run_checks([K.VLF], {"log_info": log_info}, keys, vlf_limit=limit)


# Trace event classes for data/log file grow and shrink.
AUTOGROW_EVENTS = [(92, "Data File Auto Grow"), (93, "Log File Auto Grow"),
                   (94, "Data File Auto Shrink"), (95, "Log File Auto Shrink")]


def autogrow_events(trace: DataFrame, trace_events: DataFrame, variant: str = "detail",
                    keys=None) -> DataFrame:
    """C14: grow/shrink events (classes 92-95) named by the event dimension.

    ``variant='detail'``: seconds as decimal(10,3) and MB = pages*8.0/1024
    with file, application, host and login; ``variant='summary'``:
    duration ms (integer) and MB = (pages*8)/1024.0. Stateless, so it
    also runs unchanged on a streaming ``trace``."""
    k = kcols(keys)
    ev = trace.filter(F.col("event_class").between(92, 95)) \
        .join(trace_events.select(*k, F.col("trace_event_id").alias("event_class"), "event_name"), k + ["event_class"], "inner")
    if variant == "detail":
        return ev.select(*k, "database_name", F.col("event_name"), "file_name",
                         scaled("duration_us", 6, "decimal(10,3)").alias("time_taken_seconds"), "start_time", "end_time",
                         (F.col("integer_data").cast("double") * 8.0 / 1024).cast("decimal(20,6)")
                         .alias("change_in_size_mb"),
                         "application_name", "host_name", "login_name")
    return ev.select(*k, "database_name", "event_name", "file_name", "start_time",
                     F.call_function("div", F.col("duration_us"), F.lit(1000)).alias("duration_ms"),
                     ((F.col("integer_data") * 8).cast("double") / 1024.0).cast("decimal(20,6)")
                     .alias("change_in_size_mb"))


def trace_coverage(trace: DataFrame, trace_events: DataFrame, keys=None) -> DataFrame:
    """First and last event time covered by the trace files."""
    k = kcols(keys)
    ev = trace.join(trace_events.select(*k, F.col("trace_event_id").alias("event_class")), k + ["event_class"], "left_semi")
    return ev.groupBy(*k).agg(F.min("start_time").alias("first_event"),
                              F.max("start_time").alias("last_event"))
