"""Family F — wait statistics.

The whitelist of reviewed wait types and their category is a literal
dimension (52 rows), joined by broadcast; the whitelist join replaces the
source's long OR list. Shares and ranks are windows partitioned by the fleet
key over at most 52 rows per server.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tsql import scaled
from ..plans.shape import dim, finding, kcols, rank_in, with_total

# Reviewed wait types, in the order listed, with their category.
WAIT_CATEGORIES = [
    ("CXPACKET", "SETTINGS OR CODE"),
    ("SOS_SCHEDULER_YIELD", "CPU"),
    ("ASYNC_NETWORK_IO", "NETWORK"),
    ("LCK_M_BU", "LOCK"), ("LCK_M_IS", "LOCK"), ("LCK_M_IU", "LOCK"), ("LCK_M_IX", "LOCK"),
    ("LCK_M_RIn_NL", "LOCK"), ("LCK_M_RIn_S", "LOCK"), ("LCK_M_RIn_U", "LOCK"), ("LCK_M_RIn_X", "LOCK"),
    ("LCK_M_RS_S", "LOCK"), ("LCK_M_RS_U", "LOCK"), ("LCK_M_RX_S", "LOCK"), ("LCK_M_RX_U", "LOCK"),
    ("LCK_M_RX_X", "LOCK"), ("LCK_M_S", "LOCK"), ("LCK_M_SCH_M", "LOCK"), ("LCK_M_SCH_S", "LOCK"),
    ("LCK_M_SIU", "LOCK"), ("LCK_M_SIX", "LOCK"), ("LCK_M_U", "LOCK"), ("LCK_M_UIX", "LOCK"),
    ("LCK_M_X", "LOCK"),
    ("LATCH_DT", "LOCK"), ("LATCH_EX", "LOCK"), ("LATCH_KP", "LOCK"), ("LATCH_SH", "LOCK"), ("LATCH_UP", "LOCK"),
    ("RESOURCE_SEMAPHORE", "MEMORY"), ("RESOURCE_SEMAPHORE_MUTEX", "MEMORY"),
    ("RESOURCE_SEMAPHORE_QUERY_COMPILE", "MEMORY"), ("RESOURCE_SEMAPHORE_SMALL_QUERY", "MEMORY"),
    ("WRITELOG", "MEMORY"),
    ("PAGEIOLATCH_DT", "DISK"), ("PAGEIOLATCH_EX", "DISK"), ("PAGEIOLATCH_KP", "DISK"),
    ("PAGEIOLATCH_SH", "DISK"), ("PAGEIOLATCH_UP", "DISK"),
    ("PAGELATCH_DT", "DISK"), ("PAGELATCH_EX", "DISK"), ("PAGELATCH_KP", "DISK"), ("PAGELATCH_SH", "DISK"),
    ("PAGELATCH_UP", "DISK"), ("LOGBUFFER", "DISK"), ("ASYNC_IO_COMPLETION", "DISK"), ("IO_COMPLETION", "DISK"),
    ("HADR_SYNC_COMMIT", "AOAG"), ("PARALLEL_REDO_FLOW_CONTROL", "AOAG"), ("PARALLEL_REDO_TRAN_TURN", "AOAG"),
    ("DIRTY_PAGE_TABLE_LOCK", "AOAG"), ("DPT_ENTRY_LOCK", "AOAG"),
]

# Our own one-line guidance per category.
CATEGORY_HINT = {
    "SETTINGS OR CODE": "parallelism waits; review max degree of parallelism and cost threshold",
    "CPU": "schedulers yielding; check runnable task counts per scheduler",
    "NETWORK": "client is slow to consume results or the network is slow",
    "LOCK": "sessions waiting on locks or latches; look for blocking chains",
    "MEMORY": "waiting on memory grants, compile throttles or log flushes",
    "DISK": "waiting on data or log I/O; check drive latency",
    "AOAG": "availability-group data movement or redo is falling behind",
}


def wait_dim(spark: SparkSession) -> DataFrame:
    rows = [(w, c, CATEGORY_HINT[c], i) for i, (w, c) in enumerate(WAIT_CATEGORIES)]
    return dim(spark, rows, "wait_type string, category string, comment string, list_order int")


def wait_stats(spark: SparkSession, waits: DataFrame, n: int = 10, keys=None) -> DataFrame:
    """the top ``n`` reviewed wait types per server by wait time: seconds
    waited, resource and signal seconds, share of all reviewed waits, rank,
    category and hint. Types with no waiting tasks are left out of the output
    (after ranking, as the source does)."""
    k = kcols(keys)
    w = waits.join(wait_dim(spark), "wait_type", "inner")
    w = with_total(w, keys, "wait_time_ms", "_total")
    w = w.withColumn("percentage", (F.lit(100.0) * F.col("wait_time_ms") / F.col("_total")).cast("decimal(5,2)"))
    w = rank_in(w, keys, [F.col("wait_time_ms").desc(), F.col("list_order")], "rn").filter(F.col("rn") <= n)
    return w.select(
        *k, "wait_type", "waiting_tasks_count",
        scaled("wait_time_ms", 3, "decimal(18,2)").alias("wait_s"),
        scaled(F.col("wait_time_ms") - F.col("signal_wait_time_ms"), 3, "decimal(18,2)").alias("resource_s"),
        scaled("signal_wait_time_ms", 3, "decimal(18,2)").alias("signal_s"),
        "percentage", F.col("rn").cast("long").alias("rn"), "category", "comment")


def wait_listing(spark: SparkSession, waits: DataFrame, n: int = 10, keys=None) -> DataFrame:
    """F1 output: ranked rows with waiting tasks."""
    return wait_stats(spark, waits, n, keys).filter(F.col("waiting_tasks_count") != 0)


def top_wait_findings(spark: SparkSession, waits: DataFrame, keys=None) -> DataFrame:
    """F3 as findings: the three largest waits of a server."""
    return finding(top_waits(spark, waits, keys=keys), keys, "F3.top_wait", "info", F.col("wait_type"), F.col("line"))


def top_waits(spark: SparkSession, waits: DataFrame, n: int = 3, keys=None) -> DataFrame:
    """the first ``n`` ranked waits as '<pct>% for <type>' lines."""
    w = wait_stats(spark, waits, 10, keys).filter(F.col("rn") <= n)
    return w.select(*kcols(keys), "rn", "wait_type", "percentage",
                    F.format_string("%s%% for %s", F.col("percentage").cast("string"), F.col("wait_type"))
                    .alias("line"))
