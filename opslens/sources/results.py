"""Result tables that are replaced by (snapshot date, server) as a whole.

A run writes its rows beside those of earlier runs and then publishes a
manifest: one row for each (date, server) that it answers for, whether the
run has rows there or not. Readers take, for every (date, server), the newest
run that names it. So

* a re-run replaces what it covers as a whole, and clears it if it finds
  nothing there any more;
* readers see a run as soon as its manifest is whole, and not before: a job
  that dies earlier leaves the old results as they were;
* nothing is renamed or deleted in between, so this also holds on stores
  without an atomic rename, and a retried task does no harm.

Layout: ``<root>/rows/run=/snapshot_date=/server_name=/`` and
``<root>/manifest/`` (few rows: dates x servers of each run).
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stored import stored

SCOPE = ["snapshot_date", "server_name"]
_MANIFEST = "run string, published bigint, covered bigint, snapshot_date date, server_name string"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:  # nothing published yet
        return spark.createDataFrame([], _MANIFEST)


def stage_run(df: DataFrame, root: str, date_col: str = "snapshot_ts") -> str:
    """Write the rows of a run; no reader sees them yet. Returns its name."""
    run = uuid.uuid4().hex
    rows = df.withColumn("snapshot_date", F.to_date(date_col)).withColumn("run", F.lit(run))
    rows.hint("rebalance", *[F.col(c) for c in SCOPE]).write.mode("append").partitionBy("run", *SCOPE).parquet(f"{root}/rows")
    return run


def publish_run(spark: SparkSession, root: str, run: str, covered: DataFrame) -> None:
    """Make a staged run the answer for ``covered`` (snapshot_date,
    server_name). Every row of the manifest says how many there are, so one
    that was written in part counts as not published."""
    pairs = stored(covered.select(F.col("snapshot_date").cast("date").alias("snapshot_date"),
                                  F.col("server_name").cast("string").alias("server_name")).distinct())
    newest = _manifest(spark, root).agg(F.max("published")).first()[0] or 0
    published = max(time.time_ns(), newest + 1)
    n = pairs.count()
    pairs.select(F.lit(run).alias("run"), F.lit(published).cast("long").alias("published"), F.lit(n).cast("long").alias("covered"), *SCOPE) \
        .hint("rebalance").write.mode("append").parquet(f"{root}/manifest")


def replace_results(df: DataFrame, root: str, covered: DataFrame, date_col: str = "snapshot_ts") -> str:
    """Stage ``df`` and publish it for ``covered``. Rows outside ``covered``
    are written but never read."""
    run = stage_run(df, root, date_col)
    publish_run(df.sparkSession, root, run, covered)
    return run


def current_runs(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot_date, server_name, run): the newest whole run of each."""
    manifest = _manifest(spark, root).distinct()
    whole = manifest.groupBy("run", "covered").agg(F.count(F.lit(1)).alias("n")).where("n = covered").select("run")
    return manifest.join(whole, "run", "left_semi").groupBy(*SCOPE) \
        .agg(F.max_by("run", F.struct("published", "run")).alias("run"))


def read_results(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The rows that hold now. Runs, dates and servers are partitions, so a
    filter on them, and the runs that have been replaced, are pruned."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    rows = reader.parquet(f"{root}/rows").withColumn("snapshot_date", F.col("snapshot_date").cast("date")) \
        .withColumn("server_name", F.col("server_name").cast("string"))
    return rows.join(current_runs(spark, root), [*SCOPE, "run"], "left_semi").drop("run")


def superseded_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs that no (date, server) is read from any more: their folders may
    be deleted once no reader that began before is running."""
    return _manifest(spark, root).select("run").distinct().join(current_runs(spark, root).select("run").distinct(), "run", "left_anti")
