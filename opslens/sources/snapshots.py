"""Which snapshot of each server to read.

Collectors land every view of a server under
``<root>/<view>/server_name=/snapshot_id=/`` and then say so in a register:
one row for each view that has landed whole (server_name, snapshot_id,
snapshot_ts, view_name). A snapshot is complete for a report when all views
that the report reads are registered.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.shape import SNAP
from .schemas import SCHEMAS

REGISTER = "server_name string, snapshot_id int, snapshot_ts timestamp_ntz, view_name string"


def newest_snapshots(register: DataFrame, views: Iterable[str], as_of=None) -> DataFrame:
    """(server_name, snapshot_id, snapshot_ts): each server's newest snapshot
    at or before ``as_of`` (all, if None) that has all ``views``. Ties in time
    go to the higher snapshot id. A snapshot's time is that of its last view;
    views that are registered twice count once."""
    views = sorted(set(views))
    known = register.where(F.col("view_name").isin(views)) if views else register
    if as_of is not None:
        # Views that land after as_of leave the snapshot incomplete at that time.
        known = known.where(F.col("snapshot_ts") <= F.lit(as_of).cast("timestamp_ntz"))
    complete = known.groupBy(*SNAP).agg(F.count_distinct("view_name").alias("n"), F.max("snapshot_ts").alias("snapshot_ts"))
    if views:
        complete = complete.where(F.col("n") == len(views))
    newest = complete.groupBy("server_name").agg(F.max(F.struct("snapshot_ts", "snapshot_id")).alias("newest"))
    return newest.select("server_name", F.col("newest.snapshot_id").alias("snapshot_id"), F.col("newest.snapshot_ts").alias("snapshot_ts"))


def load_view(spark: SparkSession, root: str, view: str, chosen: DataFrame, schema: StructType | str | None = None) -> DataFrame:
    """Rows of ``view`` in the ``chosen`` snapshots. Server and snapshot are
    partitions, and joined as one key, so the join prunes at run time: only
    the chosen snapshots' files are read, however many have landed. (By two
    keys, each would be pruned alone, and any server's snapshot 7 would be
    read if one server is at 7.)"""
    rows = spark.read.schema(schema or SCHEMAS[view]).parquet(f"{root}/{view}")
    one_key = F.concat(F.col("snapshot_id").cast("string"), F.lit("@"), F.col("server_name"))
    return rows.withColumn("_snapshot", one_key).join(chosen.select(one_key.alias("_snapshot")), "_snapshot", "left_semi").drop("_snapshot")


def load_newest(spark: SparkSession, root: str, views: Iterable[str], as_of=None, register: DataFrame | None = None) -> dict[str, DataFrame]:
    """All ``views`` of a report at each server's newest complete snapshot.
    The register is ``<root>/register`` unless given."""
    views = list(views)
    if register is None:
        register = spark.read.schema(REGISTER).parquet(f"{root}/register")
    chosen = newest_snapshots(register, views, as_of)
    return {view: load_view(spark, root, view, chosen) for view in views}
