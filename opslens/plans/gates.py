"""Which checks and listings run on which server.

The health check leaves some checks out on hosted platforms, and prints some
listings only when asked. Here that is a table: a gate (check_id, platform,
min_major, max_major, option) closes a check on the servers of a platform
(NULL: all) whose major version lies in the range (NULL: open end), unless
the server asks for ``option`` (NULL: closed whatever it asks for). Servers of
all platforms are served by one run; a check without a gate is open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shape import dim, kcols

GATE = "check_id string, platform string, min_major int, max_major int, option string"
BOX, RDS, AZURE_DB, AZURE_MI = "box", "rds", "azure_db", "azure_mi"
PLATFORMS = [BOX, RDS, AZURE_DB, AZURE_MI]
# Engine editions of the hosted platforms.
ENGINE_EDITIONS = {5: AZURE_DB, 8: AZURE_MI}
# What is closed where, and the option that opens a listing.
GATES = [
    ("B7.database_owner", RDS, None, None, None), ("B7.database_owner", AZURE_DB, None, None, None),
    ("B7.job_owner", RDS, None, None, None), ("B7.job_owner", AZURE_DB, None, None, None),
    ("B7.package_owner", RDS, None, None, None), ("B7.package_owner", AZURE_DB, None, None, None),
    ("B10.msdb_size", AZURE_DB, None, None, None),
    ("D6.no_log_backup", AZURE_DB, None, None, None),
    ("D11.never_checked", RDS, None, None, None),
    ("D12.stale_integrity", RDS, None, None, None),
    ("B6.owner_listing", RDS, None, None, None), ("B6.owner_listing", AZURE_DB, None, None, None),
    ("B6.owner_listing", None, None, None, "settings"),
    ("B2.config_listing", None, None, None, "settings"),
    ("B4.db_settings", None, None, None, "settings"),
    ("D7.stale_log_backup_listing", None, None, None, "settings"),
    ("D8.last_full_backup", None, None, None, "settings"),
    ("D10.integrity_checks", None, None, None, "settings"),
    ("B12.module_listing", None, None, None, "settings"),
    ("G2.index_fragmentation", None, None, None, "fragmentation"),
    ("G3.statistics_dates", None, None, None, "fragmentation"),
]


def gate_table(spark: SparkSession) -> DataFrame:
    return dim(spark, GATES, GATE)


def platform() -> Column:
    """A server's platform, from ``engine_edition`` and ``is_rds``."""
    out = F.when(F.col("is_rds"), RDS)
    for edition, name in ENGINE_EDITIONS.items():
        out = out.when(F.col("engine_edition") == edition, name)
    return out.otherwise(BOX)


def open_gates(rows: DataFrame, instances: DataFrame, gates: DataFrame, options: Sequence[str] | DataFrame = (), keys=None,
               check: Column | None = None) -> DataFrame:
    """``rows`` (of findings, or of a listing named by ``check``) without
    those whose gate is closed on their server. ``options``: asked for by all
    servers, or a table (keys, option) of what each asks for.

    Closed gates are resolved per server and check first (servers x gates
    that name their platform), then rows are joined by server and check."""
    k = kcols(keys)
    servers = instances.select(*k, platform().alias("platform"), F.element_at(F.split("product_version", r"\."), 1).try_cast("int").alias("_major")).distinct()
    # A gate for all platforms is one for each, so that the join has a key.
    each = F.when(F.col("platform").isNull(), F.array(*[F.lit(p) for p in PLATFORMS])).otherwise(F.array("platform"))
    named = gates.select("check_id", F.explode(each).alias("platform"), "min_major", "max_major", "option")
    inside = (F.col("min_major").isNull() | (F.col("_major") >= F.col("min_major"))) & (F.col("max_major").isNull() | (F.col("_major") <= F.col("max_major")))
    closed = servers.join(named, "platform").where(inside)
    if isinstance(options, DataFrame):
        asked = options.select(*k, "option").distinct()
        closed = closed.join(asked, [*k, "option"], "left_anti")
    elif options:
        closed = closed.where(F.col("option").isNull() | ~F.col("option").isin(*options))
    shut = closed.select(*k, F.col("check_id").alias("_check")).distinct()
    named_rows = rows.withColumn("_check", F.col("check_id") if check is None else check)
    return named_rows.join(shut, [*k, "_check"], "left_anti").drop("_check")
