"""Family B — databases and configuration. The findings are
rules of ``checks``; listings are plain selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tsql import ci_like_any
from ..plans.patterns import like_any_of
from ..plans.rules import run_checks
from ..plans.shape import kcols
from . import checks as K
from .checks import MODULE_PATTERNS

# The settings the configuration listing shows.
CONFIG_NAMES = ["backup compression default", "clr enabled", "max degree of parallelism",
                "cost threshold for parallelism", "min server memory (MB)",
                "max server memory (MB)", "max full-text crawl range", "priority boost",
                "optimize for ad hoc workloads", "remote admin connections"]
# Compatibility level -> release name.
COMPAT_NAMES = {80: "2000", 90: "2005", 100: "2008", 110: "2012", 120: "2014",
                130: "2016", 140: "2017", 150: "2019"}


def live(databases: DataFrame) -> DataFrame:
    """Databases that are not database snapshots."""
    return databases.filter(F.col("source_database_id").isNull())


def db_count_by_state(databases: DataFrame, keys=None) -> DataFrame:
    """B1: number of databases per state, snapshots excluded."""
    k = kcols(keys)
    return live(databases).groupBy(*k, "state_desc").agg(F.count(F.lit(1)).alias("db_count"))


def config_listing(config: DataFrame, keys=None) -> DataFrame:
    """B2: the ten reviewed settings."""
    return config.filter(F.col("name").isin(CONFIG_NAMES)) \
        .select(*kcols(keys), "name", "value", "value_in_use")


def config_checks(config: DataFrame, instances: DataFrame, keys=None) -> DataFrame:
    """The ten configuration rules, from one pass over the settings.

    Memory rules test ``value``; the others ``value_in_use``. Full-text crawl
    range is judged only where full-text is installed."""
    return run_checks([K.CONFIGURATION], {"config": config, "instances": instances}, keys)


def compat_name(level: Column) -> Column:
    out = None
    for lv, name in COMPAT_NAMES.items():
        out = F.when(level == lv, name) if out is None else out.when(level == lv, name)
    return out.otherwise(level.cast("string"))


def db_settings(databases: DataFrame, keys=None) -> DataFrame:
    """Database settings listing with the compatibility level's release."""
    return live(databases).select(
        *kcols(keys), F.col("name").alias("database_name"), "recovery_model_desc",
        "log_reuse_wait_desc", "is_encrypted", "compatibility_level",
        compat_name(F.col("compatibility_level")).alias("compat_release"),
        "page_verify_option_desc", "is_auto_close_on", "is_auto_shrink_on", "is_auto_update_stats_on",
        "is_auto_create_stats_on", "is_auto_update_stats_async_on", "is_parameterization_forced",
        "snapshot_isolation_state_desc", "is_read_committed_snapshot_on")


def db_setting_checks(databases: DataFrame, instances: DataFrame, keys=None) -> DataFrame:
    """Six counted rules over non-snapshot databases: encrypted,
    compatibility below the instance's, page verify not CHECKSUM, auto close,
    auto shrink, auto update statistics off."""
    return run_checks([K.SETTINGS], {"databases": databases, "instances": instances}, keys)


def owner_listing(databases: DataFrame, jobs: DataFrame, packages: DataFrame, keys=None) -> DataFrame:
    """Objects not owned by ``sa``. A database with an unresolved (NULL)
    owner is listed; jobs and packages with a NULL owner are not."""
    k = kcols(keys)
    dbs = live(databases).filter(F.col("owner_name").isNull() | (F.lower("owner_name") != "sa")) \
        .select(*k, F.lit("database").alias("object_kind"), F.col("name").alias("object_name"),
                "owner_name", F.lit(None).cast("int").alias("enabled"))
    jb = jobs.filter(F.lower("owner_name") != "sa").select(
        *k, F.lit("job").alias("object_kind"), F.col("name").alias("object_name"), "owner_name",
        F.col("enabled").cast("int").alias("enabled"))
    pk = packages.filter(F.lower("owner_name") != "sa").select(
        *k, F.lit("package").alias("object_kind"), F.col("name").alias("object_name"), "owner_name",
        F.lit(None).cast("int").alias("enabled"))
    return dbs.unionByName(jb).unionByName(pk)


def owner_checks(databases: DataFrame, jobs: DataFrame, packages: DataFrame, keys=None) -> DataFrame:
    """Per object kind, how many are not owned by ``sa``."""
    return run_checks([K.OWNERS], {"databases": databases, "jobs": jobs, "packages": packages}, keys)


def trace_flag_checks(flags: DataFrame, instances: DataFrame, databases: DataFrame,
                      keys=None) -> DataFrame:
    """Trace flags 1117/1118 (before v13 only), 3226 (always), 2371
    (before v13, or from v13 when a database is below compatibility 130)."""
    return run_checks([K.TRACE], {"trace_flags": flags, "instances": instances, "databases": databases}, keys)


def service_account_checks(services: DataFrame, instances: DataFrame, keys=None) -> DataFrame:
    """Instant file initialisation for the engine service and lock pages
    in memory (memory model 2); only verifiable from 2016 SP1 / 2012 SP4 on."""
    return run_checks([K.SERVICE_ACCOUNTS], {"services": services, "instances": instances}, keys)


def msdb_size_check(files: DataFrame, keys=None) -> DataFrame:
    """Does any msdb file exceed 2 GB (size*8/1024 > 2048, truncated)."""
    return run_checks([K.MSDB_SIZE], {"master_files": files}, keys)


def recovery_models(databases: DataFrame, keys=None) -> DataFrame:
    """B11 listing: recovery model per non-snapshot database."""
    return live(databases).select(*kcols(keys), F.col("name").alias("database_name"),
                                  "recovery_model_desc")


def recovery_model_count(databases: DataFrame, keys=None) -> DataFrame:
    """B11 finding: how many databases use the FULL recovery model."""
    return run_checks([K.FULL_RECOVERY], {"databases": databases}, keys)


def matching_modules(modules: DataFrame, patterns=None) -> DataFrame:
    """Modules whose name is LIKE one of the patterns: the fixed ones, a few
    given ones (a list), or a table of any size with a ``pattern`` column."""
    if isinstance(patterns, DataFrame):
        return like_any_of(modules, "name", patterns)
    return modules.filter(ci_like_any("name", patterns or MODULE_PATTERNS))


def module_listing(modules: DataFrame, keys=None, patterns=None) -> DataFrame:
    """B12 listing: loaded modules matching the anti-virus patterns."""
    return matching_modules(modules, patterns).select(*kcols(keys), "name")


def module_check(modules: DataFrame, keys=None, patterns=None) -> DataFrame:
    """B12 finding per server: are such modules loaded."""
    if isinstance(patterns, DataFrame):
        # Modules that match a pattern of the table, once each, beside all of them for the servers that have none.
        hits = matching_modules(modules, patterns).withColumn("name", F.lit("hit"))
        modules, patterns = modules.withColumn("name", F.lit("")).unionByName(hits), ["hit"]
    return run_checks([K.AV_MODULES], {"modules": modules}, keys, module_patterns=patterns)
