"""Family D — backups and integrity checks.

Backup history is the large, append-only fact. It is aggregated per
(fleet key, database) *before* meeting the database catalog, so a database
with millions of backup rows costs one partial aggregate, not a skewed join.
Date arithmetic uses an explicit ``as_of`` (the snapshot time), never the
clock, so results repeat.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tsql import ci_like_any, datediff_boundaries
from ..plans.rules import run_checks
from ..plans.shape import kcols, lookup_join
from . import checks as K
from .checks import MODEL_ID, TEMPDB_ID
from .database import live

# System databases skipped by the backup plan.
SYSTEM_DBS = ["master", "model", "msdb", "tempdb"]
NEVER_CHECKED = dt.datetime(1900, 1, 1)
# Commands whose progress is reported.
BACKUP_RESTORE = ["BACKUP DATABASE", "RESTORE DATABASE"]


def _as_of(as_of) -> F.Column:
    if isinstance(as_of, F.Column):
        return as_of
    return F.lit(as_of).cast("timestamp_ntz")


def backup_history(backupset: DataFrame, media: DataFrame, database: str | None = None,
                   backup_type: str = "D", keys=None) -> DataFrame:
    """Backup sets of ``backup_type`` (D full, I differential, L log) with
    their media devices; ``database=None`` covers every database."""
    k = kcols(keys)
    bs = backupset.filter(F.col("type") == backup_type)
    if database is not None:
        bs = bs.filter(F.lower("database_name") == database.lower())
    bs = bs.select(*k, "media_set_id", "database_name", "backup_start_date", "backup_finish_date",
                   "type", F.col("name").alias("backupset_name"))
    m = media.select(*k, "media_set_id", "physical_device_name", "logical_device_name")
    return m.join(bs, k + ["media_set_id"], "inner") \
        .select(*k, "database_name", "backup_start_date", "backup_finish_date", "type",
                "backupset_name", "physical_device_name", "logical_device_name")


def last_backup_location(backupset: DataFrame, media: DataFrame, database: str, keys=None) -> DataFrame:
    """All devices of the newest media set (per server) that has a device
    named like ``%<database>%.bak`` and a backup set."""
    k = kcols(keys)
    pattern = f"%{database}%.bak"
    cand = media.filter(F.lower("physical_device_name").like(pattern.lower())) \
        .select(*k, "media_set_id").join(backupset.select(*k, "media_set_id"), k + ["media_set_id"], "left_semi")
    newest = cand.groupBy(*k).agg(F.max("media_set_id").alias("media_set_id"))
    return media.join(newest, k + ["media_set_id"], "left_semi") \
        .select(*k, "media_set_id", "family_sequence_number", "physical_device_name")


def _with_text(requests: DataFrame, sql_text: DataFrame, how: str, keys) -> DataFrame:
    """Attach statement text, landed per server, by fleet key and handle."""
    k = kcols(keys)
    return lookup_join(requests, sql_text.select(*k, "sql_handle", "text"), k + ["sql_handle"], how)


def request_progress(requests: DataFrame, sql_text: DataFrame, as_of, commands=None,
                     keys=None) -> DataFrame:
    """Requests with their text, percent complete and an ETA =
    as_of + estimated ms / 1000 (whole seconds). Requests without text drop
    out (CROSS APPLY). ``commands`` restricts the command (case-insensitive)."""
    k = kcols(keys)
    r = requests
    if commands:
        r = r.filter(F.lower("command").isin([c.lower() for c in commands]))
    r = r.select(*k, F.col("spid"), "command", "start_time", "percent_complete",
                 "estimated_completion_time", "sql_handle")
    j = _with_text(r, sql_text, "inner", keys)
    eta = F.timestamp_add("SECOND", F.call_function("div", F.col("estimated_completion_time"), F.lit(1000)),
                          _as_of(as_of))
    return j.select(*k, "spid", "command", F.col("text").alias("query"), "start_time",
                    "percent_complete", eta.alias("estimated_completion"))


def backup_restore_progress(requests, sql_text, as_of, keys=None):
    """D3: progress of BACKUP DATABASE / RESTORE DATABASE requests."""
    return request_progress(requests, sql_text, as_of, BACKUP_RESTORE, keys)


def backup_restore_waits(requests: DataFrame, keys=None) -> DataFrame:
    """Any backup or restore command: status, wait type, percent."""
    return requests.filter(ci_like_any("command", ["%restore%", "%backup%"])) \
        .select(*kcols(keys), "spid", "status", "command", "wait_type", "percent_complete")


def _log_backup_facts(backupset: DataFrame, keys) -> DataFrame:
    k = kcols(keys)
    return backupset.filter(F.col("type") == "L").groupBy(*k, "database_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("recovery_model").isNull() | F.col("backup_finish_date").isNull()).alias("n_bad"),
        F.max("backup_finish_date").alias("last_log_backup"))


def is_system_db(name: str) -> Column:
    """Whether a database is one of the system's (names without case)."""
    return F.lower(name).isin(SYSTEM_DBS)


def _log_eligible(databases: DataFrame, keys) -> DataFrame:
    return live(databases).filter(~F.col("database_id").isin(TEMPDB_ID, MODEL_ID)
                                  & F.col("recovery_model").isin(1, 2)) \
        .select(*kcols(keys), F.col("name").alias("database_name"))


def no_log_backup(databases: DataFrame, backupset: DataFrame, keys=None) -> DataFrame:
    """full/bulk-logged databases without a usable log backup. Counts the
    rows of databases LEFT JOIN log backups where the backup's recovery model
    or finish is NULL, as the source does (join rows, not databases)."""
    return run_checks([K.NO_LOG_BACKUP], {"databases": databases, "backupset": backupset}, keys)


def stale_log_backup(databases: DataFrame, backupset: DataFrame, as_of, days: int = 1,
                     keys=None) -> DataFrame:
    """Databases whose newest log backup is more than ``days`` days old
    (day boundaries); databases without any log backup are not listed here.
    One row per name, as the source groups by it."""
    k = kcols(keys)
    j = _log_eligible(databases, keys).distinct().join(_log_backup_facts(backupset, keys), k + ["database_name"], "left")
    age = datediff_boundaries("day", F.col("last_log_backup"), _as_of(as_of))
    return j.select(*k, "database_name", "last_log_backup", age.alias("age_days")) \
        .filter(F.col("age_days") > days)


def stale_log_backup_count(databases: DataFrame, backupset: DataFrame, as_of, days: int = 1, keys=None) -> DataFrame:
    """D7 finding: how many databases (names) have a newest log backup older
    than ``days`` days."""
    return run_checks([K.OLD_LOG_BACKUP], {"databases": databases, "backupset": backupset}, keys, as_of=as_of, log_days=days)


def _full_backups(databases: DataFrame, backupset: DataFrame, keys) -> DataFrame:
    k = kcols(keys)
    facts = backupset.filter(F.col("type") == "D").groupBy(*k, "database_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("backup_finish_date").isNull()).alias("n_null"),
        F.max("backup_finish_date").alias("last_full_backup"))
    d = live(databases).filter(~F.col("database_id").isin(TEMPDB_ID, MODEL_ID)) \
        .select(*k, F.col("name").alias("database_name"))
    return d.join(facts, k + ["database_name"], "left")


def last_full_backup(databases: DataFrame, backupset: DataFrame, keys=None) -> DataFrame:
    """Newest full backup per database name (NULL when none)."""
    return _full_backups(databases, backupset, keys).select(*kcols(keys), "database_name", "last_full_backup").distinct()


def no_full_backup(databases: DataFrame, backupset: DataFrame, keys=None) -> DataFrame:
    """Join rows with a NULL full-backup finish: databases with no full
    backup, plus full backups that never finished."""
    return run_checks([K.NO_FULL_BACKUP], {"databases": databases, "backupset": backupset}, keys)


def _last_good(dbinfo: DataFrame, keys) -> DataFrame:
    k = kcols(keys)
    return dbinfo.filter((F.lower("field") == "dbi_dbcclastknowngood") & (F.lower("database_name") != "tempdb")) \
        .select(*k, "database_name", F.col("value").alias("last_clean")).dropDuplicates()


def integrity_checks(dbinfo: DataFrame, keys=None) -> DataFrame:
    """Last clean integrity check per database (duplicates removed,
    tempdb excluded); the 1900-01-01 sentinel reads "never"."""
    never = F.col("last_clean") == F.lit(NEVER_CHECKED).cast("timestamp_ntz")
    return _last_good(dbinfo, keys).select(
        *kcols(keys), "database_name", "last_clean",
        F.when(never, F.lit("Never ran DBCC CHECKDB"))
        .otherwise(F.date_format("last_clean", "yyyy-MM-dd HH:mm:ss")).alias("last_clean_text"))


def never_checked(dbinfo: DataFrame, keys=None) -> DataFrame:
    """How many databases never had an integrity check."""
    return run_checks([K.NEVER], {"dbinfo": dbinfo}, keys)


def stale_integrity(dbinfo: DataFrame, as_of, days: int = 7, keys=None) -> DataFrame:
    """D12 listing: clean-check dates older than ``days`` days."""
    age = datediff_boundaries("day", F.col("last_clean"), _as_of(as_of))
    return _last_good(dbinfo, keys).filter(F.col("last_clean") > F.lit(NEVER_CHECKED).cast("timestamp_ntz")) \
        .select(*kcols(keys), "database_name", "last_clean", age.alias("age_days")) \
        .filter(F.col("age_days") > days)


def stale_integrity_count(dbinfo: DataFrame, as_of, days: int = 7, keys=None) -> DataFrame:
    """D12 finding: number of such (database, date) rows per server."""
    return run_checks([K.STALE], {"dbinfo": dbinfo}, keys, as_of=as_of, check_days=days)


def backup_plan(databases: DataFrame, path: str, as_of, keys=None) -> DataFrame:
    """Target file per user database: path + name + _yyyyMMdd.BAK (the
    selection and naming only; nothing is executed)."""
    return databases.filter(~is_system_db("name")).select(
        *kcols(keys), F.col("name").alias("database_name"),
        F.concat(F.lit(path), F.col("name"), F.lit("_"), F.date_format(_as_of(as_of), "yyyyMMdd"),
                 F.lit(".BAK")).alias("backup_file"))
