"""The health check's rules: what each check measures
of its sources, and the findings that follow. ``operators`` modules run them
one by one, ``report.health_check_findings`` all together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tsql import UNLIMITED_MEMORY_MB, ci_like_any, datediff_boundaries, money, pages_to_mb_trunc
from ..plans.rules import Check, Source, counted, landed

c = F.col  # measures, in what follows

# Ids of system databases, limits of the checks.
TEMPDB_ID, MODEL_ID, MSDB_ID = 2, 3, 4
MSDB_LIMIT_MB = 2048
UNLIMITED_2TB = 268435456
VLF_LIMIT = 500
NEVER_CHECKED = "1900-01-01 00:00:00"
MODULE_PATTERNS = ["%sophos%.dll", "%swi_ifslsp_64.dll", "%swi_ifslsp.dll"]
# Types of database files (rows, log, filestream, not used, full-text).
FILE_TYPES = range(5)


def _warn(bad: Column, otherwise: str) -> Column:
    return F.when(bad, "warn").otherwise(otherwise)


# ---------------------------------------------------------------- sources
_CATALOG = {"source_database_id": "int", "database_id": "bigint", "is_encrypted": "boolean", "page_verify_option_desc": "string", "is_auto_close_on": "boolean",
            "is_auto_shrink_on": "boolean", "is_auto_update_stats_on": "boolean", "owner_name": "string", "recovery_model_desc": "string",
            "compatibility_level": "int", "recovery_model": "int"}


def _instances(tables, keys) -> DataFrame:
    from .instance import decode_version, physical_memory_gb
    return decode_version(tables["instances"]).withColumn("_phys_gb", physical_memory_gb(tables["instances"]))


def _database_names(tables, keys) -> DataFrame:
    """One row per database name: what its catalog rows and its backups say.
    Both are summed by name together, without a join."""
    d = tables["databases"]
    # A landing may lack columns that the checks asked for do not read.
    catalog = [(F.col(n) if n in d.columns else F.lit(None).cast(kind)).alias(n) for n, kind in _CATALOG.items()]
    d, live = d.select(*keys, F.col("name").alias("_name"), *catalog), F.col("source_database_id").isNull()
    own = live & ~F.col("database_id").isin(TEMPDB_ID, MODEL_ID)
    flags = {
        "enc": live & F.col("is_encrypted"), "pv": live & (F.lower("page_verify_option_desc") != "checksum"),
        "ac": live & F.col("is_auto_close_on"), "ash": live & F.col("is_auto_shrink_on"), "aus": live & ~F.col("is_auto_update_stats_on"),
        "owner": live & (F.col("owner_name").isNull() | (F.lower("owner_name") != "sa")), "full": live & (F.lower("recovery_model_desc") == "full"),
        "low": live & (F.col("compatibility_level") < 130), "live": live, "log_due": own & F.col("recovery_model").isin(1, 2), "full_due": own}
    sums = [F.count_if(x).alias(n) for n, x in flags.items()]
    # At most the databases of one server.
    levels = F.collect_list(F.when(live, F.col("compatibility_level"))).alias("levels")
    if "backupset" not in tables:
        return d.groupBy(*keys, "_name").agg(*sums, levels)
    b = tables["backupset"]
    rows = d.select("*", F.lit(None).cast("string").alias("_type"), F.lit(False).alias("_no_model"), F.lit(None).cast("timestamp_ntz").alias("_finish"))
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema}
    # A backup's row is no database: an id that no rule counts.
    none["source_database_id"] = F.lit(-1).cast(rows.schema["source_database_id"].dataType).alias("source_database_id")
    own_columns = {"_name": F.col("database_name").alias("_name"), "_type": F.col("type").alias("_type"),
                   "_no_model": F.col("recovery_model").isNull().alias("_no_model"), "_finish": F.col("backup_finish_date").alias("_finish")}
    taken = b.where(F.col("type").isin("L", "D")).select(*keys, *[own_columns.get(n, none[n]) for n in rows.columns if n not in keys])
    log, full = F.col("_type") == "L", F.col("_type") == "D"
    return rows.union(taken.select(*rows.columns)).groupBy(*keys, "_name").agg(
        *sums, levels, F.count_if(log).alias("log_rows"), F.count_if(log & (F.col("_no_model") | F.col("_finish").isNull())).alias("log_bad"),
        F.max(F.when(log, F.col("_finish"))).alias("log_last"), F.count_if(full).alias("full_rows"),
        F.count_if(full & F.col("_finish").isNull()).alias("full_null"))


def _last_clean(tables, keys) -> DataFrame:
    from .backup import _last_good
    return _last_good(tables["dbinfo"], keys)


def _vlfs(tables, keys) -> DataFrame:
    from .storage import vlf_counts
    return vlf_counts(tables["log_info"], keys)


INSTANCES = Source("instances", _instances)
NAMES = Source("databases", _database_names)
CLEAN = Source("dbinfo", _last_clean)
VLFS = Source("log_info", _vlfs)
CONFIG, SCHEDULERS, JOBS, PACKAGES, FLAGS = (landed(n) for n in ("config", "schedulers", "jobs", "packages", "trace_flags"))
SERVICES, MODULES, GROUPS, FILES = (landed(n) for n in ("services", "modules", "availability_groups", "master_files"))


def _one(column: str) -> Column:
    return F.first(column, ignorenulls=True)


# ---------------------------------------------------------------- A4
def _a4_measures(given):
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("value_in_use")))
    visible = F.count_if((F.lower("status") == "visible online") & F.col("cpu_id").isNotNull())
    return {INSTANCES: {"i_name": _one("server_name"), "i_machine": _one("machine_name"), "i_phys_gb": _one("_phys_gb"), "i_cpus": _one("cpu_count"),
                        "i_here": F.lit(True)},
            SCHEDULERS: {"s_visible": F.nullif(visible, F.lit(0).cast("long"))}, CONFIG: {"c_max_mem": value("max server memory (MB)")}}


def _a4_items(given):
    warn = F.lit("warn")
    return [
        ("A4.server_name", warn, c("i_machine"), F.concat(F.lit("server name differs from machine name "), c("i_machine")), c("i_name") != c("i_machine")),
        ("A4.cpu", warn, c("s_visible"), F.format_string("%d OS CPUs but %d visible schedulers", c("i_cpus"), c("s_visible")), c("i_cpus") != c("s_visible")),
        ("A4.max_memory", warn, c("c_max_mem"), F.lit("SQL max memory is above physical memory"),
         (c("i_phys_gb").cast("double") < c("c_max_mem") / 1024.0) & (c("c_max_mem") != UNLIMITED_MEMORY_MB)),
    ]


# ---------------------------------------------------------------- B3
def _b3_measures(given):
    def has(name, column, v):
        return F.max(F.when((F.col("name") == name) & (F.col(column) == v), 1).otherwise(0)) > 0

    def value(name):
        return F.max(F.when(F.col("name") == name, F.col("value_in_use")))
    return {CONFIG: {
        "c_here": F.lit(True), "c_max_unset": has("max server memory (MB)", "value", UNLIMITED_MEMORY_MB), "c_min_unset": has("min server memory (MB)", "value", 0),
        "c_max_mem": value("max server memory (MB)"), "c_min_mem": value("min server memory (MB)"),
        "c_bc0": has("backup compression default", "value_in_use", 0), "c_bc1": has("backup compression default", "value_in_use", 1),
        "c_ah0": has("optimize for ad hoc workloads", "value_in_use", 0), "c_ah1": has("optimize for ad hoc workloads", "value_in_use", 1),
        "c_clr": has("clr enabled", "value_in_use", 1), "c_rac": has("remote admin connections", "value_in_use", 1), "c_pb": has("priority boost", "value_in_use", 1),
        "c_dop1": has("max degree of parallelism", "value_in_use", 1), "c_dop0": has("max degree of parallelism", "value_in_use", 0),
        "c_dop": value("max degree of parallelism"), "c_ct5": has("cost threshold for parallelism", "value_in_use", 5),
        "c_ct": value("cost threshold for parallelism"), "c_cr4": has("max full-text crawl range", "value_in_use", 4),
        "c_cr": value("max full-text crawl range")}, INSTANCES: {"i_fulltext": _one("is_fulltext_installed")}}


def _b3_items(given):
    here, gb = c("c_here"), lambda x: money(x / F.lit(1024.0))

    def memory(check_id, unset, value, what):
        return (check_id, _warn(unset, "info"), value, F.when(unset, F.lit(f"{what} server memory is NOT SET"))
                .otherwise(F.concat(F.lit(f"{what} server memory is set to "), gb(value), F.lit(" GB"))), here)

    def switch(check_id, off, on, what):
        return (check_id, _warn(off, "info"), on.cast("int"), F.when(off, f"{what} is NOT ENABLED").when(on, f"{what} is enabled")
                .otherwise(f"{what} is not available"), here)

    def unwanted(check_id, on, what):
        return check_id, _warn(on, "ok"), on.cast("int"), F.when(on, f"{what} IS ENABLED").otherwise(f"{what} is not enabled"), here
    full_text = F.coalesce(c("i_fulltext"), F.lit(False))
    dop, ct, crawl = c("c_dop").cast("string"), c("c_ct").cast("string"), c("c_cr").cast("string")
    return [
        memory("B3.max_memory", c("c_max_unset"), c("c_max_mem"), "max"), memory("B3.min_memory", c("c_min_unset"), c("c_min_mem"), "min"),
        switch("B3.backup_compression", c("c_bc0"), c("c_bc1"), "backup compression"),
        switch("B3.adhoc", c("c_ah0"), c("c_ah1"), "optimize for ad hoc workloads"),
        unwanted("B3.clr", c("c_clr"), "clr"), unwanted("B3.remote_admin", c("c_rac"), "remote admin connections"),
        unwanted("B3.priority_boost", c("c_pb"), "priority boost"),
        ("B3.maxdop", F.when(c("c_dop0"), "ok").otherwise("warn"), c("c_dop"),
         F.when(c("c_dop1"), F.lit("maxdop IS DISABLED")).when(c("c_dop0"), F.lit("maxdop is set to the default of 0"))
         .otherwise(F.concat(F.lit("maxdop is set to "), dop, F.lit(" - NOT DEFAULT"))), here),
        ("B3.cost_threshold", _warn(c("c_ct5") | (c("c_ct") < 25), "info"), c("c_ct"),
         F.when(c("c_ct5"), F.lit("cost threshold for parallelism is the default of 5 - too low"))
         .when(c("c_ct") < 25, F.concat(F.lit("cost threshold for parallelism is "), ct, F.lit(" - too low?")))
         .otherwise(F.concat(F.lit("cost threshold for parallelism is "), ct, F.lit(" - sufficient?"))), here),
        ("B3.fulltext_crawl", F.when(~full_text, "info").when(c("c_cr4"), "ok").otherwise("warn"), c("c_cr"),
         F.when(~full_text, F.lit("full-text is not installed; crawl range can be ignored"))
         .when(c("c_cr4"), F.lit("max full-text crawl range is the default of 4"))
         .otherwise(F.concat(F.lit("max full-text crawl range is "), crawl, F.lit(" - NOT DEFAULT"))), here),
    ]


# ---------------------------------------------------------------- B5, B7, B8, B11: databases by name
def _version(given):
    return {INSTANCES: {"i_here": F.lit(True), "i_major": _one("v_major").try_cast("int"), "i_build": _one("v_build"), "i_memory_model": _one("memory_model")}}


def _sum(name: str) -> Column:
    return F.sum(name).cast("long")


def _b5_measures(given):
    return _version(given) | {NAMES: {"d_live": _sum("live"), "d_levels": F.flatten(F.collect_list("levels")),
                                      **{f"d_{n}": _sum(n) for n in ("enc", "pv", "ac", "ash", "aus")}}}


def _b5_items(given):
    here = (c("d_live") > 0) & c("i_here")
    below = F.size(F.filter("d_levels", lambda level: level < c("i_major") * 10))
    return [counted("B5.encryption", c("d_enc"), "Encryption is enabled on %d database(s)", "Encryption verified", here),
            counted("B5.compat_level", below, "Compatibility level below the instance version on %d database(s)", "Compatibility level verified", here),
            counted("B5.page_verify", c("d_pv"), "Page verify not CHECKSUM on %d database(s)", "Page verify option verified", here),
            counted("B5.auto_close", c("d_ac"), "Auto Close is enabled on %d database(s)", "Auto Close verified", here),
            counted("B5.auto_shrink", c("d_ash"), "Auto Shrink is enabled on %d database(s)", "Auto Shrink verified", here),
            counted("B5.auto_update_stats", c("d_aus"), "Auto Update Stats is NOT ENABLED on %d database(s)", "Auto Update Stats verified", here)]


def _b7_measures(given):
    foreign = F.count_if(F.lower("owner_name") != "sa")
    return {NAMES: {"d_live": _sum("live"), "d_owner": _sum("owner")}, JOBS: {"j_owner": foreign}, PACKAGES: {"p_owner": foreign}}


def _b7_items(given):
    one = lambda check_id, n, kind, here: counted(check_id, n, f"Owner not set to sa on %d {kind}(s)", f"{kind} owners verified", here)
    return [one("B7.database_owner", c("d_owner"), "database", c("d_live") > 0), one("B7.job_owner", c("j_owner"), "job", c("j_owner").isNotNull()),
            one("B7.package_owner", c("p_owner"), "package", c("p_owner").isNotNull())]


TRACE_FLAGS = ("1117", "1118", "3226", "2371")


def _b8_measures(given):
    on = lambda flag: F.max(F.when((F.col("trace_flag") == flag) & F.col("is_global"), 1).otherwise(0))
    return _version(given) | {FLAGS: {f"f_{x}": on(x) for x in TRACE_FLAGS}, NAMES: {"d_low": _sum("low")}}


def _b8_items(given):
    here, new, low = c("i_here"), c("i_major") >= 13, F.coalesce(c("d_low"), F.lit(0).cast("long"))

    def flag(x):
        n = F.coalesce(c(f"f_{x}"), F.lit(0))
        return (F.when(n == 1, "ok").otherwise("warn"), n, F.when(n == 1, F.lit(f"Trace flag {x} is enabled globally"))
                .otherwise(F.lit(f"Trace flag {x} is NOT ENABLED globally")))
    s, o, m = flag("2371")
    moot = new & (low == 0)
    return [
        ("B8.1117_1118", F.lit("info"), c("i_major"), F.lit("Trace flag 1117 & 1118 check not necessary for this version"), here & new),
        ("B8.1117", *flag("1117"), here & ~new), ("B8.1118", *flag("1118"), here & ~new), ("B8.3226", *flag("3226"), here),
        ("B8.2371", F.when(moot, "info").otherwise(s), F.when(moot, low).otherwise(o),
         F.when(moot, F.lit("Trace flag 2371 check not necessary for this version and compatibility levels"))
         .when(new, F.concat(m, F.lit(" - a database is below compatibility level 130"))).otherwise(m), here)]


def _b9_measures(given):
    return _version(given) | {SERVICES: {"v_ifi": F.max(F.when(F.col("servicename").like("SQL Server (%"), F.col("instant_file_initialization_enabled")))}}


def _b9_items(given):
    known = (c("i_major") > 13) | ((c("i_major") == 13) & (c("i_build") >= 4001)) | ((c("i_major") == 11) & (c("i_build") >= 7001))

    def one(check_id, on, observed, what):
        return (check_id, F.when(~known, "info").when(on, "ok").otherwise("warn"), observed,
                F.when(~known, f"{what} not verifiable here - check the OS").when(on, f"{what} is enabled for the service account")
                .otherwise(f"{what} is NOT ENABLED for the service account"), c("i_here"))
    return [one("B9.instant_file_init", c("v_ifi") == "Y", c("v_ifi"), "Instant file initialization"),
            one("B9.lock_pages", c("i_memory_model") == 2, c("i_memory_model"), "Lock pages in memory")]


def _b11_items(given):
    return [("B11.full_recovery", F.lit("info"), c("d_full"), F.format_string("%d database(s) using the FULL recovery model", c("d_full")), c("d_live") > 0)]


def _b12_items(given):
    return [counted("B12.av_modules", c("m_av"), "Anti-virus modules are loaded into the server process", "Anti-virus modules verified - not loaded", c("m_av").isNotNull())]


# ---------------------------------------------------------------- B10, C9, C11, C12: files
def _files(given):
    g, m, temp = F.col("growth"), F.col("max_size"), F.col("database_id") == TEMPDB_ID
    differs = lambda column: F.greatest(*[F.coalesce((F.min(x) != F.max(x)).cast("int"), F.lit(0))
                                          for x in (F.when(temp & (F.col("type") == t), F.col(column)) for t in FILE_TYPES)])
    return {FILES: {
        "x_msdb": F.count_if((F.col("database_id") == MSDB_ID) & (pages_to_mb_trunc("size") > MSDB_LIMIT_MB)),
        "x_no_growth": F.count_if((m == 0) | (g == 0)), "x_fixed": F.count_if((m > 0) & (m < UNLIMITED_2TB) & (g > 0)),
        "x_one_mb": F.count_if((F.expr("growth * 8 div 1024") == 1) & ~F.col("is_percent_growth")),
        "x_temp": F.count_if(temp), "x_temp_data": F.count_if(temp & (F.col("type") == 0)), "x_size_differs": differs("size"), "x_growth_differs": differs("growth")}}


def _of(*names: str):
    """The measures of the files that a check by itself needs."""
    return lambda given: {FILES: {n: x for n, x in _files(given)[FILES].items() if n in names}}


def _c9_items(given):
    none, fixed, here = c("x_no_growth"), c("x_fixed"), c("x_no_growth").isNotNull()
    return [("C9.max_size", _warn((none > 0) | (fixed > 0), "ok"), F.when(none > 0, none).when(fixed > 0, fixed).otherwise(F.lit(0)),
             F.when(none > 0, F.format_string("No growth allowed on %d file(s)", none))
             .when(fixed > 0, F.format_string("File growth limited to fixed size on %d file(s)", fixed)).otherwise(F.lit("Max file size verified")), here),
            counted("C9.increment_1mb", c("x_one_mb"), "Growth increment set to 1MB on %d file(s)", "File growth verified", here)]


def _c11_items(given):
    two = c("x_temp") == 2
    return [("C11.tempdb_files", _warn(two, "info"), F.when(two, F.lit(1)).otherwise(c("x_temp_data")),
             F.when(two, F.lit("Only 1 tempdb data file set")).otherwise(F.format_string("tempdb DATA file count = %d", c("x_temp_data"))), c("x_temp") > 0)]


def _c12_items(given):
    one = lambda check_id, n, bad, good: counted(check_id, n, bad, good, c("x_temp") > 0)
    return [one("C12.initial_size", c("x_size_differs"), "Tempdb initial file size not the same", "Tempdb initial file size verified"),
            one("C12.growth", c("x_growth_differs"), "Tempdb growth increments not the same", "Tempdb growth increments verified")]


# ---------------------------------------------------------------- C13, D, H
def _as_of(given) -> Column:
    when = given["as_of"]
    return when if isinstance(when, Column) else F.lit(when).cast("timestamp_ntz")


def _c13_items(given):
    n, limit = c("l_over"), given.get("vlf_limit", VLF_LIMIT)
    return [("C13.vlf", _warn(n > 0, "ok"), n, F.when(n > 0, F.format_string("%d database(s) with more than %d VLFs", n, F.lit(limit)))
             .otherwise(F.lit("VLF counts verified")), n.isNotNull())]


def _d7_measures(given):
    age = datediff_boundaries("day", F.col("log_last"), _as_of(given))
    return {NAMES: {"d_log_due": _sum("log_due"), "d_log_old": F.count_if((F.col("log_due") > 0) & (age > given.get("log_days", 1)))}}


def _d12_measures(given):
    age = datediff_boundaries("day", F.col("last_clean"), _as_of(given))
    ever = F.col("last_clean") > F.lit(NEVER_CHECKED).cast("timestamp_ntz")
    return {CLEAN: {"k_stale": F.count_if(ever & (age > given.get("check_days", 7)))}}


def _due(rows: str, bad: str, due: str) -> Column:
    """Join rows of due databases and their backups that lack what is asked
    for: one for a database without backups, else its bad ones."""
    return F.sum(F.col(due) * F.when(F.col(rows) == 0, F.lit(1).cast("long")).otherwise(F.col(bad))).cast("long")


IDENTITY = Check(_a4_measures, _a4_items)
CONFIGURATION = Check(_b3_measures, _b3_items)
SETTINGS = Check(_b5_measures, _b5_items)
OWNERS = Check(_b7_measures, _b7_items)
TRACE = Check(_b8_measures, _b8_items)
SERVICE_ACCOUNTS = Check(_b9_measures, _b9_items)
MSDB_SIZE = Check(_of("x_msdb"), lambda given: [counted("B10.msdb_size", c("x_msdb"), "msdb has at least one file greater than 2GB", "msdb size verified", c("x_msdb").isNotNull())])
FULL_RECOVERY = Check(lambda given: {NAMES: {"d_live": _sum("live"), "d_full": _sum("full")}}, _b11_items)
AV_MODULES = Check(lambda given: {MODULES: {"m_av": F.count_if(ci_like_any("name", given.get("module_patterns") or MODULE_PATTERNS))}}, _b12_items)
FILE_GROWTH = Check(_of("x_no_growth", "x_fixed", "x_one_mb"), _c9_items)
TEMPDB_COUNT = Check(_of("x_temp", "x_temp_data"), _c11_items)
TEMPDB_UNIFORM = Check(_of("x_temp", "x_size_differs", "x_growth_differs"), _c12_items)
VLF = Check(lambda given: {VLFS: {"l_over": F.count_if(F.col("vlf_count") > given.get("vlf_limit", VLF_LIMIT))}}, _c13_items)
NO_LOG_BACKUP = Check(lambda given: {NAMES: {"d_log_due": _sum("log_due"), "d_no_log": _due("log_rows", "log_bad", "log_due")}},
                      lambda given: [counted("D6.no_log_backup", c("d_no_log"), "No LOG backup taken on %d database(s)", "LOG backups verified", c("d_log_due") > 0)])
OLD_LOG_BACKUP = Check(_d7_measures, lambda given: [
    counted("D7.stale_log_backup", c("d_log_old"), "Last LOG backup too old on %d database(s)", "LOG backup age verified", c("d_log_due") > 0)])
NO_FULL_BACKUP = Check(lambda given: {NAMES: {"d_full_due": _sum("full_due"), "d_no_full": _due("full_rows", "full_null", "full_due")}},
                       lambda given: [counted("D9.no_full_backup", c("d_no_full"), "No FULL backup taken on %d database(s)", "FULL backups verified", c("d_full_due") > 0)])
NEVER = Check(lambda given: {CLEAN: {"k_never": F.count_if(F.col("last_clean") == F.lit(NEVER_CHECKED).cast("timestamp_ntz"))}},
              lambda given: [counted("D11.never_checked", c("k_never"), "No integrity check has been run on %d database(s)", "Integrity checks verified", c("k_never").isNotNull())])
STALE = Check(_d12_measures, lambda given: [
    ("D12.stale_integrity", F.lit("warn"), c("k_stale"), F.format_string("Most recent integrity check on %d database(s) is older than %d days",
                                                                         c("k_stale"), F.lit(given.get("check_days", 7))), c("k_stale") > 0)])
AG_HEALTH = Check(lambda given: {GROUPS: {"g_bad": F.count_if(F.lower("synchronization_health_desc") != "healthy")}},
                  lambda given: [counted("H2.ag_health", c("g_bad"), "%d availability group(s) not healthy", "Availability groups healthy", c("g_bad").isNotNull())])

ALL = [IDENTITY, CONFIGURATION, SETTINGS, OWNERS, TRACE, SERVICE_ACCOUNTS, MSDB_SIZE, FULL_RECOVERY, AV_MODULES, FILE_GROWTH, TEMPDB_COUNT,
       TEMPDB_UNIFORM, VLF, NO_LOG_BACKUP, OLD_LOG_BACKUP, NO_FULL_BACKUP, NEVER, STALE, AG_HEALTH]
