"""Family K — discovery report.

K1 aggregates each source table once per server, unpivots each aggregate
to long ``(fleet key, metric, value)`` rows and unions them with per-server
defaults; one shuffle picks the value. K4 renders report lines by
joining the metrics to a small, broadcast line-template table.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tsql import version_name
from ..plans.notin import not_in
from ..plans.shape import dim, kcols, kjoin
from .backup import is_system_db
from .instance import physical_memory_gb

# Service names that mean SSIS / SSAS / SSRS are installed.
SSIS_PREFIX, SSAS_PREFIX, SSRS_NAMES = "MsDtsServer", "MSSQLServerOLAPService", ["ReportServer", "SQLServerReportingServices"]
# Beginnings of Windows login names that the count leaves out (compared without case).
WIN_LOGIN_EXCLUDE = ["##ms_", "nt service\\", "nt authority\\"]
PAGES_TO_MB = Decimal("0.0078125")            # 1 / 128
PAGES_TO_GB = Decimal("0.00000762939453125")  # 1 / 128 / 1024


def _yes_no(c):
    return F.when(c, "Yes").otherwise("NO")


def _features_in_use(sku_features: DataFrame, keys) -> DataFrame:
    k = kcols(keys)
    return sku_features.select(*k, "feature_name").distinct().groupBy(*k).agg(
        F.array_join(F.array_sort(F.collect_list("feature_name")), ", ").alias("edition_features"))


def edition_features(sku_features: DataFrame, servers: DataFrame, keys=None) -> DataFrame:
    """K2: distinct edition-specific feature names in use per server, joined
    by ', ' in name order; '0' when none."""
    k = kcols(keys)
    f = _features_in_use(sku_features, keys)
    return kjoin(servers.select(*k).distinct(), f, k, "left") \
        .select(*k, F.coalesce("edition_features", F.lit("0")).alias("edition_features"))


def space_used(files: DataFrame, databases: DataFrame, keys=None) -> DataFrame:
    """K3: per database data/log file size (MB), space used (GB, although the
    source labels it MB) and free space (MB), as decimal(20,2)."""
    k = kcols(keys)

    per_db = files.groupBy(*k, "database_id").agg(*_file_sums()).where("n_data > 0")
    d = databases.select(*k, "database_id", F.col("name").alias("database_name"), "state_desc", "recovery_model_desc")
    return d.join(per_db, k + ["database_id"], "inner").select(
        *k, "database_name", "state_desc", "recovery_model_desc",
        *[c for kind in ("data", "log") for c in (
            _pages(f"{kind}_size", PAGES_TO_MB).alias(f"{kind}_size_mb"), _pages(f"{kind}_used", PAGES_TO_GB).alias(f"{kind}_used_gb"),
            _pages(F.col(f"{kind}_size") - F.col(f"{kind}_used"), PAGES_TO_MB).alias(f"{kind}_free_mb"))])


def _file_sums() -> list:
    """Sizes and used space of a database's data and log files, in pages
    (NULL where it has none of the kind)."""
    return [F.count_if(F.col("type") == 0).alias("n_data"),
            *[F.sum(F.when(F.col("type") == t, F.col(column))).alias(f"{kind}_{name}")
              for kind, t in (("data", 0), ("log", 1)) for name, column in (("size", "size"), ("used", "space_used"))]]


def _pages(pages, unit: Decimal):
    return ((F.col(pages) if isinstance(pages, str) else pages).cast("decimal(20,0)") * F.lit(unit)).cast("decimal(20,2)")


def _databases_and_files(databases: DataFrame, files: DataFrame, keys) -> DataFrame:
    """One row per database id: its catalog columns and the sums of its
    files. Both are summed by id together, each read once, without a join."""
    k = kcols(keys)
    flags = ["name", "state_desc", "recovery_model_desc", "is_cdc_enabled", "is_broker_enabled", "source_database_id", "is_published", "is_subscribed",
             "is_merge_published", "is_distributor"]
    d = databases.select(*k, F.col("database_id").cast("long").alias("database_id"), *flags, F.lit(True).alias("in_catalog"),
                         *[F.lit(None).cast(t).alias(n) for n, t in (("type", "int"), ("size", "long"), ("space_used", "long"))])
    f = files.select(*k, F.col("database_id").cast("long").alias("database_id"), *[F.lit(None).cast(d.schema[n].dataType).alias(n) for n in flags],
                     F.lit(None).cast("boolean").alias("in_catalog"), F.col("type").cast("int").alias("type"),
                     F.col("size").cast("long").alias("size"), F.col("space_used").cast("long").alias("space_used"))
    return d.union(f).groupBy(*k, "database_id").agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in (*flags, "in_catalog")], *_file_sums(), F.sum("size").alias("all_size"))


# Extended-event sessions that ship with the server.
BUILTIN_EVENT_SESSIONS = ["system_health", "AlwaysOn_health", "telemetry_xevents"]


def server_object_counts(server_objects: DataFrame, keys=None) -> DataFrame:
    """Counts over the landed server-level catalogs (one table, one row per
    object with its ``object_class``): linked servers, triggers, startup
    procedures and trace flags, mail, agent alerts / operators / proxies,
    maintenance plans, audits, credentials, backup devices, endpoints, user
    event sessions, user policies and conditions, keys, log shipping,
    mirroring. One aggregate pass."""
    k = kcols(keys)
    c, n = F.col("object_class"), F.col("name")

    def cnt(cls, cond=None):
        t = c == cls
        return F.count_if(t if cond is None else (t & cond))
    return server_objects.groupBy(*k).agg(
        cnt("linked_server", ~F.col("is_remote")).alias("linked_servers"),
        cnt("server_trigger").alias("server_triggers"),
        cnt("procedure", F.col("is_auto_executed")).alias("startup_procs"),
        cnt("startup_parameter", F.col("value").like("-T%")).alias("startup_trace_flags"),
        cnt("mail_profile").alias("mail_profiles"), cnt("mail_account").alias("mail_accounts"),
        cnt("agent_alert").alias("agent_alerts"), cnt("agent_operator").alias("agent_operators"),
        cnt("agent_proxy").alias("agent_proxies"), cnt("maintenance_plan").alias("maintenance_plans"),
        cnt("server_audit").alias("server_audits"), cnt("credential").alias("credentials"),
        cnt("backup_device").alias("backup_devices"),
        cnt("endpoint", F.col("object_id") > 5).alias("endpoints"),
        cnt("event_session", ~n.isin(BUILTIN_EVENT_SESSIONS)).alias("event_sessions"),
        cnt("policy", ~F.col("is_system")).alias("user_policies"),
        cnt("condition", ~F.col("is_system")).alias("user_conditions"),
        cnt("symmetric_key", n.like("##MS_DatabaseMasterKey##")).alias("_master_key"),
        cnt("asymmetric_key", ~n.like("MS_SQLEnableSystemAssemblyLoadingKey")).alias("asymmetric_keys"),
        cnt("log_shipping_primary", n.isNotNull()).alias("log_shipping_primary"),
        cnt("log_shipping_secondary", n.isNotNull()).alias("log_shipping_secondary"),
        cnt("mirroring", F.col("mirroring_guid").isNotNull()).alias("mirrored_dbs"))


def tde_databases(encryption_keys: DataFrame, certificates: DataFrame, keys=None) -> DataFrame:
    """M9: database encryption keys protected by a certificate (thumbprint
    match) that are encrypted (state 3), per server."""
    k = kcols(keys)
    cert = certificates.select(*k, F.col("thumbprint").alias("encryptor_thumbprint"))
    return encryption_keys.filter(F.col("encryption_state") == 3) \
        .join(cert, k + ["encryptor_thumbprint"], "inner").groupBy(*k).agg(F.count(F.lit(1)).alias("tde_databases"))


def subscribed_databases(databases: DataFrame, groups: DataFrame, replica_states: DataFrame,
                         keys=None) -> DataFrame:
    """Online databases holding replication objects, except databases
    of availability groups whose primary replica is another server."""
    k = kcols(keys)
    names = databases.select(*k, "database_id", F.col("name").alias("database_name"))
    ag_dbs = replica_states.select(*k, "group_id", "database_id") \
        .join(groups.filter(F.col("primary_replica") != F.col("server_name")).select(*k, "group_id"),
              k + ["group_id"], "inner").join(names, k + ["database_id"], "inner").select(*k, "database_name")
    d = databases.filter(F.lower("state_desc") == "online").select(
        *k, F.col("name").alias("database_name"), "has_replication_objects")
    return not_in(d, "database_name", ag_dbs, "database_name", k).groupBy(*k).agg(
        F.count_if(F.col("has_replication_objects")).alias("subscribed_dbs"))


def user_object_counts(objects: DataFrame, schemas: DataFrame, keys=None) -> DataFrame:
    """M43-45: per database, user objects: not in schema ``sys`` (nor
    ``MS_PerfDashboard`` in msdb), not shipped, and whose parent is not a
    system object (NOT IN: an object without a parent id does not count
    unless its database has no system object at all)."""
    k = kcols(keys)
    d = k + ["database_name"]
    o = objects.join(schemas.select(*d, "schema_id", F.col("name").alias("schema_name")), d + ["schema_id"], "left")
    sys_ids = o.filter((F.col("schema_name") == "sys") | F.col("is_ms_shipped")) \
        .select(*d, "object_id")
    excluded = F.when(F.lower("database_name") == "msdb", F.array(F.lit("sys"), F.lit("MS_PerfDashboard"))) \
        .otherwise(F.array(F.lit("sys")))
    user = o.filter(~F.coalesce(F.array_contains(excluded, F.col("schema_name")), F.lit(False))
                    & F.col("schema_name").isNotNull() & ~F.col("is_ms_shipped"))
    return not_in(user, "parent_object_id", sys_ids, "object_id", d).groupBy(*d).agg(F.count(F.lit(1)).alias("user_objects"))


def _count(df: DataFrame, keys, name: str, cond=None) -> DataFrame:
    k = kcols(keys)
    c = F.count(F.lit(1)) if cond is None else F.count_if(cond)
    return df.groupBy(*k).agg(c.alias(name))


COUNT_METRICS = [
    "user_dbs_online", "user_dbs_not_online", "user_dbs_not_full", "cdc_dbs", "broker_enabled_dbs",
    "database_snapshots", "published_dbs", "distributor_dbs", "tempdb_data_files", "total_jobs", "enabled_jobs",
    "global_trace_flags", "sql_logins", "windows_logins", "server_roles", "certificates", "ag_databases",
    "linked_servers", "server_triggers", "startup_procs", "startup_trace_flags", "mail_profiles", "mail_accounts",
    "agent_alerts", "agent_operators", "agent_proxies", "maintenance_plans", "server_audits", "credentials",
    "backup_devices", "endpoints", "event_sessions", "user_policies", "user_conditions", "_master_key",
    "asymmetric_keys", "log_shipping_primary", "log_shipping_secondary", "mirrored_dbs", "tde_databases",
    "subscribed_dbs", "user_objects_master", "user_objects_msdb", "user_objects_model"]
# M43-45: system databases whose user objects are counted.
OBJECT_DBS = ["master", "msdb", "model"]


def discovery_metrics(instances: DataFrame, databases: DataFrame, files: DataFrame, jobs: DataFrame,
                      flags: DataFrame, server_principals: DataFrame, sku_features: DataFrame, services: DataFrame,
                      certificates: DataFrame, replica_states: DataFrame, schedulers: DataFrame,
                      server_objects: DataFrame, encryption_keys: DataFrame, groups: DataFrame,
                      objects: DataFrame, schemas: DataFrame, keys=None) -> DataFrame:
    """K1: long table (fleet key, metric, value) of the discovery metrics.

    Each source table is aggregated once per server and unpivoted to long
    rows; a default row per (server, metric) gives 0 / 'NO' / NULL where a
    catalog has no rows for the server. One union and one shuffle by
    (server, metric) pick the source value over the default — no chain of
    joins between the per-source aggregates."""
    k = kcols(keys)
    i = instances
    uid = F.col("database_id") > 4
    online = F.lower("state_desc") == "online"
    parts = []

    def add(df: DataFrame):
        # One SQL expression per part keeps plan construction cheap.
        cols = [c for c in df.columns if c not in k]
        pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in cols)
        parts.append(df.selectExpr(*k, f"stack({len(cols)}, {pairs}) as (metric, value)", "1 as _p"))

    add(i.select(
        *k, "machine_name", F.coalesce("instance_name", F.lit("<default>")).alias("instance_name"), "edition",
        "product_version", version_name("product_version").alias("version_name"), "product_level", "collation",
        physical_memory_gb(i).alias("total_memory_gb"),
        F.col("sqlserver_start_time").alias("last_restart"), "is_clustered", "is_hadr_enabled", "time_zone",
        "default_data_path", "default_log_path",
        F.when(F.col("is_resource_governor_enabled"), "Yes").otherwise("No").alias("resource_governor")))
    vis = schedulers.filter(F.lower("status") == "visible online").select(*k)
    add(kjoin(i.select(*k, F.col("cpu_count").alias("os_cpus")), vis, k, "left_semi"))
    here, user_files = F.col("in_catalog"), F.col("in_catalog") & (F.col("n_data") > 0) & ~is_system_db("name")
    count = lambda cond: F.count_if(here & cond)
    add(_databases_and_files(databases, files, keys).groupBy(*k).agg(
        count(uid & online).alias("user_dbs_online"),
        count(uid & ~online).alias("user_dbs_not_online"),
        count(uid & (F.lower("recovery_model_desc") != "full")).alias("user_dbs_not_full"),
        count(F.col("is_cdc_enabled")).alias("cdc_dbs"),
        count(F.col("is_broker_enabled") & uid).alias("broker_enabled_dbs"),
        count(F.col("source_database_id").isNotNull()).alias("database_snapshots"),
        count(F.col("is_published")).alias("published_dbs"),
        count(F.col("is_distributor")).alias("distributor_dbs"),
        _yes_no(count((F.col("is_published") | F.col("is_subscribed") | F.col("is_merge_published") | F.col("is_distributor")) & online) > 0)
        .alias("replication_configured"),
        _yes_no(count(F.lower("name") == "ssisdb") > 0).alias("ssisdb_catalog"),
        F.sum(F.when(F.col("database_id") == 2, F.col("n_data")).otherwise(F.lit(0).cast("long"))).alias("tempdb_data_files"),
        (F.sum(F.when(uid, F.col("all_size"))).cast("decimal(20,0)") * F.lit(PAGES_TO_GB)).cast("decimal(10,2)").alias("total_gb_user_files"),
        F.sum(F.when(user_files, _pages("data_used", PAGES_TO_GB))).alias("data_used_gb"),
        F.sum(F.when(user_files, _pages("log_used", PAGES_TO_GB))).alias("log_used_gb")))
    add(jobs.groupBy(*k).agg(F.count(F.lit(1)).alias("total_jobs"),
                             F.count_if(F.col("enabled") == 1).alias("enabled_jobs")))
    add(_count(flags, keys, "global_trace_flags", F.col("is_global")))
    n = F.col("name")
    win_ok = None
    for p in WIN_LOGIN_EXCLUDE:
        c = ~F.lower(n).startswith(p)
        win_ok = c if win_ok is None else win_ok & c
    add(server_principals.groupBy(*k).agg(
        F.count_if((F.col("type") == "S") & ~F.lower(n).startswith("##ms_")).alias("sql_logins"),
        F.count_if(F.col("type").isin("U", "G") & win_ok).alias("windows_logins"),
        F.count_if((F.col("type") == "R") & (F.col("principal_id") > 10)).alias("server_roles")))
    add(_features_in_use(sku_features, keys))  # servers without features get the '0' default
    sv = F.col("servicename")
    add(services.groupBy(*k).agg(
        _yes_no(F.max(sv.startswith(SSIS_PREFIX).cast("int")) > 0).alias("ssis_installed"),
        _yes_no(F.max(sv.startswith(SSAS_PREFIX).cast("int")) > 0).alias("ssas_installed"),
        _yes_no(F.max(sv.isin(SSRS_NAMES).cast("int")) > 0).alias("ssrs_installed")))
    add(_count(certificates, keys, "certificates", F.col("certificate_id") > 257))
    add(replica_states.groupBy(*k).agg(F.countDistinct("database_id").alias("ag_databases")))
    so = server_object_counts(server_objects, keys)
    add(so.select(*k, *[c for c in so.columns if c not in k and c != "_master_key"],
                  _yes_no(F.col("mirrored_dbs") > 0).alias("mirroring_configured"),
                  _yes_no((F.col("log_shipping_primary") > 0) | (F.col("log_shipping_secondary") > 0))
                  .alias("log_shipping_configured"),
                  F.when(F.col("_master_key") > 0, "Configured").otherwise("Not configured").alias("master_key")))
    add(tde_databases(encryption_keys, certificates, keys))
    add(subscribed_databases(databases, groups, replica_states, keys))
    uo = user_object_counts(objects, schemas, keys)
    add(uo.groupBy(*k).agg(*[F.sum(F.when(F.lower("database_name") == d, F.col("user_objects"))).alias(f"user_objects_{d}")
                             for d in OBJECT_DBS]))
    # Defaults: every server gets every metric.
    defaults = [(m, "0") for m in COUNT_METRICS if m != "_master_key"] + \
        [(m, "NO") for m in YES_NO_METRICS] + [("master_key", "Not configured"), ("edition_features", "0")] + \
        [(m, None) for m in NULLABLE_METRICS]
    rows = ", ".join(f"'{m}', " + ("cast(null as string)" if v is None else f"'{v}'") for m, v in defaults)
    parts.append(i.select(*k).distinct().selectExpr(*k, f"stack({len(defaults)}, {rows}) as (metric, value)",
                                                    "0 as _p"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    # A source row whose value is NULL leaves the default.
    return u.groupBy(*k, "metric").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("_p"))).alias("value"))


YES_NO_METRICS = ["replication_configured", "ssisdb_catalog", "ssis_installed", "ssas_installed", "ssrs_installed",
                  "mirroring_configured", "log_shipping_configured"]
NULLABLE_METRICS = ["machine_name", "instance_name", "edition", "product_version", "version_name", "product_level",
                    "collation", "total_memory_gb", "last_restart", "is_clustered", "is_hadr_enabled", "time_zone",
                    "default_data_path", "default_log_path", "resource_governor", "os_cpus", "total_gb_user_files",
                    "data_used_gb", "log_used_gb"]


# Fixed layout of the report: (line, section, label, metric, show rule).
# show rule: None = always, 'gt0' = only when the value is above 0,
# 'features' = only when edition-specific features are in use.
REPORT_TEMPLATE = [
    (1, "server", "Machine name", "machine_name", None),
    (2, "server", "Instance name", "instance_name", None),
    (3, "server", "Edition", "edition", None),
    (4, "server", "Version", "product_version", None),
    (5, "server", "Version name", "version_name", None),
    (6, "server", "Collation", "collation", None),
    (7, "server", "OS CPUs", "os_cpus", None),
    (8, "server", "Total Server Memory in GB", "total_memory_gb", None),
    (9, "server", "is SSRS Installed", "ssrs_installed", None),
    (10, "server", "is SSAS Installed", "ssas_installed", None),
    (11, "server", "is SSIS Installed", "ssis_installed", None),
    (12, "server", "SSISDB Catalog Configured", "ssisdb_catalog", None),
    (20, "ha_dr", "Is Clustered", "is_clustered", None),
    (21, "ha_dr", "Is AlwaysOn Enabled", "is_hadr_enabled", None),
    (22, "ha_dr", "AOAG Configured DBs", "ag_databases", "gt0"),
    (23, "ha_dr", "Is replication Configured", "replication_configured", None),
    (24, "ha_dr", "Published DBs", "published_dbs", "gt0"),
    (25, "ha_dr", "Distributor Configured DBs", "distributor_dbs", "gt0"),
    (26, "ha_dr", "Subscribed DBs", "subscribed_dbs", "gt0"),
    (27, "ha_dr", "Is Mirroring Configured", "mirroring_configured", None),
    (28, "ha_dr", "Mirror Configured DBs", "mirrored_dbs", "gt0"),
    (29, "ha_dr", "Is Logshipping Configured", "log_shipping_configured", None),
    (30, "database", "Default Datafile Location", "default_data_path", None),
    (31, "database", "Default Logfile Location", "default_log_path", None),
    (32, "database", "TempDB datafiles", "tempdb_data_files", None),
    (33, "database", "User dbs (online)", "user_dbs_online", None),
    (34, "database", "User dbs (NOT online)", "user_dbs_not_online", None),
    (35, "database", "User dbs NOT using FULL RECOVERY", "user_dbs_not_full", None),
    (36, "database", "Broker_enabled Dbs", "broker_enabled_dbs", None),
    (37, "database", "Database Snapshots", "database_snapshots", None),
    (38, "database", "DBs using CDC", "cdc_dbs", "gt0"),
    (39, "database", "Edition-specific features in use", "edition_features", None),
    (40, "database", "Certificates", "certificates", "gt0"),
    (44, "database", "TDE Enabled Databases", "tde_databases", "features"),
    (45, "database", "MS_DatabaseMasterKey", "master_key", None),
    (46, "database", "asymmetric_keys", "asymmetric_keys", "gt0"),
    (41, "database", "Total size in GBs (all user DBs, all states)", "total_gb_user_files", None),
    (42, "database", "Total space used in GB for Datafiles", "data_used_gb", None),
    (43, "database", "Total space used in GB for Logfiles", "log_used_gb", None),
    (50, "agent_login", "SQL logins", "sql_logins", None),
    (51, "agent_login", "Windows logins/groups", "windows_logins", None),
    (52, "agent_login", "Server roles (user created)", "server_roles", None),
    (53, "agent_login", "Total Agent Jobs", "total_jobs", None),
    (54, "agent_login", "Enabled Jobs", "enabled_jobs", None),
    (55, "agent_login", "Maintenance Plans", "maintenance_plans", None),
    (56, "agent_login", "Agent Alerts", "agent_alerts", None),
    (57, "agent_login", "Agent Operators", "agent_operators", None),
    (58, "agent_login", "Agent Proxies", "agent_proxies", None),
    (59, "server_objects", "Linked Servers", "linked_servers", None),
    (60, "server_objects", "Global Trace Flags", "global_trace_flags", None),
    (64, "server_objects", "Server-side triggers", "server_triggers", None),
    (65, "server_objects", "Startup Procs", "startup_procs", None),
    (66, "server_objects", "Startup Trace Flags", "startup_trace_flags", None),
    (67, "server_objects", "DBMail Profiles", "mail_profiles", None),
    (68, "server_objects", "DBMail Accts", "mail_accounts", None),
    (69, "server_objects", "Server Audits", "server_audits", None),
    (70, "server_objects", "Server Credentials", "credentials", None),
    (71, "server_objects", "Backup Devices", "backup_devices", None),
    (72, "server_objects", "Endpoints", "endpoints", None),
    (73, "server_objects", "Extended Events (user created)", "event_sessions", None),
    (74, "server_objects", "User policies", "user_policies", None),
    (75, "server_objects", "User conditions", "user_conditions", None),
    (76, "server_objects", "User objects in master", "user_objects_master", "gt0"),
    (77, "server_objects", "User objects in msdb", "user_objects_msdb", "gt0"),
    (78, "server_objects", "User objects in model", "user_objects_model", "gt0"),
    (61, "server_objects", "User Define Resource Governor", "resource_governor", None),
    (62, "server_objects", "Time zone", "time_zone", None),
    (63, "server_objects", "Last SQL Server restart", "last_restart", None),
]


def report_lines(spark: SparkSession, metrics: DataFrame, keys=None) -> DataFrame:
    """K4: ordered 'label = value' lines per server, conditional lines only
    when their rule holds."""
    k = kcols(keys)
    t = dim(spark, REPORT_TEMPLATE, "line_no int, section string, label string, metric string, show_if string")
    # Per-server flag from the same rows (a window over ~70 metrics of one
    # server), instead of re-deriving the metrics for a self-join.
    feats = F.max(F.when(F.col("metric") == "edition_features", F.col("value") != "0")).over(Window.partitionBy(*k))
    j = metrics.withColumn("_features", feats).join(t, "metric", "inner")
    v = F.col("value")
    keep = (F.col("show_if").isNull()
            | ((F.col("show_if") == "gt0") & (F.coalesce(v.try_cast("double"), F.lit(0.0)) > 0))
            | ((F.col("show_if") == "features") & F.coalesce(F.col("_features"), F.lit(False))))
    return j.filter(keep).select(*k, "line_no", "section",
                                 F.concat(F.col("label"), F.lit(" = "), F.coalesce(v, F.lit("N/A"))).alias("line"))
