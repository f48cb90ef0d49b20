"""End-to-end reports: every check operator's findings
in one table — the health check's message channel as rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.gates import gate_table, open_gates
from ..plans.rules import run_checks
from ..sources.loader import load_fleet
from ..sources.results import replace_results

from . import checks as K, instance as A, wait as W


def gated_findings(spark: SparkSession, t: dict[str, DataFrame], as_of, gates: DataFrame | None = None, options=(), keys=None) -> DataFrame:
    """``health_check_findings`` without the checks that are closed on a
    server's platform or version (``plans.gates``)."""
    return open_gates(health_check_findings(spark, t, as_of, keys), t["instances"], gate_table(spark) if gates is None else gates, options, keys)


def health_check_findings(spark: SparkSession, t: dict[str, DataFrame], as_of, keys=None) -> DataFrame:
    """All finding-shaped checks (keys, check_id, severity, observed,
    message). ``t`` maps relation names to landed DataFrames. The rules of
    ``checks`` run together: one aggregate per source; version rules and top
    waits are joins and ranks of their own."""
    return run_checks(K.ALL, t, keys, as_of=as_of) \
        .unionByName(A.version_findings(spark, t["instances"], keys)) \
        .unionByName(W.top_wait_findings(spark, t["wait_stats"], keys))


HEALTH_CHECK_INPUTS = ["instances", "schedulers", "config", "databases", "jobs", "packages", "trace_flags",
                       "services", "master_files", "modules", "log_info", "backupset", "dbinfo",
                       "availability_groups", "wait_stats"]


def run_health_check(spark: SparkSession, landing_root: str, as_of, out_path: str | None = None,
                     fmt: str = "parquet") -> DataFrame:
    """Production entry: read the landed views under ``landing_root``, build
    the findings, and (optionally) make them the results of that day for all
    servers read, in the result table ``out_path`` (R7, ``sources.results``)."""
    t = load_fleet(spark, landing_root, HEALTH_CHECK_INPUTS, fmt=fmt)
    findings = gated_findings(spark, t, as_of)
    if out_path:
        _publish(findings, t["instances"], F.lit(as_of).cast("timestamp"), out_path)
    return findings


def _publish(rows: DataFrame, instances: DataFrame, ts, out_path: str) -> None:
    """The day's results of every landed server, those without rows too."""
    covered = instances.select(F.to_date(ts).alias("snapshot_date"), "server_name").distinct()
    replace_results(rows.withColumn("snapshot_ts", ts), out_path, covered)


DISCOVERY_INPUTS = ["instances", "databases", "master_files", "jobs", "trace_flags", "server_principals",
                    "sku_features", "services", "certificates", "replica_states", "schedulers", "server_objects",
                    "encryption_keys", "availability_groups", "objects", "schemas"]


def run_discovery_report(spark: SparkSession, landing_root: str, out_path: str | None = None,
                         as_of=None, fmt: str = "parquet") -> DataFrame:
    """Production entry: landed views -> discovery
    metrics -> ordered report lines; optionally the day's results in
    ``out_path``."""
    from .discovery import discovery_metrics, report_lines
    t = load_fleet(spark, landing_root, DISCOVERY_INPUTS, fmt=fmt)
    lines = report_lines(spark, discovery_metrics(*[t[n] for n in DISCOVERY_INPUTS]))
    if out_path:
        ts = F.lit(as_of or str(datetime.datetime.now())).cast("timestamp")
        _publish(lines, t["instances"], ts, out_path)
    return lines


def access_audit(spark: SparkSession, t: dict[str, DataFrame], as_of, password: str | None = None,
                 keys=None) -> DataFrame:
    """SURVEY 3, entry 3: every permission-script section (J1-J14) in one
    table (keys, database_name, section, severity, principal_name,
    object_name, statement, seq). All sections are numbered together, in one
    pass. Generated text is never executed."""
    from . import security as S
    pw = password or S.PASSWORD_PLACEHOLDER
    pr, lg = t["principals"], t["logins"]
    own = {"keys": keys, "draft": True}
    parts = [
        S.none_found(S.database_universe(pr, keys), keys, list(S.NONE_FOUND)),
        S.script_certificates(t["certificates"], pw, **own),
        S.script_users(pr, lg, **own),
        S.script_certificate_users(pr, t["certificates"], **own),
        S.script_schema_permissions(t["permissions"], t["schemas"], pr, **own),
        S.script_roles(pr, **own),
        S.script_app_roles(pr, pw, **own),
        S.script_nested_roles(pr, t["role_members"], **own),
        S.script_database_grants(t["permissions"], pr, **own),
        S.script_object_grants(t["permissions"], pr, t["objects"], t["schemas"], **own),
        S.script_role_members(pr, t["role_members"], **own),
        S.script_user_header(pr, lg, as_of, **own),
        S.script_user_roles(pr, lg, t["role_members"], **own),
        S.script_user_object_permissions(spark, t["protects"], t["objects"], t["schemas"], pr, lg, **own),
        S.orphan_users(pr, t["server_principals"], t["databases"], t["instances"], **own),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return S.in_order(out, keys)
