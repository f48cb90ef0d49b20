"""Family A — instance identity and version rules.

Version ladders are *data*: rule tables with (major, minor prefix, build
interval, exact version, priority). Each distinct version is matched to the
rules by an equi-join on the major version and the blocks of builds that
cover the interval (``plans.intervals``), prefix and exact version are a
residual, and the first rule by priority wins. The rules are the fixed ones
below, or a landed table of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tsql import money, version_name
from ..plans.intervals import interval_keys, point_keys
from ..plans.rules import run_checks
from ..plans.shape import dim, finding, kcols, kjoin
from . import checks as K

MAXB = 1 << 30  # open upper end of a build interval

RULE_SCHEMA = ("rule_set string, major string, minor_prefix string, lo long, hi long, "
               "exact_version string, priority int, outcome string, obsolete boolean, "
               "compat int, messages array<string>")

# The support ladder (latest service pack per release).
# (major, minor prefix, latest-SP build, latest-SP label, obsolete, compat level)
SUPPORT_LATEST_SP = [
    ("8", None, 2039, "8.0.2039.0", True, 80),
    ("9", None, 5000, "9.00.5000.00", True, 90),
    ("10", "0", 6000, "10.0.6000.29", True, 100),
    ("10", "4", 6000, "10.0.6000.29", True, 100),
    ("10", "5", 6000, "10.50.6000.34", True, 100),
    ("11", None, 7001, "11.0.7001.0", False, 110),
    ("12", None, 6024, "12.0.6024.0", False, 120),
    ("13", None, 5026, "13.0.5026.0", False, 130),
]
# Releases without service packs (major, RTM build, compat level).
SUPPORT_RTM = [("14", 1000, 140), ("15", 2000, 150)]

# Known-defect warnings.
LEAK = "Memory leak with AUTO_UPDATE_STATS_ASYNC; fixed in {}"
REBUILD = "Parallel online index rebuild can corrupt; fixed in {}"
AG_SYNC = "Availability group may report NOT SYNCHRONIZING; fixed in {}"
MSIEXEC = "msiexec keeps running after SP1 install (100% CPU); fixed in 2012 SP1 CU2"
TDE = "Backup compression on TDE databases can produce corrupt backups; fixed in {}"
# (major, minor, lo, hi, exact version, priority, warnings)
RISK_RULES = [
    ("10", "0", 0, 5827, None, 0, [LEAK.format("2008 SP3 CU8")]),
    ("10", "50", 0, 2867, None, 0, [LEAK.format("2008 R2 SP1 CU10")]),
    ("10", "50", 4000, 4269, None, 0, [LEAK.format("2008 R2 SP2 CU4")]),
    ("11", None, 5556, 5556, None, 0, [AG_SYNC.format("2012 SP2 CU5")]),
    ("11", None, 5569, 5569, None, 0, [AG_SYNC.format("2012 SP2 CU5")]),
    ("11", None, 5058, 5531, None, 1, [REBUILD.format("2012 SP2 CU1")]),
    ("11", None, 0, 3435, "11.0.3000.0", 0, [MSIEXEC, REBUILD.format("2012 SP1 CU11 or 2012 SP2 CU1")]),
    ("11", None, 0, 3435, "11.1.3000.0", 0, [MSIEXEC, REBUILD.format("2012 SP1 CU11 or 2012 SP2 CU1")]),
    ("11", None, 0, 2383, None, 1, [LEAK.format("2012 RTM CU5"), REBUILD.format("2012 SP1 CU11 or 2012 SP2 CU1")]),
    ("11", None, 2384, 3435, None, 1, [REBUILD.format("2012 SP1 CU11 or 2012 SP2 CU1")]),
    ("12", None, 2456, 2456, None, 0, [AG_SYNC.format("2014 RTM CU6")]),
    ("12", None, 0, 2369, None, 1, [REBUILD.format("2014 RTM CU2")]),
    ("13", None, 5026, 5152, None, 0, [TDE.format("2016 SP2 CU2")]),
    ("13", None, 0, 4501, None, 0, [TDE.format("2016 SP1 CU9")]),
    ("14", None, 0, 3029, None, 0, [TDE.format("2017 RTM CU9")]),
]

# Side-channel (Spectre/Meltdown) security updates.
# (major, minor prefix, lo, hi, priority, needed KB or None when patched)
PATCH_RULES = [
    ("10", "5", 6560, MAXB, 0, None), ("10", "5", 0, 6559, 0, "2008 R2 SP3 (KB 4057113)"),
    ("10", None, 6556, MAXB, 1, None), ("10", None, 0, 6555, 1, "2008 SP4 (KB 4057114)"),
    ("11", None, 7462, MAXB, 0, None), ("11", None, 6616, 7461, 0, "2012 SP4 (KB 4057116)"),
    ("11", None, 6615, 6615, 0, None), ("11", None, 6261, 6614, 0, "2012 SP3 CU (KB 4057121)"),
    ("11", None, 6260, 6260, 0, None), ("11", None, 0, 6259, 0, "2012 SP3 (KB 4057115)"),
    ("12", None, 5571, MAXB, 0, None), ("12", None, 5215, 5570, 0, "2014 SP2 CU10 (KB 4057117)"),
    ("12", None, 5214, 5214, 0, None), ("12", None, 0, 5213, 0, "2014 SP2 GDR (KB 4057120)"),
    ("13", None, 4466, MAXB, 0, None), ("13", None, 4211, 4465, 0, "2016 SP1 CU7 (KB 4057119)"),
    ("13", None, 4210, 4210, 0, None), ("13", None, 2219, 4209, 0, "2016 SP1 GDR (KB 4057118)"),
    ("13", None, 2218, 2218, 0, None), ("13", None, 1746, 2217, 0, "2016 RTM CU (KB 4058559)"),
    ("13", None, 1745, 1745, 0, None), ("13", None, 0, 1744, 0, "2016 RTM GDR (KB 4058560)"),
    ("14", None, 3015, MAXB, 0, None), ("14", None, 2001, 3014, 0, "2017 RTM CU3 (KB 4058562)"),
    ("14", None, 2000, 2000, 0, None), ("14", None, 0, 1999, 0, "2017 GDR (KB 4057122)"),
]


def support_rules():
    rows = []
    for major, minor, build, label, obsolete, compat in SUPPORT_LATEST_SP:
        rows.append(("support", major, minor, build, MAXB, None, 0, "latest_sp", obsolete, compat,
                     ["version is or surpasses the latest service pack"]))
        rows.append(("support", major, minor, 0, build - 1, None, 0, "not_latest_sp", obsolete, compat,
                     [f"version is not the latest service pack of {label}"]))
    for major, rtm, compat in SUPPORT_RTM:
        rows.append(("support", major, None, rtm, rtm, None, 0, "rtm", False, compat,
                     ["version is RTM and very likely not the latest CU"]))
        rows.append(("support", major, None, rtm + 1, MAXB, None, 0, "not_rtm", False, compat,
                     ["version is at least not RTM; verify it is the latest CU"]))
        rows.append(("support", major, None, 0, rtm - 1, None, 0, None, False, compat, []))
    return rows


def risk_rules():
    return [("risk", ma, mi, lo, hi, ex, pr, "warning", False, None, msgs)
            for ma, mi, lo, hi, ex, pr, msgs in RISK_RULES]


def patch_rules():
    return [("patch", ma, mi, lo, hi, None, pr, "needed" if kb else "patched", False, None,
             [f"security update needed: {kb}"] if kb else ["side-channel patch in place"])
            for ma, mi, lo, hi, pr, kb in PATCH_RULES]


def rule_table(spark: SparkSession, *rule_sets: str, rules: DataFrame | None = None) -> DataFrame:
    """The rules of the sets: the fixed ones, or those of a landed table
    (``RULE_SCHEMA``)."""
    if rules is not None:
        return rules.where(F.col("rule_set").isin(*rule_sets))
    fixed = {"support": support_rules, "risk": risk_rules, "patch": patch_rules}
    return dim(spark, [row for name in rule_sets for row in fixed[name]()], RULE_SCHEMA)


def decode_version(instances: DataFrame) -> DataFrame:
    """Add major / minor / build parts of ``product_version`` (NULL where it
    has no such part, or one that is no number)."""
    parts = F.split("product_version", r"\.")
    return instances.withColumns({
        "v_major": F.try_element_at(parts, F.lit(1)),
        "v_minor": F.try_element_at(parts, F.lit(2)),
        "v_build": F.try_element_at(parts, F.lit(-2)).try_cast("long"),
    })


def match_rules(instances: DataFrame, rules: DataFrame, keys=None, sets: tuple[str, ...] = ()) -> DataFrame:
    """First matching rule of each set per instance (by priority, then lower
    end; instances without a rule keep NULLs)."""
    k = kcols(keys)
    inst = instances.select(*k, "product_version").distinct()
    # Versions are few, however many servers there are.
    versions = decode_version(inst.select("product_version").distinct()).select(
        "product_version", "v_minor", F.col("v_major").alias("major"), F.explode(point_keys(F.col("v_build"))).alias("_builds"))
    ranged = rules.withColumn("_builds", F.explode(interval_keys(F.col("lo"), F.col("hi"))))
    matched = versions.join(ranged, ["major", "_builds"]).where(
        (F.col("minor_prefix").isNull() | F.col("v_minor").startswith(F.col("minor_prefix")))
        & (F.col("exact_version").isNull() | (F.col("product_version") == F.col("exact_version"))))
    best = matched.groupBy("product_version", "rule_set").agg(
        F.min_by(F.struct("outcome", "obsolete", "compat", "messages"), F.struct("priority", "lo", "hi", "outcome", "messages")).alias("m"))
    asked = inst.withColumn("rule_set", F.explode(F.array(*[F.lit(x) for x in sets])))
    return asked.join(best, ["product_version", "rule_set"], "left").select(*k, "product_version", "rule_set", "m.*")


def physical_memory_gb(instances: DataFrame) -> F.Column:
    """Physical memory in GB, decimal(15,2): ``physical_memory_kb`` (2012 on),
    else ``physical_memory_in_bytes`` (2008) when landed."""
    kb = F.col("physical_memory_kb").cast("double")
    if "physical_memory_in_bytes" in instances.columns:
        kb = F.coalesce(kb, F.col("physical_memory_in_bytes").cast("double") / 1024)
    return (kb / 1024 / 1024).cast("decimal(15,2)")


def instance_identity(instances: DataFrame, keys=None) -> DataFrame:
    """A1: one row per server with version name, sockets (integer
    cpu/hyperthread ratio) and physical memory in GB."""
    return instances.select(
        *kcols(keys), "machine_name", F.coalesce("instance_name", F.lit("<default>")).alias("instance_name"),
        "edition", "product_version", version_name("product_version").alias("version_name"),
        "product_level", "collation", "is_clustered", "is_hadr_enabled", "virtual_machine_type",
        "cpu_count", "hyperthread_ratio",
        F.call_function("div", F.col("cpu_count"), F.col("hyperthread_ratio")).alias("sockets"),
        physical_memory_gb(instances).alias("physical_memory_gb"))


def version_names(instances: DataFrame, keys=None) -> DataFrame:
    """A2: product version -> release name (NULL when unknown)."""
    return instances.select(*kcols(keys), "product_version",
                            version_name("product_version").alias("version_name"))


def cpu_visibility(instances: DataFrame, schedulers: DataFrame, keys=None) -> DataFrame:
    """A3: OS CPUs against schedulers that are VISIBLE ONLINE (aggregate, then
    an equi-join on the fleet key — no cross join)."""
    k = kcols(keys)
    vis = schedulers.filter(F.lower("status") == "visible online").groupBy(*k) \
        .agg(F.count("cpu_id").alias("visible_cpu_count"))
    return kjoin(instances.select(*k, "cpu_count"), vis, k, "inner")


def _max_mem(config: DataFrame, keys) -> DataFrame:
    k = kcols(keys)
    return config.groupBy(*k).agg(
        F.max(F.when(F.col("name") == "max server memory (MB)", F.col("value_in_use"))).alias("max_mem_mb"),
        F.max(F.when(F.col("name") == "min server memory (MB)", F.col("value_in_use"))).alias("min_mem_mb"))


def identity_checks(instances: DataFrame, schedulers: DataFrame, config: DataFrame,
                    keys=None) -> DataFrame:
    """A4: server name differs from machine name; OS CPUs differ from visible
    schedulers; SQL max memory above physical memory (unless unlimited)."""
    return run_checks([K.IDENTITY], {"instances": instances, "schedulers": schedulers, "config": config}, keys)


def support_level(spark: SparkSession, instances: DataFrame, keys=None, rules: DataFrame | None = None) -> DataFrame:
    """A5: support verdict, obsolete flag and instance compatibility level."""
    m = match_rules(instances, rule_table(spark, "support", rules=rules), keys, ("support",))
    return m.select(*kcols(keys), "product_version", F.col("outcome").alias("support_status"),
                    F.coalesce("obsolete", F.lit(False)).alias("obsolete"),
                    F.col("compat").alias("instance_compat_level"),
                    F.try_element_at("messages", F.lit(1)).alias("message"))


def risky_build(spark: SparkSession, instances: DataFrame, keys=None, rules: DataFrame | None = None) -> DataFrame:
    """Known-defect warnings for the build, one row per warning; builds
    without a warning keep one row with NULL message."""
    m = match_rules(instances, rule_table(spark, "risk", rules=rules), keys, ("risk",))
    return m.select(*kcols(keys), "product_version",
                    F.explode_outer("messages").alias("message"))


def side_channel_patch(spark: SparkSession, instances: DataFrame, keys=None, rules: DataFrame | None = None) -> DataFrame:
    """Whether the side-channel security update is in place, else which."""
    m = match_rules(instances, rule_table(spark, "patch", rules=rules), keys, ("patch",))
    return m.select(*kcols(keys), "product_version", F.col("outcome").alias("patch_status"),
                    F.try_element_at("messages", F.lit(1)).alias("message"))


def version_findings(spark: SparkSession, instances: DataFrame, keys=None, rules: DataFrame | None = None) -> DataFrame:
    """A5-A7 as findings: support level, known defects of the build (one row
    each, or one 'ok' row), side-channel update."""
    sets = ("support", "risk", "patch")
    m = match_rules(instances, rule_table(spark, *sets, rules=rules), keys, sets)
    # One row per warning of a risky build; the other sets have one message at most that counts.
    risk, support = F.col("rule_set") == "risk", F.col("rule_set") == "support"
    m = m.withColumn("message", F.explode_outer(F.when(risk, F.col("messages")).otherwise(F.slice("messages", 1, 1))))
    behind = F.coalesce("obsolete", F.lit(False)) | F.coalesce(F.col("outcome").isin("not_latest_sp", "not_rtm", "rtm"), F.lit(True))
    return m.select(
        *kcols(keys), F.when(support, "A5.support_level").when(risk, "A6.risky_build").otherwise("A7.side_channel").alias("check_id"),
        F.when(support, F.when(behind, "warn").otherwise("ok")).when(risk, F.when(F.col("message").isNotNull(), "warn").otherwise("ok"))
        .otherwise("info").alias("severity"),
        F.when(support | risk, F.col("product_version")).otherwise(F.col("outcome")).alias("observed"),
        F.coalesce("message", F.when(support, "version is not in the support table").when(risk, "no known defect for this build")
                   .otherwise("no side-channel rule for this version")).alias("message"))


def memory_settings(config: DataFrame, keys=None) -> DataFrame:
    """Max / min server memory in GB, comma formatted."""
    m = _max_mem(config, keys)
    return m.select(*kcols(keys), "max_mem_mb", "min_mem_mb",
                    money(F.col("max_mem_mb") / 1024.0).alias("max_mem_gb_text"),
                    money(F.col("min_mem_mb") / 1024.0).alias("min_mem_gb_text"))
