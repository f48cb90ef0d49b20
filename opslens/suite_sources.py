"""Cases of the sources and sinks (R1-R7): each lands a relation as collectors
do, in the shared folder, and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import backup as D, database as B, ha as H, instance as A, job as I, report as RP, storage as C
from .plans.gates import GATE, gate_table, open_gates
from .plans.shape import SNAP
from .plans.stored import new_folder
from .sources import database_output as O, results as R, rollover as V, snapshots as N
from .sources.schemas import SCHEMAS
from .suite import CASES, case, rel

K = "server_name, snapshot_id"

# Three snapshots land each server's databases; the register lacks a view of some.
_LANDED = f"""landed as (select * replace (cast(snapshot_id + 2 * k as integer) as snapshot_id) from databases, (select unnest(range(3)) as k)),
heads as (select distinct {K} from landed),
register as (select {K}, timestamp '2001-07-01 00:00:00' + interval (snapshot_id) day as snapshot_ts, v as view_name
  from heads, (select unnest(['databases', 'master_files']) as v)
  where not (v = 'master_files' and (ascii(substr(server_name, 4, 1)) + snapshot_id) % 3 = 0))"""


def _landed(spark, d):
    """(folder, register) of the databases relation in six snapshots a server."""
    root = new_folder(spark)
    rows = rel(spark, d, "databases").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(2)))) \
        .withColumn("snapshot_id", F.expr("cast(snapshot_id + 2 * _k as int)")).drop("_k")
    rows.write.partitionBy(*SNAP).parquet(f"{root}/databases")
    heads = rows.select(*SNAP).distinct().withColumn("view_name", F.explode(F.array(F.lit("databases"), F.lit("master_files"))))
    lacking = (F.col("view_name") == "master_files") & ((F.ascii(F.substring("server_name", 4, 1)) + F.col("snapshot_id")) % 3 == 0)
    register = heads.where(~lacking).withColumn("snapshot_ts", F.expr("timestamp_ntz '2001-07-01 00:00:00' + make_dt_interval(snapshot_id)"))
    return root, register.select(*SNAP, "snapshot_ts", "view_name")


@case("r1_newest_snapshot", ["databases"], f"""{_LANDED},
whole as (select {K}, max(snapshot_ts) as ts from register where snapshot_ts <= timestamp '2001-07-05 12:00:00'
  group by all having count(distinct view_name) = 2),
newest as (select server_name, arg_max(snapshot_id, ts) as snapshot_id from whole group by server_name)
select l.server_name, l.snapshot_id, l.name, l.state_desc from landed l join newest n on l.server_name = n.server_name and l.snapshot_id = n.snapshot_id""")
def _r1(spark, d):
    root, register = _landed(spark, d)
    chosen = N.newest_snapshots(register, ["databases", "master_files"], as_of="2001-07-05 12:00:00")
    return N.load_view(spark, root, "databases", chosen).select(*SNAP, "name", "state_desc")


def _land_rollover(spark, events, number, name):
    """Three snapshots (1, 2, 3) of five rollover files; snapshot s has the
    files s - 1 to s + 1, so most files land more than once."""
    root = new_folder(spark)
    rows = events.drop("snapshot_id").withColumn("_f", number) \
        .withColumn("snapshot_id", F.explode(F.sequence(F.greatest(F.col("_f") - 1, F.lit(1)), F.least(F.col("_f") + 1, F.lit(3)))))
    rows.withColumn("landed_file", F.concat(F.lit(name), F.col("_f").cast("string"), F.lit(".trc" if name.startswith("log") else ".xel"))).drop("_f") \
        .write.partitionBy("server_name", "snapshot_id", "landed_file").parquet(root)
    return root


def _once(spark, d, view, number, name):
    root = _land_rollover(spark, rel(spark, d, view), number, name)
    events = V.read_rollover(spark, root, SCHEMAS[view])
    return V.events_once(events).withColumn("snapshot_id", F.lit(0)).drop("file_set", "file_no")


@case("r4_trace_rollover", ["trace_log", "trace_events"], f"""
select t.server_name, 0 as snapshot_id, database_name, event_name, file_name, start_time, duration_us // 1000 as duration_ms,
  cast(cast(integer_data * 8 as double) / 1024.0 as decimal(20,6)) as change_in_size_mb
from trace_log t join trace_events e on t.server_name = e.server_name and e.snapshot_id = 0 and event_class = trace_event_id
where event_class between 92 and 95""")
def _r4(spark, d):
    trace = _once(spark, d, "trace_log", F.expr("cast(day(start_time) % 5 as int)"), "log_")
    names = rel(spark, d, "trace_events").where("snapshot_id = 0")
    return C.autogrow_events(trace, names, variant="summary")


@case("r5_event_rollover", ["xe_events"], f"""
select server_name, 0 as snapshot_id, object_name,
  try_cast(regexp_extract(event_data, '<event timestamp="([^"]*)"', 1) as timestamp) + interval (-5) hour as event_timestamp,
  nullif(regexp_extract(event_data, '<data name="availability_group_name"><value>([^<]*)</value>', 1), '') as ag_name,
  nullif(regexp_extract(event_data, '<data name="previous_state"><text>([^<]*)</text>', 1), '') as previous_state,
  nullif(regexp_extract(event_data, '<data name="current_state"><text>([^<]*)</text>', 1), '') as current_state
from xe_events where object_name = 'availability_replica_state_change'""")
def _r5(spark, d):
    return H.ag_state_changes(_once(spark, d, "xe_events", F.expr("cast(length(event_data) % 5 as int)"), "AlwaysOn_health_0_"), utc_offset_hours=-5)


# Outputs that have drifted: a renamed column, an added one, a missing one; and broken lines.


@case("r6_database_output", ["dbinfo"], f"""
n as (select *, coalesce(try_cast(nullif(regexp_extract(database_name, '[0-9]+'), '') as integer), 0) as db from dbinfo),
l as (select {K}, database_name, field, "value", db % 11 as kind from n)
select {K}, database_name, case when kind not in (3, 7) then field end as field,
  case when kind not in (3, 5, 7) then strftime("value", '%Y-%m-%d %H:%M:%S') end as checked_at, kind = 9 as has_unknown,
  case when kind = 3 then 'not a JSON object' when kind = 7 then 'value: soon is no timestamp_ntz' end as reason from l""")
def _r6(spark, d):
    root = new_folder(spark)
    kind = F.coalesce(F.nullif(F.regexp_extract("database_name", "[0-9]+", 0), F.lit("")).try_cast("int"), F.lit(0)) % 11
    stamp = F.date_format("value", "yyyy-MM-dd HH:mm:ss")
    as_json = lambda **columns: F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))
    line = F.when(kind == 2, as_json(field=F.col("field"), checked_on=stamp)) \
        .when(kind == 3, F.substring(as_json(field=F.col("field"), value=stamp), 1, 20)) \
        .when(kind == 5, as_json(field=F.col("field"))) \
        .when(kind == 7, as_json(field=F.col("field"), value=F.lit("soon"))) \
        .when(kind == 9, as_json(field=F.col("field"), value=stamp, page=F.lit(7))) \
        .otherwise(as_json(field=F.col("field"), value=stamp))
    rel(spark, d, "dbinfo").select(*SNAP, "database_name", line.alias("line")).write.partitionBy(*O.PLACE).text(root)
    out = O.read_output(spark, root, "field string, value timestamp_ntz", required=["field"], renames={"checked_on": "value"})
    good = F.size("reasons") == 0
    return out.select(*O.PLACE, F.when(good, F.col("field")).alias("field"), F.date_format(F.when(good, F.col("value")), "yyyy-MM-dd HH:mm:ss").alias("checked_at"),
                      (F.size("unknown_columns") > 0).alias("has_unknown"), F.try_element_at("reasons", F.lit(1)).alias("reason"))


@case("r7_result_replacement", ["databases", "backupset"], f"""
f as (select distinct {K}, name as database_name from databases where (source_database_id is null) and database_id not in (2, 3)),
r as (select {K}, database_name, d from f, (select unnest([date '2001-08-01', date '2001-08-02']) as d))
select d as snapshot_date, {K}, database_name, case when d = date '2001-08-02' and server_name in ('srv1', 'srv2') then 'second' else 'first' end as run
from r where not (d = date '2001-08-02' and server_name = 'srv2')""")
def _r7(spark, d):
    """Two days of results; the second day is run again for two servers, one
    of which has no rows any more; a third run dies before it is published."""
    root = new_folder(spark)
    rows = D.last_full_backup(*rel(spark, d, "databases", "backupset")).drop("last_full_backup").distinct()
    days = rows.withColumn("snapshot_ts", F.explode(F.array(*[F.lit(f"2001-08-0{n} 01:00:00").cast("timestamp_ntz") for n in (1, 2)])))
    pairs = days.select(F.to_date("snapshot_ts").alias("snapshot_date"), "server_name").distinct()
    R.replace_results(days.withColumn("by", F.lit("first")), root, pairs)
    again = days.where("snapshot_ts > timestamp_ntz '2001-08-02 00:00:00' and server_name = 'srv1'")
    R.replace_results(again.withColumn("by", F.lit("second")), root, pairs.where("snapshot_date = date '2001-08-02' and server_name in ('srv1', 'srv2')"))
    R.stage_run(days.withColumn("by", F.lit("third")), root)
    return R.read_results(spark, root).select("snapshot_date", *SNAP, "database_name", F.col("by").alias("run"))


# ---------------------------------------------------------------- rule, pattern and gate tables
# Rules of a landed table: intervals of all lengths, prefixes, priorities with ties.
_RULES = {
    "rule_set": "'patch'", "major": "cast(8 + o_orderkey % 8 as {s})", "minor_prefix": "case when o_custkey % 4 = 0 then '0' when o_custkey % 9 = 1 then '5' end",
    "lo": "cast(o_custkey % 5000 as bigint)", "hi": "cast(case when o_orderkey % 5 = 0 then 1073741824 else o_custkey % 5000 + o_orderkey % 700 end as bigint)",
    "exact_version": "cast(null as {s})", "priority": "cast(o_custkey % 100 as int)", "outcome": "'rule ' || cast(o_orderkey as {s})",
}


def _rules_sql(text):
    return ", ".join(f"{e.format(s=text)} as {c}" for c, e in _RULES.items())


@case("a7_rules_from_table", ["instances"], f"""
v as (select {K}, product_version, split_part(product_version, '.', 1) as ma, split_part(product_version, '.', 2) as mi,
  cast(split_part(product_version, '.', 3) as bigint) as b from instances),
r as (select {_rules_sql("varchar")} from orders),
j as (select v.server_name, v.snapshot_id, v.product_version, r.*, row_number() over (partition by v.server_name, v.snapshot_id
    order by r.priority, r.lo, r.hi, r.outcome) as rn
  from v join r on v.ma = r.major and v.b between r.lo and r.hi and (r.minor_prefix is null or starts_with(v.mi, r.minor_prefix)))
select v.server_name, v.snapshot_id, v.product_version, j.outcome as patch_status, j.outcome || ' holds' as message
from v left join j on v.server_name = j.server_name and v.snapshot_id = j.snapshot_id and j.rn = 1""")
def _a7_table(spark, d):
    rules = spark.sql(f"select {_rules_sql('string')} from {{o}}", o=spark.read.parquet(f"{d}/orders.parquet")) \
        .withColumns({"obsolete": F.lit(False), "compat": F.lit(None).cast("int"), "messages": F.array(F.concat("outcome", F.lit(" holds")))})
    return A.side_channel_patch(spark, rel(spark, d, "instances"), rules=rules)


_PATTERN = ("case s_suppkey % 5 when 0 then '%' || substr(s_name, length(s_name) - 2, 2) || '%.dll' when 1 then 'swi_' || '%' || cast(s_suppkey as {s}) "
            "when 2 then '%a_' || cast(s_suppkey % 10 as {s}) || '%' when 3 then '%sophos%' else substr(s_name, 1, 3) || '%' end")


@case("b12_modules_by_pattern_table", ["modules"], f"""
p as (select distinct {_PATTERN.format(s="varchar")} as pattern from supplier)
select {K}, name from modules m where exists (select 1 from p where lower(m.name) like lower(p.pattern))""")
def _b12_table(spark, d):
    patterns = spark.read.parquet(f"{d}/supplier.parquet").select(F.expr(_PATTERN.format(s="string")).alias("pattern"))
    return B.module_listing(rel(spark, d, "modules"), patterns=patterns)


_JOB_PATTERN = "'%' || substr(p_name, 2, 4) || '%'"


@case("i1_job_steps_by_pattern_table", ["jobs", "job_steps"], f"""
p as (select distinct {_JOB_PATTERN} as pattern from part where p_size % 7 = 0)
select j.server_name, j.snapshot_id, j.name as job_name, j.enabled, s.step_name, s.step_id, s.retry_attempts, s.retry_interval
from jobs j join job_steps s on j.server_name = s.server_name and j.snapshot_id = s.snapshot_id and j.job_id = s.job_id
where exists (select 1 from p where lower(j.name) like lower(p.pattern))""")
def _i1_table(spark, d):
    patterns = spark.read.parquet(f"{d}/part.parquet").where("p_size % 7 = 0").select(F.expr(_JOB_PATTERN).alias("pattern"))
    return I.maintenance_job_steps(*rel(spark, d, "jobs", "job_steps"), patterns=patterns)


_HOSTED = "case when is_rds then 'rds' when engine_edition = 5 then 'azure_db' when engine_edition = 8 then 'azure_mi' else 'box' end"
_CLOSED = """((p.platform in ('rds', 'azure_db') and f.check_id in ('B7.database_owner', 'B7.job_owner', 'B7.package_owner'))
  or (p.platform = 'azure_db' and f.check_id in ('B10.msdb_size', 'D6.no_log_backup'))
  or (p.platform = 'rds' and f.check_id in ('D11.never_checked', 'D12.stale_integrity')))"""


@case("health_check_gated", [], f"""
select f.* from ({CASES["health_check_findings"][1]}) as f
where not exists (select 1 from (select 'srv' || cast(n_nationkey as varchar) as server_name, {_HOSTED} as platform
    from (select n_nationkey, cast(case n_nationkey % 5 when 2 then 5 when 3 then 8 else 3 end as int) as engine_edition, n_nationkey % 5 = 1 as is_rds from nation)) p
  where p.server_name = f.server_name and {_CLOSED})""")
def _gated(spark, d):
    from .suite_cases import AS_OF, _HC_RELS
    return RP.gated_findings(spark, dict(zip(_HC_RELS, rel(spark, d, *_HC_RELS))), as_of=AS_OF)


@case("b6_owner_listing_gated", ["instances", "databases", "jobs", "packages"], f"""
i as (select distinct {K}, {_HOSTED} as platform, cast(split_part(product_version, '.', 1) as int) as major from instances)
select l.* from ({CASES["b6_owner_listing"][1]}) as l left join i on l.server_name = i.server_name and l.snapshot_id = i.snapshot_id
where coalesce(i.platform, 'none') not in ('rds', 'azure_db') and not coalesce(i.major between 10 and 12, false)""")
def _b6_gated(spark, d):
    """The listing as all servers ask for it, with one more gate by version."""
    gates = gate_table(spark).unionByName(spark.createDataFrame([("B6.owner_listing", None, 10, 12, None)], GATE))
    i, *tables = rel(spark, d, "instances", "databases", "jobs", "packages")
    return open_gates(B.owner_listing(*tables), i, gates, ["settings"], check=F.lit("B6.owner_listing"))
