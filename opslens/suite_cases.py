"""Oracle cases, one per operator. Each Spark side runs
the library operator; each oracle is hand-written DuckDB SQL over the same
bindings."""

from __future__ import annotations

from .operators import storage as C
from .suite import CASES, case, rel

K = "server_name, snapshot_id"
J = "a.server_name = b.server_name and a.snapshot_id = b.snapshot_id"
MONEY = "format('{{:,.2f}}', floor(cast({} as double) * 100 + 0.5) / 100)"


def money(x):
    return MONEY.format(x)


# ---------------------------------------------------------------- family C
def _top_io_sql(metric):
    return f"""
agg as (select {K}, database_id, sum({metric}) as v from io_file_stats group by all),
per_db as (select a.server_name, a.snapshot_id, b.name as database_name, cast(sum(v) as bigint) as {metric}
  from agg a join databases b on {J} and a.database_id = b.database_id
  where b.source_database_id is null group by all),
r as (select *, row_number() over (partition by {K} order by {metric} desc, database_name) as rn from per_db)
select {K}, database_name, {metric}, {money(metric)} as {metric}_text from r where rn <= 3"""


@case("c1_top_databases_by_reads", ["io_file_stats", "databases"], _top_io_sql("num_of_reads"))
def _c1(spark, d):
    return C.top_databases_by_reads(*rel(spark, d, "io_file_stats", "databases"))


@case("c2_top_databases_by_writes", ["io_file_stats", "databases"], _top_io_sql("num_of_writes"))
def _c2(spark, d):
    return C.top_databases_by_writes(*rel(spark, d, "io_file_stats", "databases"))


def _share_sql(value_expr, name):
    return f"""
per_db as (select {K}, database_id, {value_expr} as {name} from io_file_stats group by all),
s as (select *, cast(cast({name} as double) / cast(sum({name}) over (partition by {K}) as double) * 100 as decimal(5,2)) as pct from per_db),
r as (select s.*, b.name as database_name,
      row_number() over (partition by s.server_name, s.snapshot_id order by pct desc, s.database_id) as rn
      from s left join databases b on s.server_name = b.server_name and s.snapshot_id = b.snapshot_id and s.database_id = b.database_id)
select {K}, database_id, {name}, pct, database_name, {money(name)} as {name}_text from r where rn <= 3"""


@case("c3_io_share", ["io_file_stats", "databases"],
      _share_sql("cast(sum(num_of_reads + num_of_writes) / 2.0 as decimal(20,2))", "io_avg"))
def _c3(spark, d):
    return C.io_share(*rel(spark, d, "io_file_stats", "databases"))


@case("c4_io_mb_share", ["io_file_stats", "databases"],
      _share_sql("cast(cast(sum(num_of_bytes_read + num_of_bytes_written) as double) / 1048576.0 as decimal(20,2))",
                 "io_in_mb"))
def _c4(spark, d):
    return C.io_mb_share(*rel(spark, d, "io_file_stats", "databases"))


_IOCOLS = ["num_of_reads", "num_of_writes", "io_stall_read_ms", "io_stall_write_ms",
           "num_of_bytes_read", "num_of_bytes_written", "io_stall"]
_SUMS = ", ".join(f"sum({c}) as {c}" for c in _IOCOLS)


@case("c5_drive_latency", ["io_file_stats", "master_files"], f"""
pf as (select {K}, database_id, file_id, {_SUMS} from io_file_stats group by all),
j as (select a.*, left(upper(b.physical_name), 2) as drive, b.volume_mount_point
      from pf a join master_files b on {J} and a.database_id = b.database_id and a.file_id = b.file_id),
t as (select {K}, drive, volume_mount_point, {_SUMS} from j group by all)
select {K}, drive, volume_mount_point,
  cast(case when num_of_reads = 0 then 0 else io_stall_read_ms // num_of_reads end as bigint) as read_latency_ms,
  cast(case when num_of_writes = 0 then 0 else io_stall_write_ms // num_of_writes end as bigint) as write_latency_ms,
  cast(case when num_of_reads + num_of_writes = 0 then 0 else io_stall // (num_of_reads + num_of_writes) end as bigint) as overall_latency_ms,
  cast(case when num_of_reads = 0 then 0 else num_of_bytes_read // num_of_reads end as bigint) as avg_bytes_per_read,
  cast(case when num_of_writes = 0 then 0 else num_of_bytes_written // num_of_writes end as bigint) as avg_bytes_per_write,
  cast(case when num_of_reads + num_of_writes = 0 then 0 else (num_of_bytes_read + num_of_bytes_written) // (num_of_reads + num_of_writes) end as bigint) as avg_bytes_per_transfer
from t""")
def _c5(spark, d):
    return C.drive_latency(*rel(spark, d, "io_file_stats", "master_files"))


@case("c5_drive_latency_by_volume", ["io_file_stats", "master_files", "volumes"], f"""
pf as (select {K}, database_id, file_id, {_SUMS} from io_file_stats group by all),
j as (select a.*, left(upper(b.physical_name), 2) as drive, v.volume_mount_point
      from pf a join master_files b on {J} and a.database_id = b.database_id and a.file_id = b.file_id
      join volumes v on a.server_name = v.server_name and a.snapshot_id = v.snapshot_id and a.database_id = v.database_id and a.file_id = v.file_id),
t as (select {K}, drive, volume_mount_point, {_SUMS} from j group by all)
select {K}, drive, volume_mount_point,
  cast(case when num_of_reads = 0 then 0 else io_stall_read_ms // num_of_reads end as bigint) as read_latency_ms,
  cast(case when num_of_writes = 0 then 0 else io_stall_write_ms // num_of_writes end as bigint) as write_latency_ms,
  cast(case when num_of_reads + num_of_writes = 0 then 0 else io_stall // (num_of_reads + num_of_writes) end as bigint) as overall_latency_ms,
  cast(case when num_of_reads = 0 then 0 else num_of_bytes_read // num_of_reads end as bigint) as avg_bytes_per_read,
  cast(case when num_of_writes = 0 then 0 else num_of_bytes_written // num_of_writes end as bigint) as avg_bytes_per_write,
  cast(case when num_of_reads + num_of_writes = 0 then 0 else (num_of_bytes_read + num_of_bytes_written) // (num_of_reads + num_of_writes) end as bigint) as avg_bytes_per_transfer
from t""")
def _c5v(spark, d):
    io, files, volumes = rel(spark, d, "io_file_stats", "master_files", "volumes")
    return C.drive_latency(io, files.drop("volume_mount_point"), volumes=volumes)



def _fill(used, size):
    return f"substr(cast(cast(cast({used} as double) * 100.0 / cast({size} as double) as decimal(18,6)) as varchar), 1, 6)"


@case("c6_database_space", ["master_files"], f"""
a as (select {K}, database_name,
  cast(sum(case when type = 0 then size * 8 // 1024 end) as bigint) as total_size_data,
  cast(sum(case when type = 0 then space_used * 8 // 1024 end) as bigint) as space_util_data,
  sum(case when type = 0 then size end) as dsize, sum(case when type = 0 then space_used end) as dused,
  cast(sum(case when type = 1 then size * 8 // 1024 end) as bigint) as total_size_log,
  cast(sum(case when type = 1 then space_used * 8 // 1024 end) as bigint) as space_util_log,
  sum(case when type = 1 then size end) as lsize, sum(case when type = 1 then space_used end) as lused,
  count(case when type = 0 then 1 end) as nd, count(case when type = 1 then 1 end) as nl
  from master_files where type in (0, 1) group by all)
select {K}, database_name, total_size_data, space_util_data, total_size_data - space_util_data as space_data_left,
  case when total_size_data = 0 then null else {_fill('dused', 'dsize')} end as percent_fill_data,
  case when total_size_data = 0 then 'less than 1% used' end as fill_note,
  total_size_log, space_util_log, total_size_log - space_util_log as space_log_left,
  case when total_size_log = 0 then 'less than 1% used' else {_fill('lused', 'lsize')} end as percent_fill_log,
  total_size_log + total_size_data as total_db_size, space_util_data + space_util_log as total_size_used,
  (total_size_log + total_size_data) - (space_util_data + space_util_log) as total_size_left
from a where nd > 0 and nl > 0""")
def _c6(spark, d):
    return C.database_space(rel(spark, d, "master_files"))


@case("c7_database_size_by_type", ["databases", "master_files"], f"""
s as (select {K}, database_id,
  sum(case when type = 0 then size end) as r, sum(case when type = 1 then size end) as l,
  sum(case when type = 2 then size end) as st, sum(case when type = 4 then size end) as tx
  from master_files where type in (0, 1, 2, 4) group by all)
select a.server_name, a.snapshot_id, a.name as database_name,
  cast(r as double) * 8 / 1024 as row_size_mb, cast(l as double) * 8 / 1024 as log_size_mb,
  cast(r as double) * 8 / 1024 / 1024 + cast(l as double) * 8 / 1024 / 1024 as db_size_gb,
  cast(st as double) * 8 / 1024 as stream_size_mb, cast(tx as double) * 8 / 1024 as text_index_size_mb
from databases a left join s b on {J} and a.database_id = b.database_id""")
def _c7(spark, d):
    return C.database_size_by_type(*rel(spark, d, "databases", "master_files"))


_GROWTH = ("case when is_percent_growth then printf('%10d', growth) || '  %' "
           "else printf('%10d', (growth * 8) // 1024) || ' mb' end")
_TD = "case type when 0 then 'ROWS' when 1 then 'LOG' when 2 then 'FILESTREAM' when 4 then 'FULLTEXT' end"


@case("c8_file_growth", ["master_files"], f"""
select {K}, database_name, physical_name,
  case when {_TD} = 'ROWS' then 'Data' when lower({_TD}) = 'log' then 'Log' else {_TD} end as file_type,
  cast(cast(size as double) / 128 as decimal(18,2)) as initial_mb, {_GROWTH} as growth_increment, state_desc,
  case when max_size = 0 or growth = 0 then '*** No growth allowed ***'
       when max_size = -1 and growth > 0 then 'File will grow until disk full'
       when max_size = 268435456 and growth > 0 then 'File will grow to max size of 2TB'
       when max_size > 0 and growth > 0 then '*** File growth limited to fixed size ***' end as max_size_text
from master_files""")
def _c8(spark, d):
    return C.file_growth(rel(spark, d, "master_files"))


@case("c9_file_growth_checks", ["master_files"], f"""
a as (select {K},
  count(case when max_size = 0 or growth = 0 then 1 end) as no_growth,
  count(case when max_size > 0 and max_size < 268435456 and growth > 0 then 1 end) as fixed,
  count(case when growth * 8 // 1024 = 1 and not is_percent_growth then 1 end) as one_mb
  from master_files group by all)
select {K}, 'C9.max_size' as check_id,
  case when no_growth > 0 or fixed > 0 then 'warn' else 'ok' end as severity,
  cast(case when no_growth > 0 then no_growth when fixed > 0 then fixed else 0 end as varchar) as observed,
  case when no_growth > 0 then printf('No growth allowed on %d file(s)', no_growth)
       when fixed > 0 then printf('File growth limited to fixed size on %d file(s)', fixed)
       else 'Max file size verified' end as message from a
union all
select {K}, 'C9.increment_1mb', case when one_mb > 0 then 'warn' else 'ok' end, cast(one_mb as varchar),
  case when one_mb > 0 then printf('Growth increment set to 1MB on %d file(s)', one_mb) else 'File growth verified' end
from a""")
def _c9(spark, d):
    return C.file_growth_checks(rel(spark, d, "master_files"))


@case("c10_tempdb_files", ["master_files"], f"""
select {K}, database_name, physical_name,
  case when {_TD} = 'ROWS' then 'Data' when lower({_TD}) = 'log' then 'Log' end as file_type,
  cast(cast(size as double) / 128 as decimal(18,2)) as initial_mb, {_GROWTH} as growth_increment, state_desc
from master_files where database_id = 2""")
def _c10(spark, d):
    return C.tempdb_files(rel(spark, d, "master_files"))


@case("c11_tempdb_file_count", ["master_files"], f"""
a as (select {K}, count(*) as n, count(case when type = 0 then 1 end) as n_data
      from master_files where database_id = 2 group by all)
select {K}, 'C11.tempdb_files' as check_id, case when n = 2 then 'warn' else 'info' end as severity,
  cast(case when n = 2 then 1 else n_data end as varchar) as observed,
  case when n = 2 then 'Only 1 tempdb data file set' else printf('tempdb DATA file count = %d', n_data) end as message
from a""")
def _c11(spark, d):
    return C.tempdb_file_count(rel(spark, d, "master_files"))


@case("c12_tempdb_uniformity", ["master_files"], f"""
t as (select {K}, type, min(size) <> max(size) as sd, min(growth) <> max(growth) as gd
      from master_files where database_id = 2 group by all),
a as (select {K}, max(cast(sd as int)) as s, max(cast(gd as int)) as g from t group by all)
select {K}, 'C12.initial_size' as check_id, case when s = 1 then 'warn' else 'ok' end as severity,
  cast(s as varchar) as observed,
  case when s = 1 then 'Tempdb initial file size not the same' else 'Tempdb initial file size verified' end as message
from a
union all
select {K}, 'C12.growth', case when g = 1 then 'warn' else 'ok' end, cast(g as varchar),
  case when g = 1 then 'Tempdb growth increments not the same' else 'Tempdb growth increments verified' end
from a""")
def _c12(spark, d):
    return C.tempdb_uniformity(rel(spark, d, "master_files"))


@case("c13_vlf_counts", ["log_info"], f"""
select {K}, database_name, count(*) as vlf_count from log_info group by all""")
def _c13(spark, d):
    return C.vlf_counts(rel(spark, d, "log_info"))


@case("c13_vlf_check", ["log_info"], f"""
v as (select {K}, database_name, count(*) as vlf_count from log_info group by all),
a as (select {K}, count(case when vlf_count > 500 then 1 end) as n from v group by all)
select {K}, 'C13.vlf' as check_id, case when n > 0 then 'warn' else 'ok' end as severity,
  cast(n as varchar) as observed,
  case when n > 0 then printf('%d database(s) with more than %d VLFs', n, 500) else 'VLF counts verified' end as message
from a""")
def _c13b(spark, d):
    return C.vlf_check(rel(spark, d, "log_info"))


@case("c14_autogrow_events", ["trace_log", "trace_events"], f"""
select t.server_name, t.snapshot_id, database_name, event_name, file_name,
  cast(cast(duration_us as decimal(20,0)) * 0.000001 as decimal(10,3)) as time_taken_seconds, start_time, end_time,
  cast(cast(integer_data as double) * 8.0 / 1024 as decimal(20,6)) as change_in_size_mb,
  application_name, host_name, login_name
from trace_log t join trace_events e on t.server_name = e.server_name and t.snapshot_id = e.snapshot_id and event_class = trace_event_id
where event_class between 92 and 95""")
def _c14(spark, d):
    return C.autogrow_events(*rel(spark, d, "trace_log", "trace_events"))


@case("c14_autogrow_summary", ["trace_log", "trace_events"], f"""
select t.server_name, t.snapshot_id, database_name, event_name, file_name, start_time, duration_us // 1000 as duration_ms,
  cast(cast(integer_data * 8 as double) / 1024.0 as decimal(20,6)) as change_in_size_mb
from trace_log t join trace_events e on t.server_name = e.server_name and t.snapshot_id = e.snapshot_id and event_class = trace_event_id
where event_class between 92 and 95""")
def _c14b(spark, d):
    return C.autogrow_events(*rel(spark, d, "trace_log", "trace_events"), variant="summary")


@case("c15_trace_coverage", ["trace_log", "trace_events"], f"""
select {K}, min(start_time) as first_event, max(start_time) as last_event
from trace_log t where exists (select 1 from trace_events e where t.server_name = e.server_name and t.snapshot_id = e.snapshot_id
  and event_class = trace_event_id) group by all""")
def _c15(spark, d):
    return C.trace_coverage(*rel(spark, d, "trace_log", "trace_events"))


# ---------------------------------------------------------------- family A
from .operators import instance as A  # noqa: E402

_VNAME = ("case when starts_with(product_version, '8.') then '2000' when starts_with(product_version, '9.') then '2005' "
          "when starts_with(product_version, '10.0') then '2008' when starts_with(product_version, '10.5') then '2008 R2' "
          "when starts_with(product_version, '11.') then '2012' when starts_with(product_version, '12.') then '2014' "
          "when starts_with(product_version, '13.') then '2016' when starts_with(product_version, '14.') then '2017' "
          "when starts_with(product_version, '15.') then '2019' end")


@case("a1_instance_identity", ["instances"], f"""
select {K}, machine_name, coalesce(instance_name, '<default>') as instance_name, edition, product_version,
  {_VNAME} as version_name, product_level, "collation", is_clustered, is_hadr_enabled, virtual_machine_type,
  cpu_count, hyperthread_ratio, cpu_count // hyperthread_ratio as sockets,
  cast(cast(physical_memory_kb as double) / 1024 / 1024 as decimal(15,2)) as physical_memory_gb
from instances""")
def _a1(spark, d):
    return A.instance_identity(rel(spark, d, "instances"))


@case("a2_version_name", ["instances"], f"select {K}, product_version, {_VNAME} as version_name from instances")
def _a2(spark, d):
    return A.version_names(rel(spark, d, "instances"))


_VIS = (f"vis as (select {K}, count(cpu_id) as visible_cpu_count from schedulers "
        "where status = 'VISIBLE ONLINE' group by all)")


@case("a3_cpu_visibility", ["instances", "schedulers"], f"""{_VIS}
select a.server_name, a.snapshot_id, a.cpu_count, b.visible_cpu_count from instances a join vis b on {J}""")
def _a3(spark, d):
    return A.cpu_visibility(*rel(spark, d, "instances", "schedulers"))


@case("a4_identity_checks", ["instances", "schedulers", "config"], f"""{_VIS},
mm as (select {K}, max(case when name = 'max server memory (MB)' then value_in_use end) as max_mem_mb from config group by all),
b as (select i.server_name, i.snapshot_id, i.machine_name, i.physical_memory_kb, i.cpu_count, v.visible_cpu_count, m.max_mem_mb
      from instances i left join vis v on i.server_name = v.server_name and i.snapshot_id = v.snapshot_id
      left join mm m on i.server_name = m.server_name and i.snapshot_id = m.snapshot_id)
select {K}, 'A4.server_name' as check_id, 'warn' as severity, machine_name as observed,
  'server name differs from machine name ' || machine_name as message from b where server_name <> machine_name
union all
select {K}, 'A4.cpu', 'warn', cast(visible_cpu_count as varchar),
  printf('%d OS CPUs but %d visible schedulers', cpu_count, visible_cpu_count) from b where cpu_count <> visible_cpu_count
union all
select {K}, 'A4.max_memory', 'warn', cast(max_mem_mb as varchar), 'SQL max memory is above physical memory' from b
where cast(cast(cast(physical_memory_kb as double) / 1024 / 1024 as decimal(15,2)) as double) < max_mem_mb / 1024.0
  and max_mem_mb <> 2147483647""")
def _a4(spark, d):
    return A.identity_checks(*rel(spark, d, "instances", "schedulers", "config"))


def _q(s):
    return "'" + s.replace("'", "''") + "'"


_VPARTS = (f"v as (select {K}, product_version, split_part(product_version, '.', 1) as ma, "
           "split_part(product_version, '.', 2) as mi, cast(split_part(product_version, '.', 3) as bigint) as b from instances)")


def _support_sql():
    def sp(build):
        return f"case when b >= {build} then 'latest_sp' else 'not_latest_sp' end"
    status = (f"case when ma = '8' then {sp(2039)} when ma = '9' then {sp(5000)} "
              f"when ma = '10' and (mi like '0%' or mi like '4%') then {sp(6000)} when ma = '10' and mi like '5%' then {sp(6000)} "
              f"when ma = '11' then {sp(7001)} when ma = '12' then {sp(6024)} when ma = '13' then {sp(5026)} "
              "when ma = '14' then case when b = 1000 then 'rtm' when b > 1000 then 'not_rtm' end "
              "when ma = '15' then case when b = 2000 then 'rtm' when b > 2000 then 'not_rtm' end end")
    label = ("case when ma = '8' then '8.0.2039.0' when ma = '9' then '9.00.5000.00' "
             "when ma = '10' and (mi like '0%' or mi like '4%') then '10.0.6000.29' when ma = '10' and mi like '5%' then '10.50.6000.34' "
             "when ma = '11' then '11.0.7001.0' when ma = '12' then '12.0.6024.0' when ma = '13' then '13.0.5026.0' end")
    compat = ("case when ma = '8' then 80 when ma = '9' then 90 when ma = '10' and (mi like '0%' or mi like '4%' or mi like '5%') then 100 "
              "when ma in ('11','12','13','14','15') then cast(ma as int) * 10 end")
    obsolete = "coalesce(ma in ('8', '9') or (ma = '10' and (mi like '0%' or mi like '4%' or mi like '5%')), false)"
    return f"""{_VPARTS},
s as (select *, {status} as support_status, {label} as label, {compat} as instance_compat_level, {obsolete} as obsolete from v)
select {K}, product_version, support_status, obsolete, instance_compat_level,
  case support_status when 'latest_sp' then 'version is or surpasses the latest service pack'
    when 'not_latest_sp' then 'version is not the latest service pack of ' || label
    when 'rtm' then 'version is RTM and very likely not the latest CU'
    when 'not_rtm' then 'version is at least not RTM; verify it is the latest CU' end as message
from s"""


@case("a5_support_level", ["instances"], _support_sql())
def _a5(spark, d):
    return A.support_level(spark, rel(spark, d, "instances"))


def _risk_sql():
    L = lambda *m: "[" + ", ".join(_q(x) for x in m) + "]"
    leak = "Memory leak with AUTO_UPDATE_STATS_ASYNC; fixed in {}".format
    reb = "Parallel online index rebuild can corrupt; fixed in {}".format
    ag = "Availability group may report NOT SYNCHRONIZING; fixed in {}".format
    tde = "Backup compression on TDE databases can produce corrupt backups; fixed in {}".format
    msi = "msiexec keeps running after SP1 install (100% CPU); fixed in 2012 SP1 CU2"
    r12 = reb("2012 SP1 CU11 or 2012 SP2 CU1")
    msgs = (f"case when ma = '10' and mi = '0' then case when b < 5828 then {L(leak('2008 SP3 CU8'))} end "
            f"when ma = '10' and mi = '50' then case when b >= 4270 then null when b >= 4000 then {L(leak('2008 R2 SP2 CU4'))} "
            f"  when b >= 2868 then null else {L(leak('2008 R2 SP1 CU10'))} end "
            f"when ma = '11' then case when b = 5569 or b = 5556 then {L(ag('2012 SP2 CU5'))} when b >= 5532 then null "
            f"  when b > 3436 then case when b < 5058 then null else {L(reb('2012 SP2 CU1'))} end "
            f"  when b < 3436 then case when product_version in ('11.0.3000.0', '11.1.3000.0') then {L(msi, r12)} "
            f"    when b < 2384 then {L(leak('2012 RTM CU5'), r12)} else {L(r12)} end end "
            f"when ma = '12' then case when b = 2456 then {L(ag('2014 RTM CU6'))} when b > 2369 then null else {L(reb('2014 RTM CU2'))} end "
            f"when ma = '13' then case when b >= 5153 then null when b >= 5026 then {L(tde('2016 SP2 CU2'))} "
            f"  when b >= 4502 then null else {L(tde('2016 SP1 CU9'))} end "
            f"when ma = '14' then case when b > 3029 then null else {L(tde('2017 RTM CU9'))} end end")
    return f"""{_VPARTS}
select {K}, product_version, unnest(coalesce({msgs}, [null::varchar])) as message from v"""


@case("a6_risky_build", ["instances"], _risk_sql())
def _a6(spark, d):
    return A.risky_build(spark, rel(spark, d, "instances"))


def _patch_sql():
    def need(kb):
        return _q(f"security update needed: {kb}")
    ok = "'side-channel patch in place'"
    ladder = (f"case when ma = '10' and mi like '5%' then case when b >= 6560 then {ok} else {need('2008 R2 SP3 (KB 4057113)')} end "
              f"when ma = '10' then case when b >= 6556 then {ok} else {need('2008 SP4 (KB 4057114)')} end "
              f"when ma = '11' then case when b >= 7462 then {ok} when b > 6615 then {need('2012 SP4 (KB 4057116)')} when b = 6615 then {ok} "
              f"  when b > 6260 then {need('2012 SP3 CU (KB 4057121)')} when b = 6260 then {ok} else {need('2012 SP3 (KB 4057115)')} end "
              f"when ma = '12' then case when b >= 5571 then {ok} when b > 5214 then {need('2014 SP2 CU10 (KB 4057117)')} when b = 5214 then {ok} "
              f"  else {need('2014 SP2 GDR (KB 4057120)')} end "
              f"when ma = '13' then case when b >= 4466 then {ok} when b > 4210 then {need('2016 SP1 CU7 (KB 4057119)')} when b = 4210 then {ok} "
              f"  when b > 2218 then {need('2016 SP1 GDR (KB 4057118)')} when b = 2218 then {ok} when b > 1745 then {need('2016 RTM CU (KB 4058559)')} "
              f"  when b = 1745 then {ok} else {need('2016 RTM GDR (KB 4058560)')} end "
              f"when ma = '14' then case when b >= 3015 then {ok} when b > 2000 then {need('2017 RTM CU3 (KB 4058562)')} when b = 2000 then {ok} "
              f"  else {need('2017 GDR (KB 4057122)')} end end")
    return f"""{_VPARTS},
p as (select *, {ladder} as message from v)
select {K}, product_version, case when message is null then null when message = {ok} then 'patched' else 'needed' end as patch_status, message from p"""


@case("a7_side_channel_patch", ["instances"], _patch_sql())
def _a7(spark, d):
    return A.side_channel_patch(spark, rel(spark, d, "instances"))


@case("a8_memory_settings", ["config"], f"""
m as (select {K}, max(case when name = 'max server memory (MB)' then value_in_use end) as max_mem_mb,
  max(case when name = 'min server memory (MB)' then value_in_use end) as min_mem_mb from config group by all)
select {K}, max_mem_mb, min_mem_mb, {money('max_mem_mb / 1024.0')} as max_mem_gb_text,
  {money('min_mem_mb / 1024.0')} as min_mem_gb_text from m""")
def _a8(spark, d):
    return A.memory_settings(rel(spark, d, "config"))


# ---------------------------------------------------------------- family B
from .operators import database as B  # noqa: E402

_LIVE = "source_database_id is null"


@case("b1_db_count_by_state", ["databases"], f"""
select {K}, state_desc, count(*) as db_count from databases where {_LIVE} group by all""")
def _b1(spark, d):
    return B.db_count_by_state(rel(spark, d, "databases"))


@case("b2_config_listing", ["config"], f"""
select {K}, name, value, value_in_use from config where name in ('backup compression default', 'clr enabled',
  'max degree of parallelism', 'cost threshold for parallelism', 'min server memory (MB)', 'max server memory (MB)',
  'max full-text crawl range', 'priority boost', 'optimize for ad hoc workloads', 'remote admin connections')""")
def _b2(spark, d):
    return B.config_listing(rel(spark, d, "config"))


def _has(name, col, v):
    return f"max(case when name = {_q(name)} and {col} = {v} then 1 else 0 end) > 0"


def _inuse(name):
    return f"max(case when name = {_q(name)} then value_in_use end)"


_GB = "format('{:,.2f}', cast({} / 1024.0 as double))"


@case("b3_config_checks", ["config", "instances"], f"""
a0 as (select {K},
  {_has('max server memory (MB)', 'value', 2147483647)} as max_unset, {_has('min server memory (MB)', 'value', 0)} as min_unset,
  {_inuse('max server memory (MB)')} as max_mem, {_inuse('min server memory (MB)')} as min_mem,
  {_has('backup compression default', 'value_in_use', 0)} as bc0, {_has('backup compression default', 'value_in_use', 1)} as bc1,
  {_has('optimize for ad hoc workloads', 'value_in_use', 0)} as ah0, {_has('optimize for ad hoc workloads', 'value_in_use', 1)} as ah1,
  {_has('clr enabled', 'value_in_use', 1)} as clr, {_has('remote admin connections', 'value_in_use', 1)} as rac,
  {_has('priority boost', 'value_in_use', 1)} as pb,
  {_has('max degree of parallelism', 'value_in_use', 1)} as dop1, {_has('max degree of parallelism', 'value_in_use', 0)} as dop0,
  {_inuse('max degree of parallelism')} as dop,
  {_has('cost threshold for parallelism', 'value_in_use', 5)} as ct5, {_inuse('cost threshold for parallelism')} as ct,
  {_has('max full-text crawl range', 'value_in_use', 4)} as cr4, {_inuse('max full-text crawl range')} as cr
  from config group by all),
a as (select a0.*, coalesce(i.is_fulltext_installed, false) as ft from a0 left join instances i
      on a0.server_name = i.server_name and a0.snapshot_id = i.snapshot_id)
select {K}, 'B3.max_memory' as check_id, case when max_unset then 'warn' else 'info' end as severity, cast(max_mem as varchar) as observed,
  case when max_unset then 'max server memory is NOT SET' else 'max server memory is set to ' || {money('max_mem / 1024.0')} || ' GB' end as message from a
union all select {K}, 'B3.min_memory', case when min_unset then 'warn' else 'info' end, cast(min_mem as varchar),
  case when min_unset then 'min server memory is NOT SET' else 'min server memory is set to ' || {money('min_mem / 1024.0')} || ' GB' end from a
union all select {K}, 'B3.backup_compression', case when bc0 then 'warn' else 'info' end, cast(cast(bc1 as int) as varchar),
  case when bc0 then 'backup compression is NOT ENABLED' when bc1 then 'backup compression is enabled' else 'backup compression is not available' end from a
union all select {K}, 'B3.adhoc', case when ah0 then 'warn' else 'info' end, cast(cast(ah1 as int) as varchar),
  case when ah0 then 'optimize for ad hoc workloads is NOT ENABLED' when ah1 then 'optimize for ad hoc workloads is enabled'
  else 'optimize for ad hoc workloads is not available' end from a
union all select {K}, 'B3.clr', case when clr then 'warn' else 'ok' end, cast(cast(clr as int) as varchar),
  case when clr then 'clr IS ENABLED' else 'clr is not enabled' end from a
union all select {K}, 'B3.remote_admin', case when rac then 'warn' else 'ok' end, cast(cast(rac as int) as varchar),
  case when rac then 'remote admin connections IS ENABLED' else 'remote admin connections is not enabled' end from a
union all select {K}, 'B3.priority_boost', case when pb then 'warn' else 'ok' end, cast(cast(pb as int) as varchar),
  case when pb then 'priority boost IS ENABLED' else 'priority boost is not enabled' end from a
union all select {K}, 'B3.maxdop', case when dop0 then 'ok' else 'warn' end, cast(dop as varchar),
  case when dop1 then 'maxdop IS DISABLED' when dop0 then 'maxdop is set to the default of 0'
  else 'maxdop is set to ' || cast(dop as varchar) || ' - NOT DEFAULT' end from a
union all select {K}, 'B3.cost_threshold', case when ct5 or ct < 25 then 'warn' else 'info' end, cast(ct as varchar),
  case when ct5 then 'cost threshold for parallelism is the default of 5 - too low'
  when ct < 25 then 'cost threshold for parallelism is ' || cast(ct as varchar) || ' - too low?'
  else 'cost threshold for parallelism is ' || cast(ct as varchar) || ' - sufficient?' end from a
union all select {K}, 'B3.fulltext_crawl', case when not ft then 'info' when cr4 then 'ok' else 'warn' end, cast(cr as varchar),
  case when not ft then 'full-text is not installed; crawl range can be ignored' when cr4 then 'max full-text crawl range is the default of 4'
  else 'max full-text crawl range is ' || cast(cr as varchar) || ' - NOT DEFAULT' end from a""")
def _b3(spark, d):
    return B.config_checks(*rel(spark, d, "config", "instances"))


_COMPAT = ("case compatibility_level when 80 then '2000' when 90 then '2005' when 100 then '2008' when 110 then '2012' "
           "when 120 then '2014' when 130 then '2016' when 140 then '2017' when 150 then '2019' "
           "else cast(compatibility_level as varchar) end")


@case("b4_db_settings", ["databases"], f"""
select {K}, name as database_name, recovery_model_desc, log_reuse_wait_desc, is_encrypted, compatibility_level,
  {_COMPAT} as compat_release, page_verify_option_desc, is_auto_close_on, is_auto_shrink_on, is_auto_update_stats_on,
  is_auto_create_stats_on, is_auto_update_stats_async_on, is_parameterization_forced, snapshot_isolation_state_desc,
  is_read_committed_snapshot_on
from databases where {_LIVE}""")
def _b4(spark, d):
    return B.db_settings(rel(spark, d, "databases"))


def _b5_sql():
    rules = [("B5.encryption", "enc", "Encryption is enabled on %d database(s)", "Encryption verified"),
             ("B5.compat_level", "compat", "Compatibility level below the instance version on %d database(s)",
              "Compatibility level verified"),
             ("B5.page_verify", "pv", "Page verify not CHECKSUM on %d database(s)", "Page verify option verified"),
             ("B5.auto_close", "ac", "Auto Close is enabled on %d database(s)", "Auto Close verified"),
             ("B5.auto_shrink", "ash", "Auto Shrink is enabled on %d database(s)", "Auto Shrink verified"),
             ("B5.auto_update_stats", "aus", "Auto Update Stats is NOT ENABLED on %d database(s)",
              "Auto Update Stats verified")]
    parts = [f"select {K}, '{cid}' as check_id, case when {c} > 0 then 'warn' else 'ok' end as severity, "
             f"cast({c} as varchar) as observed, case when {c} > 0 then printf({_q(bad)}, {c}) else {_q(good)} end as message from a"
             for cid, c, bad, good in rules]
    return f"""
d as (select a.*, cast(split_part(b.product_version, '.', 1) as int) * 10 as inst_compat from databases a
      join instances b on {J} where a.{_LIVE}),
a as (select {K}, count(case when is_encrypted then 1 end) as enc, count(case when compatibility_level < inst_compat then 1 end) as compat,
  count(case when page_verify_option_desc <> 'CHECKSUM' then 1 end) as pv, count(case when is_auto_close_on then 1 end) as ac,
  count(case when is_auto_shrink_on then 1 end) as ash, count(case when not is_auto_update_stats_on then 1 end) as aus
  from d group by all)
""" + "\nunion all ".join(parts)


@case("b5_db_setting_checks", ["databases", "instances"], _b5_sql())
def _b5(spark, d):
    return B.db_setting_checks(*rel(spark, d, "databases", "instances"))


_OWN = f"""
select {K}, 'database' as object_kind, name as object_name, owner_name, cast(null as int) as enabled
  from databases where {_LIVE} and (owner_name is null or owner_name <> 'sa')
union all select {K}, 'job', name, owner_name, cast(enabled as int) from jobs where owner_name <> 'sa'
union all select {K}, 'package', name, owner_name, cast(null as int) from packages where owner_name <> 'sa'"""


@case("b6_owner_listing", ["databases", "jobs", "packages"], _OWN)
def _b6(spark, d):
    return B.owner_listing(*rel(spark, d, "databases", "jobs", "packages"))


def _b7_sql():
    def one(src, cond, kind, cid):
        return (f"select {K}, '{cid}' as check_id, case when n > 0 then 'warn' else 'ok' end as severity, "
                f"cast(n as varchar) as observed, case when n > 0 then printf('Owner not set to sa on %d {kind}(s)', n) "
                f"else '{kind} owners verified' end as message from "
                f"(select {K}, count(case when {cond} then 1 end) as n from {src} group by all)")
    return "\nunion all ".join([
        one(f"(select * from databases where {_LIVE})", "owner_name is null or owner_name <> 'sa'", "database", "B7.database_owner"),
        one("jobs", "owner_name <> 'sa'", "job", "B7.job_owner"),
        one("packages", "owner_name <> 'sa'", "package", "B7.package_owner")])


@case("b7_owner_checks", ["databases", "jobs", "packages"], _b7_sql())
def _b7(spark, d):
    return B.owner_checks(*rel(spark, d, "databases", "jobs", "packages"))


def _flag(tf, extra=""):
    return (f"case when f{tf} = 1 then 'ok' else 'warn' end", f"cast(f{tf} as varchar)",
            f"case when f{tf} = 1 then 'Trace flag {tf} is enabled globally{extra}' else 'Trace flag {tf} is NOT ENABLED globally{extra}' end")


def _b8_sql():
    g = ", ".join(f"max(case when trace_flag = '{t}' and is_global then 1 else 0 end) as f{t}" for t in ("1117", "1118", "3226", "2371"))
    s17, o17, m17 = _flag("1117")
    s18, o18, m18 = _flag("1118")
    s32, o32, m32 = _flag("3226")
    s23, o23, m23 = _flag("2371")
    newlow = "major >= 13 and low = 0"
    return f"""
g as (select {K}, {g} from trace_flags group by all),
l as (select {K}, count(case when compatibility_level < 130 then 1 end) as low from databases where {_LIVE} group by all),
a as (select i.server_name, i.snapshot_id, cast(split_part(i.product_version, '.', 1) as int) as major,
  coalesce(f1117, 0) as f1117, coalesce(f1118, 0) as f1118, coalesce(f3226, 0) as f3226, coalesce(f2371, 0) as f2371,
  coalesce(low, 0) as low
  from instances i left join g on i.server_name = g.server_name and i.snapshot_id = g.snapshot_id
  left join l on i.server_name = l.server_name and i.snapshot_id = l.snapshot_id)
select {K}, 'B8.1117_1118' as check_id, 'info' as severity, cast(major as varchar) as observed,
  'Trace flag 1117 & 1118 check not necessary for this version' as message from a where major >= 13
union all select {K}, 'B8.1117', {s17}, {o17}, {m17} from a where major < 13
union all select {K}, 'B8.1118', {s18}, {o18}, {m18} from a where major < 13
union all select {K}, 'B8.3226', {s32}, {o32}, {m32} from a
union all select {K}, 'B8.2371', case when {newlow} then 'info' else {s23} end,
  case when {newlow} then cast(low as varchar) else {o23} end,
  case when {newlow} then 'Trace flag 2371 check not necessary for this version and compatibility levels'
  when major >= 13 then {m23} || ' - a database is below compatibility level 130' else {m23} end from a"""


@case("b8_trace_flag_checks", ["trace_flags", "instances", "databases"], _b8_sql())
def _b8(spark, d):
    return B.trace_flag_checks(*rel(spark, d, "trace_flags", "instances", "databases"))


@case("b9_service_account_checks", ["services", "instances"], f"""
f as (select {K}, max(instant_file_initialization_enabled) as ifi from services where servicename like 'SQL Server (%' group by all),
a as (select i.server_name, i.snapshot_id, cast(split_part(i.product_version, '.', 1) as int) as major,
  cast(split_part(i.product_version, '.', 3) as bigint) as build, i.memory_model, f.ifi
  from instances i left join f on i.server_name = f.server_name and i.snapshot_id = f.snapshot_id),
b as (select *, major > 13 or (major = 13 and build >= 4001) or (major = 11 and build >= 7001) as okv from a)
select {K}, 'B9.instant_file_init' as check_id, case when not okv then 'info' when ifi = 'Y' then 'ok' else 'warn' end as severity,
  ifi as observed, case when not okv then 'Instant file initialization not verifiable here - check the OS'
  when ifi = 'Y' then 'Instant file initialization is enabled for the service account'
  else 'Instant file initialization is NOT ENABLED for the service account' end as message from b
union all select {K}, 'B9.lock_pages', case when not okv then 'info' when memory_model = 2 then 'ok' else 'warn' end,
  cast(memory_model as varchar), case when not okv then 'Lock pages in memory not verifiable here - check the OS'
  when memory_model = 2 then 'Lock pages in memory is enabled for the service account'
  else 'Lock pages in memory is NOT ENABLED for the service account' end from b""")
def _b9(spark, d):
    return B.service_account_checks(*rel(spark, d, "services", "instances"))


@case("b10_msdb_size_check", ["master_files"], f"""
a as (select {K}, count(case when database_id = 4 and size * 8 // 1024 > 2048 then 1 end) as n from master_files group by all)
select {K}, 'B10.msdb_size' as check_id, case when n > 0 then 'warn' else 'ok' end as severity, cast(n as varchar) as observed,
  case when n > 0 then 'msdb has at least one file greater than 2GB' else 'msdb size verified' end as message from a""")
def _b10(spark, d):
    return B.msdb_size_check(rel(spark, d, "master_files"))


@case("b11_recovery_models", ["databases"], f"""
select {K}, name as database_name, recovery_model_desc from databases where {_LIVE}""")
def _b11(spark, d):
    return B.recovery_models(rel(spark, d, "databases"))


@case("b11_recovery_model_count", ["databases"], f"""
a as (select {K}, count(case when lower(recovery_model_desc) = 'full' then 1 end) as n from databases where {_LIVE} group by all)
select {K}, 'B11.full_recovery' as check_id, 'info' as severity, cast(n as varchar) as observed,
  printf('%d database(s) using the FULL recovery model', n) as message from a""")
def _b11b(spark, d):
    return B.recovery_model_count(rel(spark, d, "databases"))


_MODS = "lower(name) like '%sophos%.dll' or lower(name) like '%swi_ifslsp_64.dll' or lower(name) like '%swi_ifslsp.dll'"


@case("b12_module_listing", ["modules"], f"select {K}, name from modules where {_MODS}")
def _b12(spark, d):
    return B.module_listing(rel(spark, d, "modules"))


@case("b12_module_check", ["modules"], f"""
a as (select {K}, count(case when {_MODS} then 1 end) as n from modules group by all)
select {K}, 'B12.av_modules' as check_id, case when n > 0 then 'warn' else 'ok' end as severity, cast(n as varchar) as observed,
  case when n > 0 then 'Anti-virus modules are loaded into the server process' else 'Anti-virus modules verified - not loaded' end as message from a""")
def _b12b(spark, d):
    return B.module_check(rel(spark, d, "modules"))


# ---------------------------------------------------------------- family D
from .operators import backup as D  # noqa: E402

AS_OF = "2001-08-02 00:00:00"
EV_AS_OF = "2024-02-01 00:00:00"
TS_AS_OF = f"timestamp '{AS_OF}'"
TS_EV = f"timestamp '{EV_AS_OF}'"


@case("d1_backup_history", ["backupset", "backupmediafamily"], f"""
select b.server_name, b.snapshot_id, b.database_name, b.backup_start_date, b.backup_finish_date, b.type,
  b.name as backupset_name, m.physical_device_name, m.logical_device_name
from backupset b join backupmediafamily m on b.server_name = m.server_name and b.snapshot_id = m.snapshot_id
  and b.media_set_id = m.media_set_id
where b.type = 'D'""")
def _d1(spark, d):
    return D.backup_history(*rel(spark, d, "backupset", "backupmediafamily"))


@case("d2_last_backup_location", ["backupset", "backupmediafamily"], f"""
cand as (select m.server_name, m.snapshot_id, m.media_set_id from backupmediafamily m
  where lower(m.physical_device_name) like '%db3%.bak'
  and exists (select 1 from backupset b where b.server_name = m.server_name and b.snapshot_id = m.snapshot_id
              and b.media_set_id = m.media_set_id)),
newest as (select {K}, max(media_set_id) as media_set_id from cand group by all)
select m.server_name, m.snapshot_id, m.media_set_id, m.family_sequence_number, m.physical_device_name
from backupmediafamily m join newest n on m.server_name = n.server_name and m.snapshot_id = n.snapshot_id
  and m.media_set_id = n.media_set_id""")
def _d2(spark, d):
    return D.last_backup_location(*rel(spark, d, "backupset", "backupmediafamily"), database="db3")


def _progress_sql(where):
    return f"""
select r.server_name, r.snapshot_id, r.spid, r.command, t.text as query, r.start_time, r.percent_complete,
  {TS_EV} + to_seconds(r.estimated_completion_time // 1000) as estimated_completion
from requests r join sql_text t on r.server_name = t.server_name and r.snapshot_id = t.snapshot_id and r.sql_handle = t.sql_handle {where}"""


@case("d3_backup_restore_progress", ["requests", "sql_text"],
      _progress_sql("where lower(r.command) in ('backup database', 'restore database')"))
def _d3(spark, d):
    return D.backup_restore_progress(*rel(spark, d, "requests", "sql_text"), as_of=EV_AS_OF)


@case("d4_backup_restore_waits", ["requests"], f"""
select {K}, spid, status, command, wait_type, percent_complete from requests
where lower(command) like '%restore%' or lower(command) like '%backup%'""")
def _d4(spark, d):
    return D.backup_restore_waits(rel(spark, d, "requests"))


@case("d5_request_progress", ["requests", "sql_text"], _progress_sql(""))
def _d5(spark, d):
    return D.request_progress(*rel(spark, d, "requests", "sql_text"), as_of=EV_AS_OF)


_ELIG_LOG = (f"e as (select {K}, name as database_name from databases where {_LIVE} and database_id not in (2, 3) "
             "and recovery_model in (1, 2))")
_JL = ("left join (select * from backupset where type = 'L') b on e.server_name = b.server_name "
       "and e.snapshot_id = b.snapshot_id and e.database_name = b.database_name")


@case("d6_no_log_backup", ["databases", "backupset"], f"""{_ELIG_LOG},
j as (select e.server_name, e.snapshot_id, b.recovery_model as brm, b.backup_finish_date as bf from e {_JL}),
a as (select {K}, count(case when brm is null or bf is null then 1 end) as n from j group by all)
select {K}, 'D6.no_log_backup' as check_id, case when n > 0 then 'warn' else 'ok' end as severity, cast(n as varchar) as observed,
  case when n > 0 then printf('No LOG backup taken on %d database(s)', n) else 'LOG backups verified' end as message from a""")
def _d6(spark, d):
    return D.no_log_backup(*rel(spark, d, "databases", "backupset"))


@case("d7_stale_log_backup", ["databases", "backupset"], f"""{_ELIG_LOG}
select e.server_name, e.snapshot_id, e.database_name, max(b.backup_finish_date) as last_log_backup,
  datediff('day', max(b.backup_finish_date), {TS_AS_OF}) as age_days
from e {_JL} group by all having datediff('day', max(b.backup_finish_date), {TS_AS_OF}) > 1""")
def _d7(spark, d):
    return D.stale_log_backup(*rel(spark, d, "databases", "backupset"), as_of=AS_OF)


_ELIG_FULL = f"e as (select {K}, name as database_name from databases where {_LIVE} and database_id not in (2, 3))"
_JD = _JL.replace("type = 'L'", "type = 'D'")


@case("d8_last_full_backup", ["databases", "backupset"], f"""{_ELIG_FULL}
select e.server_name, e.snapshot_id, e.database_name, max(b.backup_finish_date) as last_full_backup from e {_JD} group by all""")
def _d8(spark, d):
    return D.last_full_backup(*rel(spark, d, "databases", "backupset"))


@case("d9_no_full_backup", ["databases", "backupset"], f"""{_ELIG_FULL},
a as (select e.server_name, e.snapshot_id, count(case when b.backup_finish_date is null then 1 end) as n from e {_JD} group by all)
select {K}, 'D9.no_full_backup' as check_id, case when n > 0 then 'warn' else 'ok' end as severity, cast(n as varchar) as observed,
  case when n > 0 then printf('No FULL backup taken on %d database(s)', n) else 'FULL backups verified' end as message from a""")
def _d9(spark, d):
    return D.no_full_backup(*rel(spark, d, "databases", "backupset"))


_GOOD = (f"g as (select distinct {K}, database_name, value as last_clean from dbinfo "
         "where field = 'dbi_dbccLastKnownGood' and database_name <> 'tempdb')")


@case("d10_integrity_checks", ["dbinfo"], f"""{_GOOD}
select {K}, database_name, last_clean, case when last_clean = timestamp '1900-01-01 00:00:00' then 'Never ran DBCC CHECKDB'
  else strftime(last_clean, '%Y-%m-%d %H:%M:%S') end as last_clean_text from g""")
def _d10(spark, d):
    return D.integrity_checks(rel(spark, d, "dbinfo"))


@case("d11_never_checked", ["dbinfo"], f"""{_GOOD},
a as (select {K}, count(case when last_clean = timestamp '1900-01-01 00:00:00' then 1 end) as n from g group by all)
select {K}, 'D11.never_checked' as check_id, case when n > 0 then 'warn' else 'ok' end as severity, cast(n as varchar) as observed,
  case when n > 0 then printf('No integrity check has been run on %d database(s)', n) else 'Integrity checks verified' end as message from a""")
def _d11(spark, d):
    return D.never_checked(rel(spark, d, "dbinfo"))


_STALE = (f"s as (select {K}, database_name, last_clean, datediff('day', last_clean, {TS_AS_OF}) as age_days from g "
          f"where last_clean > timestamp '1900-01-01 00:00:00' and datediff('day', last_clean, {TS_AS_OF}) > 7)")


@case("d12_stale_integrity", ["dbinfo"], f"{_GOOD}, {_STALE} select * from s")
def _d12(spark, d):
    return D.stale_integrity(rel(spark, d, "dbinfo"), as_of=AS_OF)


@case("d12_stale_integrity_count", ["dbinfo"], f"""{_GOOD}, {_STALE},
a as (select {K}, count(*) as n from s group by all)
select {K}, 'D12.stale_integrity' as check_id, 'warn' as severity, cast(n as varchar) as observed,
  printf('Most recent integrity check on %d database(s) is older than %d days', n, 7) as message from a""")
def _d12b(spark, d):
    return D.stale_integrity_count(rel(spark, d, "dbinfo"), as_of=AS_OF)


@case("d13_backup_plan", ["databases"], f"""
select {K}, name as database_name, 'D:/Backup/' || name || '_' || strftime({TS_AS_OF}, '%Y%m%d') || '.BAK' as backup_file
from databases where lower(name) not in ('master', 'model', 'msdb', 'tempdb')""")
def _d13(spark, d):
    return D.backup_plan(rel(spark, d, "databases"), "D:/Backup/", AS_OF)


# ---------------------------------------------------------------- family E
from .operators import session as E  # noqa: E402


def _tsub(text, start, length):
    """T-SQL SUBSTRING in DuckDB: keep positions start .. start+length-1."""
    first = f"greatest({start}, 1)"
    n = f"(({start}) + ({length}) - 1 - {first} + 1)"
    return f"case when {n} <= 0 then '' else substr({text}, {first}, {n}) end"


_FULL = "length(rtrim(text, ' ')) * 2"


@case("e1_active_sessions", ["sessions", "requests", "sql_text", "databases", "jobs"], f"""
req as (select {K}, spid as session_id, status as req_status, blocked as blocked_by, command, dbid as database_id,
  percent_complete, start_time, estimated_completion_time, sql_handle, statement_start_offset as s0,
  statement_end_offset as e0, waittime, wait_type as last_wait_type, open_tran as open_transaction_count,
  isolation_level, cpu, wait_resource from requests),
rt as (select req.*, t.text, t.object_id as objectid from req left join sql_text t on req.server_name = t.server_name
  and req.snapshot_id = t.snapshot_id and req.sql_handle = t.sql_handle),
ses as (select {K}, session_id, loginame as original_login_name, login_time, host_name, program_name,
  last_request_start_time, last_request_end_time, reads, writes, logical_reads, lock_timeout, row_count
  from sessions where lower(status) <> 'sleeping'),
j as (select s.*, r.* exclude (server_name, snapshot_id, session_id) from ses s left join rt r
  on s.server_name = r.server_name and s.snapshot_id = r.snapshot_id and s.session_id = r.session_id),
j2 as (select j.*, d.name as database_name, jb.name as job_name,
  datediff('minute', start_time, {TS_EV}) as mi, datediff('second', start_time, {TS_EV}) as ss,
  case when e0 < 0 then {_FULL} else e0 end as e1
  from j left join databases d on j.server_name = d.server_name and j.snapshot_id = d.snapshot_id and j.database_id = d.database_id
  left join jobs jb on jb.server_name = j.server_name and jb.snapshot_id = j.snapshot_id
    and upper(jb.job_hex) = case when j.program_name like 'SQLAgent%Job%' then upper(substr(j.program_name, 30, 34)) end)
select {K}, session_id, original_login_name, req_status as status, blocked_by, command, database_name, percent_complete,
  case when mi > 60 then cast(mi // 60 as varchar) || ' hr ' else '' end
    || case when ss > 60 then cast(mi % 60 as varchar) || ' min ' else '' end || cast(ss % 60 as varchar) || ' sec' as duration,
  estimated_completion_time // 60000 as eta_min, text,
  {_tsub('text', 's0 // 2 + 1', '(e1 - s0) // 2 + 1')} as running_statement,
  waittime // 1000 as wait_time_sec, last_wait_type, login_time, host_name,
  case when program_name like 'SQLAgent%Job%'
    then '(SQLAgent Job - ' || job_name || ' - ' || right(program_name, length(program_name) - instr(program_name, ':'))
    else program_name end as program_name,
  open_transaction_count,
  case isolation_level when 0 then 'Unspecified' when 1 then 'ReadUncomitted' when 2 then 'ReadCommitted'
    when 3 then 'Repeatable' when 4 then 'Serializable' when 5 then 'Snapshot' end as transaction_isolation_level, cpu, objectid, wait_resource, last_request_start_time, last_request_end_time,
  reads, writes, logical_reads, lock_timeout, row_count
from j2""")
def _e1(spark, d):
    return E.active_sessions(*rel(spark, d, "sessions", "requests", "sql_text", "databases", "jobs"), as_of=EV_AS_OF)


@case("e2_lead_blockers", ["processes", "requests", "sql_text", "databases"], f"""
bl as (select distinct {K}, blocked as spid from processes),
lead as (select p.* from processes p where p.blocked = 0 and exists (select 1 from bl where bl.server_name = p.server_name
  and bl.snapshot_id = p.snapshot_id and bl.spid = p.spid)),
er as (select r.server_name, r.snapshot_id, r.spid, r.statement_start_offset as s0, r.statement_end_offset as e0, t.text
  from requests r left join sql_text t on r.server_name = t.server_name and r.snapshot_id = t.snapshot_id and r.sql_handle = t.sql_handle),
j as (select l.*, er.s0, er.e0, er.text, d.name as dn,
  case when er.e0 = -1 then {_FULL.replace('text', 'er.text')} else er.e0 end as e1
  from lead l left join er on l.server_name = er.server_name and l.snapshot_id = er.snapshot_id and l.spid = er.spid
  left join databases d on l.server_name = d.server_name and l.snapshot_id = d.snapshot_id and l.dbid = d.database_id)
select {K}, spid, status, substr(loginame, 1, 12) as loginame, substr(hostname, 1, 12) as hostname,
  rpad(cast(blocked as varchar), 3, ' ') as blk, open_tran, substr(dn, 1, 10) as dbname, command as cmd, waittype, waittime,
  last_batch, {_tsub('text', 's0 // 2', '(e1 - s0) // 2')} as sql_statement
from j""")
def _e2(spark, d):
    return E.lead_blockers(*rel(spark, d, "processes", "requests", "sql_text", "databases"))


@case("e3_rolling_back", ["processes"], f"""
select {K}, spid, kpid, login_time, last_batch, status, hostname, loginame, cpu, physical_io, nt_username, hostprocess, memusage
from processes where lower(command) = 'killed/rollback'""")
def _e3(spark, d):
    return E.rolling_back(rel(spark, d, "processes"))


@case("e4_sessions_in_database", ["processes", "databases"], f"""
a as (select {K}, dbid, min(spid) as min_spid, count(*) as session_count from processes group by all)
select a.server_name, a.snapshot_id, b.name as database_name, min_spid, session_count
from a join databases b on {J} and a.dbid = b.database_id""")
def _e4(spark, d):
    return E.sessions_in_database(*rel(spark, d, "processes", "databases"))


# ---------------------------------------------------------------- family F
from .operators import wait as W  # noqa: E402

# Fixed values, written out anew (not taken from the operator): the reviewed wait types in the order listed.
_WAIT_TYPES = """
SETTINGS OR CODE; parallelism waits; review max degree of parallelism and cost threshold
  CXPACKET
CPU; schedulers yielding; check runnable task counts per scheduler
  SOS_SCHEDULER_YIELD
NETWORK; client is slow to consume results or the network is slow
  ASYNC_NETWORK_IO
LOCK; sessions waiting on locks or latches; look for blocking chains
  LCK_M_BU LCK_M_IS LCK_M_IU LCK_M_IX LCK_M_RIn_NL LCK_M_RIn_S LCK_M_RIn_U LCK_M_RIn_X LCK_M_RS_S LCK_M_RS_U LCK_M_RX_S LCK_M_RX_U LCK_M_RX_X
  LCK_M_S LCK_M_SCH_M LCK_M_SCH_S LCK_M_SIU LCK_M_SIX LCK_M_U LCK_M_UIX LCK_M_X LATCH_DT LATCH_EX LATCH_KP LATCH_SH LATCH_UP
MEMORY; waiting on memory grants, compile throttles or log flushes
  RESOURCE_SEMAPHORE RESOURCE_SEMAPHORE_MUTEX RESOURCE_SEMAPHORE_QUERY_COMPILE RESOURCE_SEMAPHORE_SMALL_QUERY WRITELOG
DISK; waiting on data or log I/O; check drive latency
  PAGEIOLATCH_DT PAGEIOLATCH_EX PAGEIOLATCH_KP PAGEIOLATCH_SH PAGEIOLATCH_UP PAGELATCH_DT PAGELATCH_EX PAGELATCH_KP PAGELATCH_SH PAGELATCH_UP
  LOGBUFFER ASYNC_IO_COMPLETION IO_COMPLETION
AOAG; availability-group data movement or redo is falling behind
  HADR_SYNC_COMMIT PARALLEL_REDO_FLOW_CONTROL PARALLEL_REDO_TRAN_TURN DIRTY_PAGE_TABLE_LOCK DPT_ENTRY_LOCK
"""


def _wait_rows():
    category = hint = None
    for line in _WAIT_TYPES.strip().split("\n"):
        if line[0] != " ":
            category, _, hint = line.partition("; ")
        else:
            yield from ((w, category, hint) for w in line.split())


_WDIM = "(values " + ", ".join(f"('{w}', '{c}', {_q(h)}, {i})" for i, (w, c, h) in enumerate(_wait_rows())) + ") as d(wait_type, category, comment, list_order)"
_WAITS = f"""
w as (select ws.*, d.category, d.comment, d.list_order from wait_stats ws join {_WDIM} on ws.wait_type = d.wait_type),
p as (select *, cast(100.0 * wait_time_ms / sum(wait_time_ms) over (partition by {K}) as decimal(5,2)) as percentage,
  row_number() over (partition by {K} order by wait_time_ms desc, list_order) as rn from w),
t as (select {K}, wait_type, waiting_tasks_count, cast(cast(wait_time_ms as decimal(20,0)) * 0.001 as decimal(18,2)) as wait_s,
  cast(cast(wait_time_ms - signal_wait_time_ms as decimal(20,0)) * 0.001 as decimal(18,2)) as resource_s,
  cast(cast(signal_wait_time_ms as decimal(20,0)) * 0.001 as decimal(18,2)) as signal_s, percentage, rn, category, comment from p where rn <= 10)"""


@case("f1_wait_stats", ["wait_stats"], f"{_WAITS} select * from t where waiting_tasks_count <> 0")
def _f1(spark, d):
    return W.wait_listing(spark, rel(spark, d, "wait_stats"))


@case("f3_top_waits", ["wait_stats"], f"""{_WAITS}
select {K}, rn, wait_type, percentage, cast(percentage as varchar) || '% for ' || wait_type as line from t where rn <= 3""")
def _f3(spark, d):
    return W.top_waits(spark, rel(spark, d, "wait_stats"))


# ---------------------------------------------------------------- family I
from .operators import job as I  # noqa: E402

_JOBPAT = " or ".join(f"lower(name) like '{p}'" for p in ("%full%", "%bkp%", "%dba%", "%backup%", "%diff%", "%log%", "%bkup%"))


@case("i1_maintenance_job_steps", ["jobs", "job_steps"], f"""
select j.server_name, j.snapshot_id, j.name as job_name, j.enabled, s.step_name, s.step_id, s.retry_attempts, s.retry_interval
from jobs j join job_steps s on j.server_name = s.server_name and j.snapshot_id = s.snapshot_id and j.job_id = s.job_id
where {_JOBPAT.replace('lower(name)', 'lower(j.name)')}""")
def _i1(spark, d):
    return I.maintenance_job_steps(*rel(spark, d, "jobs", "job_steps"))


# ---------------------------------------------------------------- family G
from .operators import index as G  # noqa: E402

_G1 = f"""
g1a as (select {K}, database_id, sum(num_of_writes) as w from io_file_stats group by all),
g1j as (select a.server_name, a.snapshot_id, b.name as database_name, cast(w as bigint) as num_of_writes
  from g1a a join databases b on {J} and a.database_id = b.database_id
  where b.source_database_id is null and b.database_id > 4 and b.state = 0),
g1 as (select * from (select *, row_number() over (partition by {K} order by num_of_writes desc, database_name) as rn
  from g1j) where rn = 1)"""


@case("g1_busiest_write_database", ["io_file_stats", "databases"], f"""{_G1}
select {K}, database_name, num_of_writes, {money('num_of_writes')} as num_of_writes_text from g1""")
def _g1(spark, d):
    return G.busiest_write_database(*rel(spark, d, "io_file_stats", "databases"))


def _g2_sql(scoped):
    scope = (" and exists (select 1 from g1 where g1.server_name = p.server_name and g1.snapshot_id = p.snapshot_id "
             "and g1.database_name = p.database_name)") if scoped else ""
    pre = _G1 + "," if scoped else ""
    return f"""{pre}
p0 as (select * from index_physical p where page_count >= 1000 and lower(index_type_desc) <> 'heap'{scope})
select p.server_name, p.snapshot_id, p.database_name, s.name as schema_name, o.name as table_name, p.object_id, i.name as index_name,
  p.index_type_desc, p.alloc_unit_type_desc, p.index_depth, p.fragmentation_pct, p.fragment_count, p.avg_fragment_size_in_pages,
  p.page_count, p.avg_page_space_used_pct, p.record_count, p.compressed_page_count, i.fill_factor
from p0 p join indexes i on p.server_name = i.server_name and p.snapshot_id = i.snapshot_id
  and p.database_name = i.database_name and p.object_id = i.object_id and p.index_id = i.index_id
left join objects o on p.server_name = o.server_name and p.snapshot_id = o.snapshot_id and p.database_name = o.database_name
  and p.object_id = o.object_id
left join schemas s on p.server_name = s.server_name and p.snapshot_id = s.snapshot_id and p.database_name = s.database_name
  and o.schema_id = s.schema_id"""


@case("g2_index_fragmentation", ["index_physical", "indexes", "objects", "schemas"], _g2_sql(False))
def _g2(spark, d):
    return G.index_fragmentation(*rel(spark, d, "index_physical", "indexes", "objects", "schemas"))


@case("g2_index_fragmentation_busiest_db", ["index_physical", "indexes", "objects", "schemas", "io_file_stats", "databases"], _g2_sql(True))
def _g2b(spark, d):
    io, dbs = rel(spark, d, "io_file_stats", "databases")
    return G.index_fragmentation(*rel(spark, d, "index_physical", "indexes", "objects", "schemas"),
                                 scope=G.busiest_write_database(io, dbs))


@case("g3_statistics_dates", ["statistics", "objects"], f"""
select t.server_name, t.snapshot_id, t.database_name, t.object_id, o.name as object_name, t.name as statistic_name, t.updated as last_updated
from statistics t left join objects o on t.server_name = o.server_name and t.snapshot_id = o.snapshot_id
  and t.database_name = o.database_name and t.object_id = o.object_id
where lower(t.database_name) not in ('master', 'model', 'msdb', 'tempdb')""")
def _g3(spark, d):
    return G.statistics_dates(*rel(spark, d, "statistics", "objects"))


@case("g4_missing_indexes", ["missing_index_groups", "missing_index_group_stats", "missing_index_details"], f"""
select g.server_name, g.snapshot_id,
  {money('avg_total_user_cost * avg_user_impact / 100 * (user_seeks + user_scans)')} as improvement_measure,
  d.statement as table_path, avg_total_user_cost, avg_user_impact, user_seeks, user_scans, last_user_seek, d.database_id, d.object_id,
  index_group_handle, g.index_handle,
  'CREATE INDEX IX_MI_' || d.object_name || '_' || cast(index_group_handle as varchar) || '_' || cast(g.index_handle as varchar)
  || ' ON ' || d.statement || ' (' || coalesce(equality_columns, '')
  || case when equality_columns is not null and inequality_columns is not null then ',' else '' end
  || coalesce(inequality_columns, '') || ')' || coalesce(' INCLUDE (' || included_columns || ')', '') as create_index_statement
from missing_index_groups g
join missing_index_group_stats st on g.server_name = st.server_name and g.snapshot_id = st.snapshot_id and st.group_handle = g.index_group_handle
join missing_index_details d on g.server_name = d.server_name and g.snapshot_id = d.snapshot_id and g.index_handle = d.index_handle
where avg_total_user_cost * (avg_user_impact / 100.0) * (user_seeks + user_scans) > 10000""")
def _g4(spark, d):
    return G.missing_indexes(*rel(spark, d, "missing_index_groups", "missing_index_group_stats", "missing_index_details"))


def _cl(c, chars):
    for ch in chars:
        c = f"replace({c}, '{ch}', '')"
    return c


# The expected statements come from the order rows that the plans were written from, not from their XML.
@case("g5_missing_indexes_from_plans", ["cached_plans"], f"""
p as (select c.server_name, c.snapshot_id, c.usecounts, c.query_plan, o_orderkey as o, o_custkey as c
  from cached_plans c join orders on plan_handle = o_orderkey where usecounts > 100),
x as (
  select {K}, usecounts, query_plan, '[d]' as database_name, '[s]' as schema_name, '[t' || cast(c % 50 as varchar) || ']' as table_name,
    cast(c % 100 as double) as impact,
    '[c' || cast(c % 4 as varchar) || '], [e' || cast(o % 3 as varchar) || ']' || case when o % 7 = 4 then ', [z]' else '' end as equality_columns,
    '[i' || cast(c % 2 as varchar) || ']' as inequality_columns,
    case when o % 3 = 0 then '[n' || cast(c % 5 as varchar) || ']' end as include_columns,
    'q' || cast(o as varchar) as sql_text, false as nested
  from p where o % 5 <> 0
  union all
  select {K}, usecounts, query_plan, '[d]', '[s]', '[in]', 7.0, null, null, '[y]', 'inner' || cast(o as varchar), true from p where o % 7 = 3),
y as (select *, sum(usecounts) over (partition by {K}, database_name, schema_name, table_name) as table_uses,
  sum(usecounts) over (partition by {K}, table_name, equality_columns, inequality_columns) as pattern_uses,
  coalesce(',' || equality_columns, '') || coalesce(',' || inequality_columns, '') as cols from x)
select {K}, database_name, schema_name, table_name, equality_columns, inequality_columns, include_columns, usecounts,
  impact, sql_text, nested, cast(table_uses as bigint) as table_uses, cast(pattern_uses as bigint) as pattern_uses,
  'CREATE NONCLUSTERED INDEX IX_' || {_cl('schema_name', '_[]')} || '_' || {_cl('table_name', '_[]')} || '_'
  || coalesce({_cl('equality_columns', '_[], ')}, '') || coalesce({_cl("coalesce(inequality_columns, '')", '_[], ')}, '')
  || ' ON ' || schema_name || '.' || table_name || '(' || case when length(cols) > 0 then substr(cols, 2) end || ')'
  || coalesce(' INCLUDE (' || include_columns || ')', '') as potential_ddl, query_plan
from y""")
def _g5(spark, d):
    return G.missing_indexes_from_plans(rel(spark, d, "cached_plans"))


_KDO = "and {a}.server_name = {b}.server_name and {a}.snapshot_id = {b}.snapshot_id and {a}.database_name = {b}.database_name"


def _kdo(a, b):
    return _KDO.format(a=a, b=b)[4:]


@case("g6_unused_indexes", ["index_usage", "indexes", "objects", "schemas"], f"""
select u.server_name, u.snapshot_id, u.database_name, o.name as object_name, u.object_id, i.name as index_name, u.index_id,
  cast(u.user_seeks as bigint) as user_seeks, cast(u.user_scans as bigint) as user_scans,
  cast(u.user_lookups as bigint) as user_lookups, u.user_updates,
  'DROP INDEX ' || s.name || '.' || o.name || '.' || i.name || ';' as delete_statement
from index_usage u
join indexes i on {_kdo('u', 'i')} and u.object_id = i.object_id and u.index_id = i.index_id
  and i.name is not null and not i.is_primary_key and not i.is_unique_constraint and i.type_desc <> 'CLUSTERED'
join objects o on {_kdo('u', 'o')} and u.object_id = o.object_id and o.type = 'U'
left join schemas s on {_kdo('o', 's')} and s.schema_id = o.schema_id
where u.user_seeks + u.user_scans + u.user_lookups = 0""")
def _g6(spark, d):
    return G.unused_indexes(*rel(spark, d, "index_usage", "indexes", "objects", "schemas"))


@case("g7_duplicate_indexes", ["indexes", "index_keys", "objects", "schemas"], f"""
ik as (select {K}, database_name, object_id, index_id,
  coalesce(string_agg(cast(colid as varchar), ' ' order by keyno, colid) filter (where keyno <> 0), '') as cols,
  coalesce(string_agg(cast(colid as varchar), ' ' order by colid) filter (where keyno = 0), '') as inc
  from index_keys group by all),
li as (select i.server_name, i.snapshot_id, i.database_name, i.object_id, i.index_id, i.name, i.is_unique, ik.cols, ik.inc
  from indexes i join ik on {_kdo('i', 'ik')} and i.object_id = ik.object_id and i.index_id = ik.index_id
  where not i.is_hypothetical and lower(i.database_name) not in ('master', 'model', 'msdb', 'tempdb')),
fi as (select {K}, database_name, object_id, cols, inc, is_unique, arg_min(name, index_id) as index_name,
  min(index_id) as first_id from li group by all),
d as (select li.*, fi.index_name from li join fi on {_kdo('li', 'fi')} and li.object_id = fi.object_id
  and li.cols = fi.cols and li.inc = fi.inc and li.is_unique = fi.is_unique where li.index_id > fi.first_id)
select d.server_name, d.snapshot_id, d.database_name, d.object_id, s.name || '.' || o.name as table_name, d.index_name,
  d.name as exact_duplicate
from d left join objects o on {_kdo('d', 'o')} and d.object_id = o.object_id
left join schemas s on {_kdo('o', 's')} and s.schema_id = o.schema_id""")
def _g7(spark, d):
    return G.duplicate_indexes(*rel(spark, d, "indexes", "index_keys", "objects", "schemas"))


@case("g8_hypothetical_indexes", ["indexes", "objects", "schemas"], f"""
j as (select i.server_name, i.snapshot_id, i.database_name, i.name as index_name,
  '[' || s.name || '].[' || o.name || ']' as table_name
  from indexes i join objects o on {_kdo('i', 'o')} and i.object_id = o.object_id
  left join schemas s on {_kdo('o', 's')} and s.schema_id = o.schema_id where i.is_hypothetical)
select {K}, database_name, index_name, table_name,
  'USE [' || database_name || ']; IF EXISTS (SELECT 1 FROM sys.indexes AS i WHERE i.[object_id] = object_id(''' || table_name
  || ''') AND name = ''' || index_name || ''') DROP INDEX [' || index_name || '] ON ' || table_name || ';' as drop_script
from j""")
def _g8(spark, d):
    return G.hypothetical_indexes(*rel(spark, d, "indexes", "objects", "schemas"))


_PJ = ("from cached_plans cp join query_stats qs on cp.server_name = qs.server_name and cp.snapshot_id = qs.snapshot_id "
       "and cp.plan_handle = qs.plan_handle where cp.db_name is not null and lower(cp.objtype) = 'proc'")
_PG = "cp.server_name, cp.snapshot_id, db_name, schema_name, proc_name"


@case("g9_procedure_cpu", ["cached_plans", "query_stats"], f"""
a as (select {_PG}, max(usecounts) as execution_count, cast(sum(total_worker_time) as bigint) as total_cpu_time {_PJ} group by all)
select *, cast(total_cpu_time as double) / execution_count as avg_cpu_time from a""")
def _g9(spark, d):
    return G.procedure_cpu(*rel(spark, d, "cached_plans", "query_stats"))


@case("g10_procedure_io", ["cached_plans", "query_stats"], f"""
a as (select {_PG}, max(usecounts) as execution_count, cast(sum(total_physical_reads) as bigint) as total_physical_reads,
  cast(sum(total_logical_reads) as bigint) as total_logical_reads, cast(sum(total_logical_writes) as bigint) as total_logical_writes
  {_PJ} group by all)
select server_name, snapshot_id, db_name, schema_name, proc_name, execution_count,
  total_physical_reads + total_logical_reads + total_logical_writes as total_io,
  (total_physical_reads + total_logical_reads + total_logical_writes) // execution_count as avg_total_io,
  total_physical_reads, cast(total_physical_reads as double) / execution_count as avg_physical_read,
  total_logical_reads, cast(total_logical_reads as double) / execution_count as avg_logical_read,
  total_logical_writes, cast(total_logical_writes as double) / execution_count as avg_logical_writes from a""")
def _g10(spark, d):
    return G.procedure_io(*rel(spark, d, "cached_plans", "query_stats"))


@case("g11_procedure_elapsed", ["cached_plans", "query_stats"], f"""
a as (select {_PG}, max(usecounts) as execution_count, cast(sum(total_elapsed_time) as bigint) as total_elapsed_time
  {_PJ} group by all)
select *, total_elapsed_time // execution_count as avg_elapsed_time from a""")
def _g11(spark, d):
    return G.procedure_elapsed(*rel(spark, d, "cached_plans", "query_stats"))


# ---------------------------------------------------------------- family H
from .operators import ha as H  # noqa: E402


@case("h1_ag_replicas", ["replica_states", "availability_groups", "replicas", "databases"], f"""
select rs.server_name, rs.snapshot_id, d.name as database_name, g.group_name, r.replica_server_name, rs.is_primary_replica,
  rs.synchronization_state_desc, rs.synchronization_health_desc, r.availability_mode_desc,
  rs.is_local, rs.is_commit_participant, rs.database_state_desc, rs.is_suspended, rs.suspend_reason_desc
from replica_states rs
join availability_groups g on rs.server_name = g.server_name and rs.snapshot_id = g.snapshot_id and rs.group_id = g.group_id
join replicas r on rs.server_name = r.server_name and rs.snapshot_id = r.snapshot_id and rs.replica_id = r.replica_id
left join databases d on rs.server_name = d.server_name and rs.snapshot_id = d.snapshot_id and rs.database_id = d.database_id""")
def _h1(spark, d):
    return H.ag_replicas(*rel(spark, d, "replica_states", "availability_groups", "replicas", "databases"))


@case("h2_ag_health", ["availability_groups"], f"""
a as (select {K}, count(case when lower(synchronization_health_desc) <> 'healthy' then 1 end) as n
  from availability_groups group by all)
select {K}, 'H2.ag_health' as check_id, case when n > 0 then 'warn' else 'ok' end as severity, cast(n as varchar) as observed,
  case when n > 0 then printf('%d availability group(s) not healthy', n) else 'Availability groups healthy' end as message
from a""")
def _h2(spark, d):
    return H.ag_health(rel(spark, d, "availability_groups"))


@case("h3_ag_state_changes", ["xe_events"], f"""
select {K}, object_name,
  try_cast(regexp_extract(event_data, '<event timestamp="([^"]*)"', 1) as timestamp) + interval (-5) hour as event_timestamp,
  nullif(regexp_extract(event_data, '<data name="availability_group_name"><value>([^<]*)</value>', 1), '') as ag_name,
  nullif(regexp_extract(event_data, '<data name="previous_state"><text>([^<]*)</text>', 1), '') as previous_state,
  nullif(regexp_extract(event_data, '<data name="current_state"><text>([^<]*)</text>', 1), '') as current_state
from xe_events where object_name = 'availability_replica_state_change'""")
def _h3(spark, d):
    return H.ag_state_changes(rel(spark, d, "xe_events"), utc_offset_hours=-5)


# ---------------------------------------------------------------- family J
from .operators import security as S  # noqa: E402

_UNIV = f"univ as (select distinct {K}, database_name from principals)"


def _none(section, text, rows="rows"):
    return (f"select u.server_name, u.snapshot_id, u.database_name, '{section}' as section, 'info' as severity, "
            f"cast(null as varchar) as principal_name, cast(null as varchar) as object_name, '{text}' as statement "
            f"from univ u where not exists (select 1 from {rows} r where r.server_name = u.server_name "
            "and r.snapshot_id = u.snapshot_id and r.database_name = u.database_name)")


def _qn(x):
    return f"'[' || replace({x}, ']', ']]') || ']'"


def _cat(*parts):
    return "concat(" + ", ".join(parts) + ")"


_STATE = ("case state when 'G' then 'GRANT' when 'D' then 'DENY' when 'W' then 'GRANT_WITH_GRANT_OPTION' "
          "when 'R' then 'REVOKE' end")


@case("j1_script_certificates", ["certificates", "principals"], f"""{_UNIV},
rows as (select {K}, database_name, 'certificates' as section, 'info' as severity, cast(null as varchar) as principal_name,
  name as object_name, 'CREATE CERTIFICATE ' || name || ' ENCRYPTION BY PASSWORD = ''<password>'' WITH SUBJECT = '''
  || issuer_name || ''', EXPIRY_DATE = ''' || strftime(expiry_date, '%Y-%m-%d %H:%M:%S') || '''' as statement
  from certificates)
select * from rows union all {_none('certificates', '/*No certificates found*/')}""")
def _j1(spark, d):
    certs, pr = rel(spark, d, "certificates", "principals")
    return S.script_certificates(certs, universe=S.database_universe(pr))


@case("j2_script_users", ["principals", "logins"], f"""{_UNIV},
j as (select p.*, l.name as login_name from principals p left join logins l on p.server_name = l.server_name
  and p.snapshot_id = l.snapshot_id and p.sid = l.sid where p.type in ('U', 'G', 'S') and p.principal_id > 4),
rows as (select {K}, database_name, 'users' as section, 'info' as severity, name as principal_name,
  cast(null as varchar) as object_name,
  {_cat("'IF (SELECT name FROM sys.database_principals WHERE name = '''", 'name', "''') IS NULL'", 'chr(10)', "'BEGIN'",
        'chr(10)', "'CREATE USER '", _qn('name'),
        "case when login_name is null then ' WITHOUT LOGIN' else ' FOR LOGIN ' || " + _qn('login_name') + " end",
        "case when default_schema_name is null and type <> 'G' then ' WITH DEFAULT_SCHEMA = [dbo]' "
        "else concat(' WITH DEFAULT_SCHEMA = [', default_schema_name, ']') end", 'chr(10)', "'END'")} as statement from j)
select * from rows union all {_none('users', '/*No database users found*/')}""")
def _j2(spark, d):
    pr, lg = rel(spark, d, "principals", "logins")
    return S.script_users(pr, lg, universe=S.database_universe(pr))


@case("j3_script_certificate_users", ["principals", "certificates"], f"""{_UNIV},
rows as (select p.server_name, p.snapshot_id, p.database_name, 'certificate_users' as section, 'info' as severity,
  p.name as principal_name, c.name as object_name, concat('CREATE USER ', {_qn('p.name')}, ' FOR CERTIFICATE ', c.name) as statement
  from principals p join certificates c on p.server_name = c.server_name and p.snapshot_id = c.snapshot_id
  and p.database_name = c.database_name and p.sid = c.sid where p.type = 'C' and p.principal_id > 4)
select * from rows union all {_none('certificate_users', '/*No certificated users found*/')}""")
def _j3(spark, d):
    pr, certs = rel(spark, d, "principals", "certificates")
    return S.script_certificate_users(pr, certs, universe=S.database_universe(pr))


@case("j4_script_schema_permissions", ["permissions", "schemas", "principals"], f"""
select p.server_name, p.snapshot_id, p.database_name, 'schema_permissions' as section, 'info' as severity,
  g.name as principal_name, s.name as object_name,
  concat({_STATE.replace('case state', 'case p.state')}, ' ', p.permission_name, ' ON SCHEMA::', {_qn('s.name')},
         ' TO ', {_qn('g.name')}, ' AS ', {_qn('o.name')}) as statement
from permissions p
join schemas s on p.server_name = s.server_name and p.snapshot_id = s.snapshot_id and p.database_name = s.database_name
  and p.major_id = s.schema_id
join principals g on p.server_name = g.server_name and p.snapshot_id = g.snapshot_id and p.database_name = g.database_name
  and p.grantee_principal_id = g.principal_id
join principals o on p.server_name = o.server_name and p.snapshot_id = o.snapshot_id and p.database_name = o.database_name
  and p.grantor_principal_id = o.principal_id
where p.class = 3""")
def _j4(spark, d):
    return S.script_schema_permissions(*rel(spark, d, "permissions", "schemas", "principals"))


@case("j5_script_roles", ["principals"], f"""{_UNIV},
rows as (select r.server_name, r.snapshot_id, r.database_name, 'roles' as section, 'info' as severity, r.name as principal_name,
  cast(null as varchar) as object_name, concat('CREATE ROLE ', {_qn('r.name')}, ' AUTHORIZATION ', {_qn('o.name')}) as statement
  from principals r join principals o on r.server_name = o.server_name and r.snapshot_id = o.snapshot_id
  and r.database_name = o.database_name and r.owning_principal_id = o.principal_id
  where r.type = 'R' and not r.is_fixed_role and r.principal_id > 4)
select * from rows union all {_none('roles', '/*No database roles found*/')}""")
def _j5(spark, d):
    pr = rel(spark, d, "principals")
    return S.script_roles(pr, universe=S.database_universe(pr))


@case("j6_script_app_roles", ["principals"], f"""{_UNIV},
rows as (select {K}, database_name, 'application_roles' as section, 'info' as severity, name as principal_name,
  cast(null as varchar) as object_name,
  concat('CREATE APPLICATION ROLE ', name, ' WITH DEFAULT_SCHEMA = ', {_qn('default_schema_name')}, ', PASSWORD = N''<password>''') as statement
  from principals where type = 'A' and not is_fixed_role and principal_id > 4)
select * from rows union all {_none('application_roles', '/*No application roles found*/')}""")
def _j6(spark, d):
    pr = rel(spark, d, "principals")
    return S.script_app_roles(pr, universe=S.database_universe(pr))


_MEM = """
mem as (select m.server_name, m.snapshot_id, m.database_name, m.member_principal_id, mp.name as member_name, mp.type as member_type,
  rp.name as role_name from role_members m
  join principals mp on m.server_name = mp.server_name and m.snapshot_id = mp.snapshot_id and m.database_name = mp.database_name
    and m.member_principal_id = mp.principal_id
  join principals rp on m.server_name = rp.server_name and m.snapshot_id = rp.snapshot_id and m.database_name = rp.database_name
    and m.role_principal_id = rp.principal_id)"""


def _mem_case(section, where, text):
    return f"""{_UNIV}, {_MEM},
rows as (select {K}, database_name, '{section}' as section, 'info' as severity, member_name as principal_name,
  role_name as object_name, concat('EXEC sp_addrolemember ''', role_name, ''', ''', member_name, '''') as statement
  from mem where {where})
select * from rows union all {_none(section, text)}"""


@case("j7_script_nested_roles", ["principals", "role_members"],
      _mem_case("nested_roles", "member_type = 'R'", "/*No nested roles found*/"))
def _j7(spark, d):
    pr, m = rel(spark, d, "principals", "role_members")
    return S.script_nested_roles(pr, m, universe=S.database_universe(pr))


@case("j8_script_database_grants", ["permissions", "principals"], f"""{_UNIV},
rows as (select p.server_name, p.snapshot_id, p.database_name, 'database_grants' as section, 'info' as severity,
  g.name as principal_name, cast(null as varchar) as object_name,
  concat({_STATE.replace('case state', 'case p.state')}, ' ', p.permission_name, ' TO ', {_qn('g.name')}) as statement
  from permissions p join principals g on p.server_name = g.server_name and p.snapshot_id = g.snapshot_id
  and p.database_name = g.database_name and p.grantee_principal_id = g.principal_id
  where p.class = 0 and g.principal_id > 4)
select * from rows union all {_none('database_grants', '/*No database connection GRANTS found*/')}""")
def _j8(spark, d):
    perms, pr = rel(spark, d, "permissions", "principals")
    return S.script_database_grants(perms, pr, universe=S.database_universe(pr))


@case("j9_script_object_grants", ["permissions", "principals", "objects", "schemas"], f"""{_UNIV},
d0 as (select distinct p.server_name, p.snapshot_id, p.database_name,
  case when p.state = 'W' then 'GRANT' else {_STATE.replace('case state', 'case p.state')} end as st,
  p.permission_name, s.name as schema_name, o.name as obj_name, g.name as grantee,
  case when p.state = 'W' then '] WITH GRANT OPTION' else ']' end as suffix
  from permissions p
  join principals g on p.server_name = g.server_name and p.snapshot_id = g.snapshot_id and p.database_name = g.database_name
    and p.grantee_principal_id = g.principal_id
  join objects o on p.server_name = o.server_name and p.snapshot_id = o.snapshot_id and p.database_name = o.database_name
    and p.major_id = o.object_id and o.type not in ('IT', 'S', 'X')
  join schemas s on o.server_name = s.server_name and o.snapshot_id = s.snapshot_id and o.database_name = s.database_name
    and o.schema_id = s.schema_id),
rows as (select {K}, database_name, 'object_grants' as section, 'info' as severity, grantee as principal_name,
  obj_name as object_name, concat(st, ' ', permission_name, ' ON [', schema_name, '].[', obj_name, '] TO [', grantee, suffix) as statement
  from d0)
select * from rows union all {_none('object_grants', '/*No database user object GRANTS found*/')}""")
def _j9(spark, d):
    perms, pr, ob, sc = rel(spark, d, "permissions", "principals", "objects", "schemas")
    return S.script_object_grants(perms, pr, ob, sc, universe=S.database_universe(pr))


@case("j10_script_role_members", ["principals", "role_members"],
      _mem_case("role_members", "member_principal_id > 4 and member_type <> 'R'", "/*No database user role GRANTS found*/"))
def _j10(spark, d):
    pr, m = rel(spark, d, "principals", "role_members")
    return S.script_role_members(pr, m, universe=S.database_universe(pr))


_LU = "p.type in ('S', 'U', 'G') and p.sid is not null and p.name not in ('dbo', 'guest')"


@case("j11_script_user_header", ["principals", "logins"], f"""
j as (select p.*, l.name as login_name from principals p left join logins l on p.server_name = l.server_name
  and p.snapshot_id = l.snapshot_id and p.sid = l.sid where {_LU})
select {K}, database_name, 'user_header' as section, case when login_name is null then 'error' else 'info' end as severity,
  name as principal_name, cast(null as varchar) as object_name,
  case when login_name is null then 'User ' || name || ' has no login on this server (database ' || database_name || ')'
  else '--Security creation script for user ' || login_name || chr(10) || '--Created At: ' || strftime({TS_AS_OF}, '%Y%m%d%H%M%S')
    || chr(10) || '--Created By: opslens' || chr(10) || '--Add User To Database' || chr(10) || 'USE [' || database_name || ']'
    || chr(10) || 'EXEC [sp_grantdbaccess]' || chr(10) || chr(9) || '@loginame = ''' || name || ''',' || chr(10) || chr(9)
    || '@name_in_db = ''' || name || '''' || chr(10) || '--' || chr(10) || '--Add User To Roles' end as statement
from j""")
def _j11(spark, d):
    return S.script_user_header(*rel(spark, d, "principals", "logins"), as_of=AS_OF)


_LUSERS = f"""lu as (select p.server_name, p.snapshot_id, p.database_name, p.principal_id, p.name from principals p where {_LU}
  and exists (select 1 from logins l where l.server_name = p.server_name and l.snapshot_id = p.snapshot_id and l.sid = p.sid))"""


@case("j12_script_user_roles", ["principals", "logins", "role_members"], f"""{_LUSERS}
select m.server_name, m.snapshot_id, m.database_name, 'user_roles' as section, 'info' as severity, u.name as principal_name,
  r.name as object_name, 'EXEC [sp_addrolemember]' || chr(10) || chr(9) || '@rolename = ''' || r.name || ''',' || chr(10)
  || chr(9) || '@membername = ''' || u.name || '''' as statement
from role_members m join lu u on m.server_name = u.server_name and m.snapshot_id = u.snapshot_id
  and m.database_name = u.database_name and m.member_principal_id = u.principal_id
join principals r on m.server_name = r.server_name and m.snapshot_id = r.snapshot_id and m.database_name = r.database_name
  and m.role_principal_id = r.principal_id""")
def _j12(spark, d):
    return S.script_user_roles(*rel(spark, d, "principals", "logins", "role_members"))


_ACTS = ("(values (193, 'SELECT', 1), (195, 'INSERT', 2), (197, 'UPDATE', 3), (196, 'DELETE', 4), (224, 'EXECUTE', 5), "
         "(26, 'REFERENCES', 6)) as a(action, action_name, action_order)")


@case("j13_script_user_object_permissions", ["protects", "objects", "schemas", "principals", "logins"], f"""{_LUSERS},
p as (select pr.server_name, pr.snapshot_id, pr.database_name, pr.uid, u.name as user_name, pr.id, pr.protecttype,
  a.action_name, a.action_order
  from protects pr join {_ACTS} on pr.action = a.action
  join lu u on pr.server_name = u.server_name and pr.snapshot_id = u.snapshot_id and pr.database_name = u.database_name
    and pr.uid = u.principal_id
  where pr.protecttype in (205, 206)),
g as (select server_name, snapshot_id, database_name, uid, user_name, id, protecttype,
  string_agg(action_name, ',' order by action_order) as acts
  from (select distinct server_name, snapshot_id, database_name, uid, user_name, id, protecttype, action_name, action_order from p)
  group by all),
j as (select g.*, '[' || s.name || '].[' || o.name || ']' as obj from g
  join objects o on g.server_name = o.server_name and g.snapshot_id = o.snapshot_id and g.database_name = o.database_name
    and g.id = o.object_id
  left join schemas s on o.server_name = s.server_name and o.snapshot_id = s.snapshot_id and o.database_name = s.database_name
    and o.schema_id = s.schema_id)
select {K}, database_name, 'user_object_permissions' as section, 'info' as severity, user_name as principal_name,
  obj as object_name, case when protecttype = 205 then 'GRANT' else 'DENY' end || chr(10) || chr(9) || acts || chr(10) || chr(9)
  || 'ON ' || obj || chr(10) || chr(9) || 'TO ' || user_name as statement
from j""")
def _j13(spark, d):
    return S.script_user_object_permissions(spark, *rel(spark, d, "protects", "objects", "schemas", "principals", "logins"))


_ELIG = f"""elig as (select d.server_name, d.snapshot_id, d.name as database_name from databases d
  join instances i on d.server_name = i.server_name and d.snapshot_id = i.snapshot_id
  where d.collation_name = i."collation" and d.database_id > 4 and d.user_access = 0 and not d.is_read_only
  and d.state_desc = 'ONLINE')"""


@case("j15_eligible_databases", ["databases", "instances"], f"{_ELIG} select * from elig")
def _j15(spark, d):
    return S.eligible_databases(*rel(spark, d, "databases", "instances"))


@case("j14_orphan_users", ["principals", "server_principals", "databases", "instances"], f"""{_ELIG},
o as (select p.* from principals p where p.type = 'S' and p.sid is not null and p.sid <> 0
  and exists (select 1 from elig e where e.server_name = p.server_name and e.snapshot_id = p.snapshot_id
              and e.database_name = p.database_name)
  and exists (select 1 from server_principals s where s.server_name = p.server_name and s.snapshot_id = p.snapshot_id
              and s.name = p.name)
  and not exists (select 1 from server_principals s where s.server_name = p.server_name and s.snapshot_id = p.snapshot_id
              and s.sid = p.sid)),
rows as (select {K}, database_name, 'orphan_users' as section, 'warn' as severity, name as principal_name,
  cast(null as varchar) as object_name, name || ' is an orphaned user (login exists, SID differs)' as statement from o)
select * from rows union all
select {K}, database_name, 'orphan_users', 'info', cast(null as varchar), cast(null as varchar),
  'No orphan user to be fixed for ' || database_name from elig e
where not exists (select 1 from rows r where r.server_name = e.server_name and r.snapshot_id = e.snapshot_id
  and r.database_name = e.database_name)""")
def _j14(spark, d):
    return S.orphan_users(*rel(spark, d, "principals", "server_principals", "databases", "instances"))


# Statements are numbered by principal, object and text inside a database's section.
for _n in [n for n in CASES if n.startswith("j") and n != "j15_eligible_databases"]:
    _fn, _sql = CASES[_n]
    CASES[_n] = (_fn, f"select *, row_number() over (partition by {K}, database_name, section order by principal_name nulls first, "
                      f"object_name nulls first, statement nulls first) as seq from ({_sql}) as drafts")

# ---------------------------------------------------------------- family K
from .operators import discovery as KD  # noqa: E402


def _k3_part(t, prefix):
    return (f"{prefix}p as (select {K}, database_id, "
            f"cast(cast(sum(size) as decimal(20,0)) * 0.0078125 as decimal(20,2)) as {prefix}_size_mb, "
            f"cast(cast(sum(space_used) as decimal(20,0)) * 0.00000762939453125 as decimal(20,2)) as {prefix}_used_gb, "
            f"cast(cast(sum(size) - sum(space_used) as decimal(20,0)) * 0.0078125 as decimal(20,2)) as {prefix}_free_mb "
            f"from master_files where type = {t} group by all)")


_K3 = f"""{_k3_part(0, 'data')}, {_k3_part(1, 'log')},
su as (select d.server_name, d.snapshot_id, d.name as database_name, d.state_desc, d.recovery_model_desc,
  dp.data_size_mb, dp.data_used_gb, dp.data_free_mb, lp.log_size_mb, lp.log_used_gb, lp.log_free_mb
  from databases d join datap dp on d.server_name = dp.server_name and d.snapshot_id = dp.snapshot_id
    and d.database_id = dp.database_id
  left join logp lp on d.server_name = lp.server_name and d.snapshot_id = lp.snapshot_id and d.database_id = lp.database_id)"""


@case("k3_space_used", ["master_files", "databases"], f"{_K3} select * from su")
def _k3(spark, d):
    return KD.space_used(*rel(spark, d, "master_files", "databases"))


@case("k2_edition_features", ["sku_features", "instances"], f"""
fe as (select {K}, string_agg(feature_name, ', ' order by feature_name) as edition_features
  from (select distinct {K}, feature_name from sku_features) group by all)
select i.server_name, i.snapshot_id, coalesce(fe.edition_features, '0') as edition_features
from (select distinct {K} from instances) i left join fe on i.server_name = fe.server_name and i.snapshot_id = fe.snapshot_id""")
def _k2(spark, d):
    f, i = rel(spark, d, "sku_features", "instances")
    return KD.edition_features(f, i)


_KRELS = ["instances", "databases", "master_files", "jobs", "trace_flags", "server_principals", "sku_features",
          "services", "certificates", "replica_states", "schedulers", "server_objects", "encryption_keys",
          "availability_groups", "objects", "schemas"]
_COUNTS = KD.COUNT_METRICS


def _so(cls, cond="true"):
    return f"count(case when object_class = '{cls}' and ({cond}) then 1 end)"


_SO = f"""so as (select {K}, {_so('linked_server', 'not is_remote')} as linked_servers,
  {_so('server_trigger')} as server_triggers, {_so('procedure', 'is_auto_executed')} as startup_procs,
  {_so('startup_parameter', "value like '-T%'")} as startup_trace_flags, {_so('mail_profile')} as mail_profiles,
  {_so('mail_account')} as mail_accounts, {_so('agent_alert')} as agent_alerts, {_so('agent_operator')} as agent_operators,
  {_so('agent_proxy')} as agent_proxies, {_so('maintenance_plan')} as maintenance_plans, {_so('server_audit')} as server_audits,
  {_so('credential')} as credentials, {_so('backup_device')} as backup_devices, {_so('endpoint', 'object_id > 5')} as endpoints,
  {_so('event_session', "name not in ('system_health', 'AlwaysOn_health', 'telemetry_xevents')")} as event_sessions,
  {_so('policy', 'not is_system')} as user_policies, {_so('condition', 'not is_system')} as user_conditions,
  {_so('symmetric_key', "name like '##MS_DatabaseMasterKey##'")} as _master_key,
  {_so('asymmetric_key', "name not like 'MS_SQLEnableSystemAssemblyLoadingKey'")} as asymmetric_keys,
  {_so('log_shipping_primary', 'name is not null')} as log_shipping_primary,
  {_so('log_shipping_secondary', 'name is not null')} as log_shipping_secondary,
  {_so('mirroring', 'mirroring_guid is not null')} as mirrored_dbs from server_objects group by all),
tde as (select e.server_name, e.snapshot_id, count(*) as tde_databases from encryption_keys e join certificates c
  on e.server_name = c.server_name and e.snapshot_id = c.snapshot_id and e.encryptor_thumbprint = c.thumbprint
  where e.encryption_state = 3 group by all),
agdb as (select r.server_name, r.snapshot_id, d.name as database_name from replica_states r
  join availability_groups g on r.server_name = g.server_name and r.snapshot_id = g.snapshot_id and r.group_id = g.group_id
    and g.primary_replica <> g.server_name
  join databases d on r.server_name = d.server_name and r.snapshot_id = d.snapshot_id and r.database_id = d.database_id),
sub as (select {K}, count(case when has_replication_objects then 1 end) as subscribed_dbs from databases d
  where state_desc = 'ONLINE' and d.name not in (select a.database_name from agdb a where a.server_name = d.server_name
    and a.snapshot_id = d.snapshot_id) group by all)"""
_WIN = r"not (starts_with(lower(name), '##ms_') or starts_with(lower(name), 'nt service\') or starts_with(lower(name), 'nt authority\'))"
_KW = f"""{_K3},
base as (select {K}, machine_name, coalesce(instance_name, '<default>') as instance_name, edition, product_version,
  {_VNAME} as version_name, product_level, "collation",
  cast(cast(physical_memory_kb as double) / 1024 / 1024 as decimal(15,2)) as total_memory_gb,
  sqlserver_start_time as last_restart, is_clustered, is_hadr_enabled, time_zone, default_data_path, default_log_path,
  case when is_resource_governor_enabled then 'Yes' else 'No' end as resource_governor from instances),
cpus as (select i.server_name, i.snapshot_id, i.cpu_count as os_cpus from instances i where exists (select 1 from schedulers s
  where s.server_name = i.server_name and s.snapshot_id = i.snapshot_id and s.status = 'VISIBLE ONLINE')),
dbm as (select {K},
  count(case when database_id > 4 and lower(state_desc) = 'online' then 1 end) as user_dbs_online,
  count(case when database_id > 4 and not lower(state_desc) = 'online' then 1 end) as user_dbs_not_online,
  count(case when database_id > 4 and lower(recovery_model_desc) <> 'full' then 1 end) as user_dbs_not_full,
  count(case when is_cdc_enabled then 1 end) as cdc_dbs,
  count(case when is_broker_enabled and database_id > 4 then 1 end) as broker_enabled_dbs,
  count(case when source_database_id is not null then 1 end) as database_snapshots,
  count(case when is_published then 1 end) as published_dbs, count(case when is_distributor then 1 end) as distributor_dbs,
  count(case when (is_published or is_subscribed or is_merge_published or is_distributor) and lower(state_desc) = 'online' then 1 end) as repl,
  count(case when lower(name) = 'ssisdb' then 1 end) as ssisdb from databases group by all),
fm as (select {K}, count(case when database_id = 2 and type = 0 then 1 end) as tempdb_data_files,
  cast(cast(sum(case when database_id > 4 then size end) as decimal(20,0)) * 0.00000762939453125 as decimal(10,2)) as total_gb_user_files
  from master_files group by all),
jm as (select {K}, count(*) as total_jobs, count(case when enabled = 1 then 1 end) as enabled_jobs from jobs group by all),
tm as (select {K}, count(case when is_global then 1 end) as global_trace_flags from trace_flags group by all),
spm as (select {K}, count(case when type = 'S' and name not like '##MS_%' then 1 end) as sql_logins,
  count(case when type in ('U', 'G') and {_WIN} then 1 end) as windows_logins,
  count(case when type = 'R' and principal_id > 10 then 1 end) as server_roles from server_principals group by all),
fe0 as (select {K}, string_agg(feature_name, ', ' order by feature_name) as edition_features
  from (select distinct {K}, feature_name from sku_features) group by all),
svc as (select {K}, max(cast(starts_with(servicename, 'MsDtsServer') as int)) as ssis,
  max(cast(starts_with(servicename, 'MSSQLServerOLAPService') as int)) as ssas,
  max(cast(servicename in ('ReportServer', 'SQLServerReportingServices') as int)) as ssrs from services group by all),
cm as (select {K}, count(case when certificate_id > 257 then 1 end) as certificates from certificates group by all),
agm as (select {K}, count(distinct database_id) as ag_databases from replica_states group by all),
u as (select {K}, sum(data_used_gb) as data_used_gb, sum(log_used_gb) as log_used_gb from su
  where lower(database_name) not in ('master', 'model', 'msdb', 'tempdb') group by all),
{_SO},
uo0 as (select ob.*, s.name as schema_name from objects ob left join schemas s on ob.server_name = s.server_name
  and ob.snapshot_id = s.snapshot_id and ob.database_name = s.database_name and ob.schema_id = s.schema_id),
uo as (select {K}, count(case when database_name = 'master' then 1 end) as user_objects_master,
  count(case when database_name = 'msdb' then 1 end) as user_objects_msdb,
  count(case when database_name = 'model' then 1 end) as user_objects_model from uo0 x
  where x.schema_name is not null and not (x.schema_name = 'sys' or (x.database_name = 'msdb' and x.schema_name = 'MS_PerfDashboard'))
    and not x.is_ms_shipped and x.parent_object_id not in (select y.object_id from uo0 y where y.server_name = x.server_name
      and y.snapshot_id = x.snapshot_id and y.database_name = x.database_name and (y.schema_name = 'sys' or y.is_ms_shipped))
  group by all),
w0 as (select * from base left join cpus using ({K}) left join dbm using ({K}) left join fm using ({K})
  left join jm using ({K}) left join tm using ({K}) left join spm using ({K}) left join fe0 using ({K})
  left join svc using ({K}) left join cm using ({K}) left join agm using ({K}) left join u using ({K})
  left join so using ({K}) left join tde using ({K}) left join sub using ({K}) left join uo using ({K})),
w as (select {K}, machine_name, instance_name, edition, product_version, version_name, product_level, "collation",
  total_memory_gb, last_restart, is_clustered, is_hadr_enabled, time_zone, default_data_path, default_log_path,
  resource_governor, os_cpus, {", ".join(f"coalesce({c}, 0) as {c}" for c in _COUNTS if c != "_master_key")},
  total_gb_user_files, coalesce(edition_features, '0') as edition_features, data_used_gb, log_used_gb,
  case when coalesce(repl, 0) > 0 then 'Yes' else 'NO' end as replication_configured,
  case when coalesce(ssisdb, 0) > 0 then 'Yes' else 'NO' end as ssisdb_catalog,
  case when coalesce(ssis, 0) > 0 then 'Yes' else 'NO' end as ssis_installed,
  case when coalesce(ssas, 0) > 0 then 'Yes' else 'NO' end as ssas_installed,
  case when coalesce(ssrs, 0) > 0 then 'Yes' else 'NO' end as ssrs_installed,
  case when coalesce(mirrored_dbs, 0) > 0 then 'Yes' else 'NO' end as mirroring_configured,
  case when coalesce(log_shipping_primary, 0) > 0 or coalesce(log_shipping_secondary, 0) > 0 then 'Yes' else 'NO' end
    as log_shipping_configured,
  case when coalesce(_master_key, 0) > 0 then 'Configured' else 'Not configured' end as master_key from w0),
ws as (select {K}, columns(* exclude ({K}))::varchar from w),
m as (select * from ws unpivot include nulls (value for metric in (columns(* exclude ({K})))))"""


def _k1_rel(spark, d):
    return rel(spark, d, *_KRELS)


@case("k1_discovery_metrics", _KRELS, f"{_KW} select * from m")
def _k1(spark, d):
    return KD.discovery_metrics(*_k1_rel(spark, d))


_TPL = "(values " + ", ".join(
    f"({n}, '{s}', {_q(lbl)}, '{m}', {('NULL' if r is None else _q(r))})" for n, s, lbl, m, r in KD.REPORT_TEMPLATE) + \
    ") as t(line_no, section, label, metric, show_if)"


@case("k4_report_lines", _KRELS, f"""{_KW}
select m.server_name, m.snapshot_id, t.line_no, t.section, t.label || ' = ' || coalesce(m.value, 'N/A') as line
from m join {_TPL} on m.metric = t.metric
left join (select {K}, value <> '0' as feats from m where metric = 'edition_features') f
  on m.server_name = f.server_name and m.snapshot_id = f.snapshot_id
where t.show_if is null or (t.show_if = 'gt0' and coalesce(try_cast(m.value as double), 0.0) > 0)
  or (t.show_if = 'features' and coalesce(f.feats, false))""")
def _k4(spark, d):
    return KD.report_lines(spark, KD.discovery_metrics(*_k1_rel(spark, d)))


@case("k5_user_objects", ["objects", "schemas"], f"""
o as (select ob.*, s.name as schema_name from objects ob left join schemas s on ob.server_name = s.server_name
  and ob.snapshot_id = s.snapshot_id and ob.database_name = s.database_name and ob.schema_id = s.schema_id)
select {K}, database_name, count(*) as user_objects from o x
where x.schema_name is not null
  and not (x.schema_name = 'sys' or (x.database_name = 'msdb' and x.schema_name = 'MS_PerfDashboard'))
  and not x.is_ms_shipped
  and x.parent_object_id not in (select y.object_id from o y where y.server_name = x.server_name
    and y.snapshot_id = x.snapshot_id and y.database_name = x.database_name and (y.schema_name = 'sys' or y.is_ms_shipped))
group by all""")
def _k5(spark, d):
    return KD.user_object_counts(*rel(spark, d, "objects", "schemas"))


@case("k1_server_object_counts", ["server_objects"], f"""{_SO} select * from so""")
def _k1b(spark, d):
    return KD.server_object_counts(rel(spark, d, "server_objects"))


# ---------------------------------------------------------------- end-to-end health check
from .operators import report as R  # noqa: E402
from .suite import CASES as _ALL  # noqa: E402

_HC = ["a4_identity_checks", "b3_config_checks", "b5_db_setting_checks", "b7_owner_checks", "b8_trace_flag_checks",
       "b9_service_account_checks", "b10_msdb_size_check", "b11_recovery_model_count", "b12_module_check",
       "c9_file_growth_checks", "c11_tempdb_file_count", "c12_tempdb_uniformity", "c13_vlf_check", "d6_no_log_backup",
       "d9_no_full_backup", "d11_never_checked", "d12_stale_integrity_count", "h2_ag_health", "d7_stale_log_backup_count",
       "a5_a7_version_findings", "f3_top_wait_findings"]
_HC_RELS = ["instances", "schedulers", "config", "databases", "jobs", "packages", "trace_flags", "services",
            "master_files", "modules", "log_info", "backupset", "dbinfo", "availability_groups", "wait_stats"]


@case("d7_stale_log_backup_count", ["databases", "backupset"], f"""{_ELIG_LOG},
l as (select e.server_name, e.snapshot_id, e.database_name, max(b.backup_finish_date) as last from e {_JL} group by all),
a as (select {K}, count(case when datediff('day', last, {TS_AS_OF}) > 1 then 1 end) as n from l group by all)
select {K}, 'D7.stale_log_backup' as check_id, case when n > 0 then 'warn' else 'ok' end as severity, cast(n as varchar) as observed,
  case when n > 0 then printf('Last LOG backup too old on %d database(s)', n) else 'LOG backup age verified' end as message from a""")
def _d7b(spark, d):
    return D.stale_log_backup_count(*rel(spark, d, "databases", "backupset"), as_of=AS_OF)


@case("a5_a7_version_findings", [], f"""
select {K}, 'A5.support_level' as check_id,
  case when obsolete or coalesce(support_status in ('not_latest_sp', 'not_rtm', 'rtm'), true) then 'warn' else 'ok' end as severity,
  product_version as observed, coalesce(message, 'version is not in the support table') as message
from ({_ALL["a5_support_level"][1]})
union all by name
select {K}, 'A6.risky_build' as check_id, case when message is not null then 'warn' else 'ok' end as severity,
  product_version as observed, coalesce(message, 'no known defect for this build') as message
from ({_ALL["a6_risky_build"][1]})
union all by name
select {K}, 'A7.side_channel' as check_id, 'info' as severity, patch_status as observed,
  coalesce(message, 'no side-channel rule for this version') as message
from ({_ALL["a7_side_channel_patch"][1]})""")
def _a57(spark, d):
    return A.version_findings(spark, rel(spark, d, "instances"))


@case("f3_top_wait_findings", [], f"""
select {K}, 'F3.top_wait' as check_id, 'info' as severity, wait_type as observed, line as message
from ({_ALL["f3_top_waits"][1]})""")
def _f3b(spark, d):
    return W.top_wait_findings(spark, rel(spark, d, "wait_stats"))


_CASES_HC_SQL = "\nunion all by name\n".join(f"select * from ({_ALL[n][1]})" for n in _HC)


@case("health_check_findings", [], _CASES_HC_SQL)
def _hc(spark, d):
    return R.health_check_findings(spark, dict(zip(_HC_RELS, rel(spark, d, *_HC_RELS))), as_of=AS_OF)


# ---------------------------------------------------------------- end-to-end access audit
_AA = ["j1_script_certificates", "j2_script_users", "j3_script_certificate_users", "j4_script_schema_permissions",
       "j5_script_roles", "j6_script_app_roles", "j7_script_nested_roles", "j8_script_database_grants",
       "j9_script_object_grants", "j10_script_role_members", "j11_script_user_header", "j12_script_user_roles",
       "j13_script_user_object_permissions", "j14_orphan_users"]
_AA_RELS = ["principals", "logins", "certificates", "permissions", "schemas", "role_members", "objects", "protects",
            "server_principals", "databases", "instances"]


@case("access_audit_script", [], "\nunion all by name\n".join(f"select * from ({_ALL[n][1]})" for n in _AA))
def _aa(spark, d):
    return R.access_audit(spark, dict(zip(_AA_RELS, rel(spark, d, *_AA_RELS))), as_of=AS_OF)


# The cases of sources and sinks, which build on those above.
from . import suite_sources  # noqa: E402,F401
