"""Telemetry relations bound to the driver's test tables.

Production input is landed telemetry (see ``loader.load_snapshot``). For the
oracle tests every telemetry relation is *derived* from the driver's parquet
tables by one SQL text that Spark and DuckDB both run, so the Spark operator
and the DuckDB oracle see identical rows (FIXTURES.md section 2).

Each binding is ``select <expr> as <col>, ... from <source> [tail]``.
Every relation covers several servers and two snapshots, and reads its whole
source: bounded catalogs are aggregates over the whole table, idle or missing
entries come from joins that find nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Binding:
    source: str
    cols: tuple[tuple[str, str], ...]
    tail: str = ""
    #: (name, n): every source row n times, numbered 0 .. n - 1 in column ``name``
    times: tuple[str, int] | None = None

    def select_list(self) -> str:
        return ", ".join(f"{e} as {c}" for c, e in self.cols)


def _b(source, cols, tail="", fleet=None, times=None):
    """``fleet``: the number whose last digit names server and snapshot. The
    fleet key is always derived from a source column, as a literal would be
    constant-folded and turn equi-joins on it into nested-loop joins."""
    key = [] if fleet is None else [("server_name", SRV(fleet)), ("snapshot_id", SNP(fleet))]
    return Binding(source, (*key, *cols), tail, times)


# Five servers with two snapshots each: the last digit of a key names both, so
# rows that belong together ('db7' and its files) meet on one server and
# snapshot.
SRV = lambda k: f"'srv' || cast({k} % 10 % 5 as string)"
SNP = lambda k: f"cast(({k} % 10 - {k} % 5) / 5 as int)"
# Rows of a relation that every server has in both snapshots, or that every server and snapshot of the fleet has.
SNAPSHOTS, FLEET = ("snap", 2), ("fleet", 10)


def DBN(n):  # noqa: N802
    """Database name by number; the first four are the system databases."""
    return f"case {n} when 0 then 'master' when 1 then 'tempdb' when 2 then 'model' when 3 then 'msdb' else 'db' || cast({n} as string) end"


def spread_id(key, step, digit):
    """A number that grows with ``key`` and ends in ``digit``'s last digit."""
    return f"cast(floor({key} / {step}) * 10 + {digit} % 10 as bigint)"


def _wait_type_expr(idx: str) -> str:
    """Wait type name by index: the 52 reviewed types, then others."""
    from ..operators.wait import WAIT_CATEGORIES
    names = [w for w, _ in WAIT_CATEGORIES] + [
        "SLEEP_TASK", "LAZYWRITER_SLEEP", "BROKER_TASK_STOP", "SQLTRACE_BUFFER_FLUSH",
        "CHECKPOINT_QUEUE", "XE_TIMER_EVENT", "REQUEST_FOR_DEADLOCK_SEARCH", "WAITFOR"]
    whens = " ".join(f"when {i} then '{n}'" for i, n in enumerate(names))
    return f"case {idx} {whens} end"


# Pieces of the showplans: a self-closing statement before the one that counts, a line break after its tag's
# name, a nested statement before its missing indexes, none, one or two missing-index groups.
_PLAN_BEFORE = "case when o_orderkey % 7 = 1 then '<StmtSimple StatementText=\"set x\"/>' else '' end"
_PLAN_GAP = "case when o_orderkey % 7 = 2 then chr(10) || '  ' else ' ' end"
_PLAN_INDEX = ("'<MissingIndexGroup Impact=\"' || cast(o_custkey % 100 as string) || '\"><MissingIndex Database=\"[d]\" Schema=\"[s]\" Table=\"[t' || cast(o_custkey % 50 as string) || ']\">"
               "<ColumnGroup Usage=\"EQUALITY\"><Column Name=\"[c' || cast(o_custkey % 4 as string) || ']\"/><Column Name=\"[e' || cast(o_orderkey % 3 as string) || ']\"/></ColumnGroup>"
               "<ColumnGroup Usage=\"INEQUALITY\"><Column Name=\"[i' || cast(o_custkey % 2 as string) || ']\"/></ColumnGroup>' || "
               "case when o_orderkey % 3 = 0 then '<ColumnGroup Usage=\"INCLUDE\"><Column Name=\"[n' || cast(o_custkey % 5 as string) || ']\"/></ColumnGroup>' else '' end || '</MissingIndex></MissingIndexGroup>'")
_PLAN_SECOND = "case when o_orderkey % 7 = 4 then '<MissingIndexGroup Impact=\"1\"><MissingIndex Database=\"[d2]\" Schema=\"[s2]\" Table=\"[u]\"><ColumnGroup Usage=\"EQUALITY\"><Column Name=\"[z]\"/></ColumnGroup></MissingIndex></MissingIndexGroup>' else '' end"
_PLAN_MISSING = f"case when o_orderkey % 5 = 0 then '' else '<MissingIndexes>' || {_PLAN_INDEX} || {_PLAN_SECOND} || '</MissingIndexes>' end"
_PLAN_INNER = ("case when o_orderkey % 7 = 3 then '<StoredProc><Statements><StmtSimple StatementText=\"inner' || cast(o_orderkey as string) || '\"><QueryPlan><MissingIndexes>"
               "<MissingIndexGroup Impact=\"7\"><MissingIndex Database=\"[d]\" Schema=\"[s]\" Table=\"[in]\"><ColumnGroup Usage=\"INCLUDE\"><Column Name=\"[y]\"/></ColumnGroup></MissingIndex></MissingIndexGroup>"
               "</MissingIndexes></QueryPlan></StmtSimple></Statements></StoredProc>' else '' end")
_CPU = "cast(floor(o_orderkey / 25) as bigint) % 34"
_OPTION = "cast(floor(o_orderkey / 25) as bigint) % 10"
_SERVICE = "cast(floor(o_orderkey / 25) as bigint) % 5"
_SID = spread_id("c_custkey", 150, "c_custkey")

BINDINGS: dict[str, Binding] = {
    "instances": _b("nation", [
        ("server_name", "'srv' || cast(n_nationkey as string)"),
        ("snapshot_id", "cast(snap as int)"),
        ("machine_name", "case when n_nationkey % 7 = 0 then 'other' else 'srv' || cast(n_nationkey as string) end"),
        ("instance_name", "case when n_nationkey % 2 = 0 then null else 'inst' || cast(n_nationkey as string) end"),
        ("edition", "case n_regionkey % 3 when 0 then 'Enterprise Edition' when 1 then 'Standard Edition' else 'Developer Edition' end"),
        ("product_version", "cast(8 + n_nationkey % 8 as string) || '.0.' || cast(1000 + n_nationkey * 347 as string) || '.0'"),
        ("product_level", "case when n_nationkey % 3 = 0 then 'RTM' else 'SP' || cast(n_nationkey % 3 as string) end"),
        ("collation", "'coll' || cast(n_nationkey % 2 as string)"),
        ("is_clustered", "n_nationkey % 5 = 1"),
        ("is_hadr_enabled", "n_nationkey % 4 = 1"),
        ("virtual_machine_type", "case when n_nationkey % 2 = 0 then 'HYPERVISOR' else 'NONE' end"),
        ("cpu_count", "cast(8 * (1 + n_nationkey % 4) as bigint)"),
        ("hyperthread_ratio", "cast(2 + n_nationkey % 3 as bigint)"),
        ("visible_cpus", "cast(8 * (1 + n_nationkey % 4) - case when n_nationkey % 5 = 0 then 4 else 0 end as bigint)"),
        ("physical_memory_kb", "cast((n_nationkey + 1) * 8388608 as bigint)"),
        ("max_server_memory_mb", "cast(case when n_nationkey % 3 = 0 then 2147483647 else n_nationkey * 9000 end as bigint)"),
        ("memory_model", "cast(1 + n_nationkey % 3 as bigint)"),
        ("sqlserver_start_time", "timestamp '2001-07-01 00:00:00'"),
        ("is_fulltext_installed", "n_nationkey % 3 <> 2"),
        ("time_zone", "case when n_nationkey % 2 = 0 then 'UTC' else 'Pacific Standard Time' end"),
        ("default_data_path", "'D:/data/' || cast(n_nationkey as string)"),
        ("default_log_path", "'L:/log/' || cast(n_nationkey as string)"),
        ("is_resource_governor_enabled", "n_nationkey % 6 = 1"),
        ("engine_edition", "cast(case n_nationkey % 5 when 2 then 5 when 3 then 8 else 3 end as int)"),
        ("is_rds", "n_nationkey % 5 = 1"),
    ], times=SNAPSHOTS),
    "packages": _b("supplier", [
        ("name", "'pkg' || cast(s_suppkey as string)"),
        ("owner_name", "case s_suppkey % 4 when 0 then 'sa' when 1 then 'app' when 2 then null else 'dev' end"),
    ], fleet="s_suppkey"),
    "schedulers": _b("orders", [
        ("server_name", "'srv' || cast(o_orderkey % 25 as string)"),
        ("snapshot_id", "cast(snap as int)"),
        ("cpu_id", _CPU),
        ("status", f"case when {_CPU} < 8 * (1 + o_orderkey % 25 % 4) - case when o_orderkey % 25 % 5 = 0 then 4 else 0 end then 'VISIBLE ONLINE' else 'HIDDEN ONLINE' end"),
    ], f"group by o_orderkey % 25, {_CPU}, snap", times=SNAPSHOTS),
    "config": _b("orders", [
        ("server_name", "'srv' || cast(o_orderkey % 25 as string)"),
        ("snapshot_id", "cast(snap as int)"),
        ("name", f"case {_OPTION} when 0 then 'backup compression default' when 1 then 'clr enabled' when 2 then 'max degree of parallelism' when 3 then 'cost threshold for parallelism' when 4 then 'min server memory (MB)' when 5 then 'max server memory (MB)' when 6 then 'max full-text crawl range' when 7 then 'priority boost' when 8 then 'optimize for ad hoc workloads' when 9 then 'remote admin connections' end"),
        ("value", f"cast((o_orderkey % 25 * ({_OPTION} + 1)) % 7 as bigint)"),
        ("value_in_use", f"cast((o_orderkey % 25 + {_OPTION} + 1) % 6 as bigint)"),
    ], f"group by o_orderkey % 25, {_OPTION}, snap", times=SNAPSHOTS),
    "databases": _b("supplier", [
        ("database_id", "s_suppkey + 1"),
        ("name", "case when s_suppkey = 24 then 'SSISDB' else " + DBN("s_suppkey") + " end"),
        ("recovery_model", "1 + s_nationkey % 3"),
        ("recovery_model_desc", "case s_nationkey % 3 when 0 then 'FULL' when 1 then 'BULK_LOGGED' else 'SIMPLE' end"),
        ("state", "case when s_nationkey % 4 = 0 then 6 else 0 end"),
        ("state_desc", "case when s_nationkey % 4 = 0 then 'OFFLINE' else 'ONLINE' end"),
        ("compatibility_level", "80 + 10 * (s_nationkey % 8)"),
        ("is_encrypted", "s_nationkey % 2 = 0"),
        ("is_auto_close_on", "s_suppkey % 3 = 0"),
        ("is_auto_shrink_on", "s_suppkey % 4 = 0"),
        ("is_auto_update_stats_on", "s_suppkey % 6 <> 0"),
        ("is_auto_create_stats_on", "s_suppkey % 8 <> 0"),
        ("is_auto_update_stats_async_on", "s_suppkey % 5 = 0"),
        ("is_parameterization_forced", "s_suppkey % 6 = 0"),
        ("snapshot_isolation_state_desc", "case when s_suppkey % 3 = 0 then 'ON' else 'OFF' end"),
        ("is_read_committed_snapshot_on", "s_suppkey % 2 = 0"),
        ("is_read_only", "s_suppkey % 11 = 0"),
        ("user_access", "case when s_suppkey % 13 = 0 then 1 else 0 end"),
        ("is_cdc_enabled", "s_suppkey % 9 = 0"),
        ("is_broker_enabled", "s_suppkey % 7 = 0"),
        ("is_published", "s_suppkey % 17 = 0"),
        ("is_merge_published", "s_suppkey % 19 = 0"),
        ("is_subscribed", "s_suppkey % 13 = 3"),
        ("is_distributor", "s_suppkey % 23 = 0"),
        ("has_replication_objects", "s_suppkey % 5 = 1"),
        ("log_reuse_wait_desc", "case when s_suppkey % 2 = 0 then 'NOTHING' else 'LOG_BACKUP' end"),
        ("page_verify_option_desc", "case when s_suppkey % 5 = 0 then 'NONE' else 'CHECKSUM' end"),
        ("source_database_id", "case when s_suppkey % 10 = 9 then 1 end"),
        ("owner_name", "case s_nationkey % 3 when 0 then 'sa' when 1 then 'app' end"),
        ("collation_name", "'coll' || cast(s_nationkey % 2 as string)"),
    ], fleet="s_suppkey"),
    "master_files": _b("part", [
        ("database_id", "p_partkey % 10 + 1"),
        ("database_name", DBN("p_partkey % 10")),
        ("file_id", "p_partkey"),
        ("name", "'f' || cast(p_partkey as string)"),
        ("type", "case when p_size % 8 = 0 then 2 when p_size % 8 = 1 then 4 when p_size % 8 < 4 then 1 else 0 end"),
        ("size", "cast(p_size * 997 as bigint)"),
        ("space_used", "cast(p_size * 311 as bigint)"),
        ("growth", "case p_size % 5 when 0 then 0 when 1 then 128 else 8192 end"),
        ("is_percent_growth", "p_size % 7 = 0"),
        ("max_size", "case p_size % 4 when 0 then -1 when 1 then 268435456 when 2 then 100000 else 0 end"),
        ("physical_name", "case p_partkey % 3 when 0 then 'C:' when 1 then 'd:' else 'E:' end || '/f' || cast(p_partkey as string)"),
        ("volume_mount_point", "case p_partkey % 3 when 0 then 'C:/' when 1 then 'D:/' else 'E:/' end"),
        ("state_desc", "case when p_size % 9 = 0 then 'OFFLINE' else 'ONLINE' end"),
    ], fleet="p_partkey"),
    "volumes": _b("part", [
        ("database_id", "p_partkey % 10 + 1"),
        ("file_id", "p_partkey"),
        ("volume_mount_point", "case p_size % 3 when 0 then 'M:/a/' when 1 then 'M:/b/' else 'N:/' end"),
    ], "where p_partkey % 7 <> 3", fleet="p_partkey"),
    "trace_events": _b("nation", [
        ("trace_event_id", "90 + n_nationkey"),
        ("event_name", "case n_nationkey when 2 then 'Data File Auto Grow' when 3 then 'Log File Auto Grow' when 4 then 'Data File Auto Shrink' when 5 then 'Log File Auto Shrink' else 'Event ' || cast(90 + n_nationkey as string) end"),
    ], fleet="fleet", times=FLEET),
    "io_file_stats": _b("lineitem", [
        ("database_id", "l_partkey % 10 + 1"),
        ("file_id", "l_partkey"),
        ("num_of_reads", "cast(floor(l_quantity) as bigint)"),
        ("num_of_writes", "cast(l_linenumber as bigint)"),
        ("num_of_bytes_read", "cast(floor(l_extendedprice) as bigint)"),
        ("num_of_bytes_written", "cast(floor(l_extendedprice * l_discount) as bigint)"),
        ("io_stall_read_ms", "cast(floor(l_quantity) * 3 as bigint)"),
        ("io_stall_write_ms", "cast(l_linenumber * 2 as bigint)"),
        ("io_stall", "cast(floor(l_quantity) * 3 + l_linenumber * 2 as bigint)"),
    ], fleet="l_partkey"),
    "backupset": _b("orders", [
        ("database_name", DBN("o_custkey % 10")),
        ("media_set_id", "o_orderkey"),
        ("name", "'bs' || cast(o_orderkey as string)"),
        ("type", "case when o_custkey % 10 = 7 then 'D' when o_orderstatus = 'F' then 'D' when o_orderstatus = 'O' then 'L' else 'I' end"),
        ("recovery_model", "case when o_orderkey % 11 = 0 then null else 'FULL' end"),
        ("backup_start_date", "o_orderdate"),
        ("backup_finish_date", "case when o_orderkey % 97 = 0 then null else o_orderdate end"),
    ], fleet="o_custkey"),
    "backupmediafamily": _b("lineitem", [
        ("media_set_id", "l_orderkey"),
        ("family_sequence_number", "l_linenumber"),
        ("logical_device_name", "case when l_linenumber % 2 = 0 then null else 'dev' || cast(l_linenumber as string) end"),
        ("physical_device_name", "'D:/bkp/' || 'db' || cast(l_suppkey % 10 as string) || '.bak'"),
    ], fleet="l_orderkey"),
    "processes": _b("events", [
        ("spid", "event_id + 50"),
        ("kpid", "event_id % 9000"),
        ("blocked", "case when event_id % 5 = 0 then 0 else event_id - event_id % 5 + 50 end"),
        ("dbid", "user_id % 10 + 1"),
        ("status", "case event_type when 'view' then 'sleeping' when 'click' then 'running' else 'suspended' end"),
        ("command", "case event_id % 4 when 0 then 'BACKUP DATABASE' when 1 then 'RESTORE DATABASE' when 2 then 'Backup Log' else 'KILLED/ROLLBACK' end"),
        ("loginame", "'domain/login_number_' || cast(user_id as string)"),
        ("hostname", "'workstation_' || cast(user_id % 97 as string)"),
        ("open_tran", "event_id % 3"),
        ("waittype", "case when event_id % 5 = 0 then 'NONE' else 'LCK_M_X' end"),
        ("waittime", "cast(floor(value * 10) as bigint)"),
        ("last_batch", "ts"),
        ("login_time", "ts"),
        ("cpu", "cast(floor(value * 7) as bigint)"),
        ("physical_io", "cast(floor(value * 3) as bigint)"),
        ("wait_type", "case when event_id % 5 = 0 then null else 'BACKUPIO' end"),
        ("percent_complete", "cast(floor(value) as bigint) % 100"),
        ("start_time", "ts"),
        ("estimated_completion_time", "cast(floor(value * 1000) as bigint)"),
        ("sql_handle", "case when event_id % 7 = 3 then null else cast(floor(event_id / 10) as bigint) end"),
        ("statement_start_offset", "cast(event_id % 3 * 10 as bigint)"),
        ("statement_end_offset", "case when event_id % 2 = 0 then -1 else 60 end"),
        ("isolation_level", "event_id % 6"),
        ("wait_resource", "case when event_id % 5 = 0 then '' else 'KEY: ' || cast(event_id as string) end"),
        ("nt_username", "'nt' || cast(user_id % 31 as string)"),
        ("hostprocess", "cast(event_id % 5000 as string)"),
        ("memusage", "event_id % 64"),
        ("program_name", "case when event_id % 7 = 0 then 'SQLAgent - TSQL JobStep (Job 0x' || lpad(cast(" + spread_id("event_id", 50, "user_id") + " as string), 32, '0') || ' : Step 1)' else 'app' || cast(user_id % 5 as string) end"),
    ], fleet="user_id"),
    "sql_text": _b("documents", [
        # Every handle is landed by two servers, with another text on each.
        ("sql_handle", "doc_id"),
        ("object_id", "case when doc_id % 3 = 0 then null else doc_id % 700 end"),
        ("text", "case when copy = 0 then text else 'copy of ' || text end"),
    ], fleet="(doc_id + copy * 3)", times=("copy", 2)),
    "trace_log": _b("events", [
        ("event_class", "89 + event_id % 9"),
        ("database_name", DBN("user_id % 10")),
        ("file_name", "'f' || cast(user_id % 40 as string)"),
        ("application_name", "'app' || cast(user_id % 5 as string)"),
        ("host_name", "'host' || cast(user_id % 11 as string)"),
        ("login_name", "'login' || cast(user_id % 13 as string)"),
        ("start_time", "ts"),
        ("end_time", "ts"),
        ("duration_us", "cast(floor(value * 1000000) as bigint)"),
        ("integer_data", "cast(floor(value) as bigint)"),
    ], fleet="user_id"),
    "xe_events": _b("events", [
        ("object_name", "case when event_id % 3 = 0 then 'availability_replica_state_change' else 'other' end"),
        ("event_data", "'<event timestamp=\"' || cast(ts as string) || '\"><data name=\"availability_group_name\"><value>ag' || cast(user_id as string) || '</value></data><data name=\"previous_state\"><text>' || event_type || '</text></data>' || case when event_id % 2 = 0 then '<data name=\"current_state\"><text>' || case when event_id % 4 = 0 then 'PRIMARY_NORMAL' else 'SECONDARY_NORMAL' end || '</text></data>' else '' end || '</event>'"),
    ], fleet="user_id"),
    "wait_stats": _b("events", [
        ("wait_idx", "event_id % 60"),
        ("wait_type", _wait_type_expr("event_id % 60")),
        ("waiting_tasks_count", "count(*)"),
        ("wait_time_ms", "cast(sum(floor(value * 100)) as bigint)"),
        ("signal_wait_time_ms", "cast(sum(floor(value * 10)) as bigint)"),
    ], "group by 1, 2, 3", fleet="user_id"),
    "log_info": _b("lineitem", [
        ("database_name", DBN("l_partkey % (20 + l_linenumber * 30)")),
        ("start_offset", "l_orderkey"),
    ], fleet="l_suppkey"),
    "dbinfo": _b("orders", [
        ("database_name", DBN("o_custkey % 60")),
        ("field", "case when o_orderkey % 3 = 0 then 'dbi_dbccLastKnownGood' else 'other' end"),
        ("value", "case when o_custkey % 13 = 0 then timestamp '1900-01-01 00:00:00' else o_orderdate end"),
    ], fleet="o_custkey"),
    "indexes": _b("lineitem", [
        ("database_name", DBN("l_orderkey % 10")),
        ("object_id", "l_orderkey"),
        ("index_id", "l_linenumber"),
        ("name", "'ix_' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string)"),
        ("is_unique", "min(l_partkey) % 4 = 0"),
        ("is_primary_key", "min(l_partkey) % 5 = 0"),
        ("is_unique_constraint", "min(l_partkey) % 7 = 0"),
        ("is_hypothetical", "min(l_suppkey) % 9 = 0"),
        ("fill_factor", "l_linenumber * 10"),
        ("type_desc", "case when l_linenumber = 1 then 'CLUSTERED' else 'NONCLUSTERED' end"),
    ], "group by l_orderkey, l_linenumber", fleet="l_orderkey"),
    "index_keys": _b("lineitem", [
        ("database_name", DBN("l_orderkey % 10")),
        ("object_id", "l_orderkey"),
        ("index_id", "l_linenumber"),
        ("colid", "l_partkey % 4 + 1"),
        ("keyno", "l_suppkey % 3"),
        ("column_name", "'c' || cast(l_partkey % 4 + 1 as string)"),
    ], "group by l_orderkey, l_linenumber, l_partkey % 4 + 1, l_suppkey % 3", fleet="l_orderkey"),
    "index_usage": _b("lineitem", [
        ("database_name", DBN("l_orderkey % 10")),
        ("object_id", "l_orderkey"),
        ("index_id", "l_linenumber"),
        ("user_seeks", "sum(case when l_returnflag = 'R' then 1 else 0 end)"),
        ("user_scans", "sum(case when l_linestatus = 'O' then 1 else 0 end)"),
        ("user_lookups", "sum(case when l_discount > 0.09 then 1 else 0 end)"),
        ("user_updates", "cast(sum(floor(l_quantity)) as bigint)"),
    ], "group by l_orderkey, l_linenumber", fleet="l_orderkey"),
    "index_physical": _b("lineitem", [
        ("database_name", DBN("l_orderkey % 10")),
        ("object_id", "l_orderkey"),
        ("index_id", "l_linenumber"),
        ("index_type_desc", "case when l_linenumber = 2 then 'HEAP' else 'NONCLUSTERED INDEX' end"),
        ("page_count", "cast(sum(floor(l_quantity)) * 50 as bigint)"),
        ("alloc_unit_type_desc", "case when l_linenumber = 6 then 'LOB_DATA' else 'IN_ROW_DATA' end"),
        ("index_depth", "l_linenumber % 3 + 1"),
        ("fragmentation_pct", "max(l_discount)"),
        ("fragment_count", "count(*)"),
        ("avg_fragment_size_in_pages", "max(l_tax)"),
        ("avg_page_space_used_pct", "min(l_discount)"),
        ("record_count", "cast(sum(floor(l_quantity)) * 100 as bigint)"),
        ("compressed_page_count", "case when l_linenumber = 3 then count(*) else 0 end"),
    ], "group by l_orderkey, l_linenumber", fleet="l_orderkey"),
    "statistics": _b("orders", [
        ("database_name", DBN("o_custkey % 10")),
        ("object_id", "o_custkey"),
        ("name", "'st' || cast(o_orderkey as string)"),
        ("updated", "case when o_orderkey % 17 = 0 then null else o_orderdate end"),
    ], fleet="o_custkey"),
    "missing_index_groups": _b("orders", [
        ("index_group_handle", "o_orderkey"),
        ("index_handle", "o_custkey"),
    ], fleet="o_custkey"),
    "missing_index_group_stats": _b("orders", [
        ("group_handle", "o_orderkey"),
        ("avg_total_user_cost", "o_totalprice"),
        ("avg_user_impact", "cast(o_custkey % 100 as double)"),
        ("user_seeks", "o_orderkey % 5"),
        ("user_scans", "o_orderkey % 3"),
        ("last_user_seek", "o_orderdate"),
    ], fleet="o_custkey"),
    "missing_index_details": _b("customer", [
        ("index_handle", "c_custkey"),
        ("database_id", "c_custkey % 10 + 1"),
        ("object_id", "c_custkey"),
        ("object_name", "'t' || cast(c_custkey as string)"),
        ("statement", "'[d].[s].[t' || cast(c_custkey as string) || ']'"),
        ("equality_columns", "case when c_nationkey % 3 = 0 then null else '[a]' end"),
        ("inequality_columns", "case when c_nationkey % 4 = 0 then null else '[b]' end"),
        ("included_columns", "case when c_nationkey % 2 = 0 then null else '[c]' end"),
    ], fleet="c_custkey"),
    "cached_plans": _b("orders", [
        ("plan_handle", "o_orderkey"),
        ("usecounts", "1 + cast(floor(o_totalprice) as bigint) % 500"),
        ("objtype", "case when o_orderkey % 4 = 0 then 'Adhoc' else 'Proc' end"),
        ("db_name", "case when o_custkey % 10 = 3 then null else 'db' || cast(o_custkey % 10 as string) end"),
        ("schema_name", "'s' || cast(o_custkey % 3 as string)"),
        ("proc_name", "'p' || cast(o_custkey % 50 as string)"),
        # The plan is put together from its parts, so that an oracle can be, too.
        ("query_plan", f"'<ShowPlanXML><BatchSequence><Batch><Statements>' || {_PLAN_BEFORE} || '<StmtSimple' || {_PLAN_GAP} || 'StatementText=\"q' || cast(o_orderkey as string) || '\">' || {_PLAN_INNER} || '<QueryPlan>' || {_PLAN_MISSING} || '</QueryPlan></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>'"),
    ], fleet="o_orderkey"),
    "query_stats": _b("lineitem", [
        ("plan_handle", "l_orderkey"),
        ("total_worker_time", "cast(floor(l_extendedprice) as bigint)"),
        ("total_physical_reads", "cast(floor(l_quantity) as bigint)"),
        ("total_logical_reads", "l_partkey"),
        ("total_logical_writes", "l_suppkey"),
        ("total_elapsed_time", "cast(floor(l_extendedprice) * 2 as bigint)"),
    ], fleet="l_orderkey"),
    "principals": _b("customer", [
        ("database_name", DBN("c_custkey % 10")),
        ("principal_id", "c_custkey"),
        ("name", "c_name"),
        ("type", "case c_nationkey % 6 when 0 then 'U' when 1 then 'G' when 2 then 'S' when 3 then 'R' when 4 then 'A' else 'C' end"),
        ("sid", "case when c_custkey % 8 = 0 then null else " + _SID + " end"),
        ("is_fixed_role", "c_custkey % 20 = 3"),
        ("owning_principal_id", spread_id("c_custkey", 20, "c_custkey")),
        ("default_schema_name", "case when c_custkey % 3 = 0 then null else 'dbo' end"),
    ], fleet="c_custkey"),
    "logins": _b("supplier", [
        ("sid", "s_suppkey"),
        ("name", "s_name"),
    ], fleet="s_suppkey"),
    "server_principals": _b("customer", [
        ("name", "case c_custkey % 19 when 3 then 'NT SERVICE' || chr(92) || c_name when 7 then 'nt authority' || chr(92) || c_name when 11 then '##MS_' || c_name else c_name end"),
        ("sid", "case when c_custkey % 4 = 1 then " + _SID + " else c_custkey + 5000000 end"),
        ("type", "case c_nationkey % 4 when 0 then 'S' when 1 then 'U' when 2 then 'G' else 'R' end"),
        ("principal_id", "c_custkey"),
    ], fleet="c_custkey"),
    "role_members": _b("orders", [
        ("database_name", DBN("o_custkey % 10")),
        ("role_principal_id", "o_custkey"),
        ("member_principal_id", spread_id("o_orderkey", 100, "o_custkey")),
    ], "group by 1, 2, 3, 4, 5", fleet="o_custkey"),
    "permissions": _b("orders", [
        ("database_name", DBN("o_custkey % 10")),
        ("grantee_principal_id", "o_custkey"),
        ("grantor_principal_id", spread_id("o_orderkey", 100, "o_custkey")),
        ("class", "case o_orderkey % 3 when 0 then 0 when 1 then 1 else 3 end"),
        ("major_id", "case when o_orderkey % 3 = 2 then o_orderkey % 5 else " + spread_id("o_orderkey", 75, "o_custkey") + " end"),
        ("type", "case when o_orderkey % 2 = 0 then 'CO' else 'SL' end"),
        ("state", "case o_orderstatus when 'F' then 'W' when 'O' then 'G' else 'D' end"),
        ("permission_name", "case when o_orderkey % 2 = 0 then 'CONNECT' else 'SELECT' end"),
    ], fleet="o_custkey"),
    "objects": _b("part", [
        ("database_name", DBN("p_partkey % 10")),
        ("object_id", "p_partkey"),
        ("schema_id", "p_size % 5"),
        ("name", "p_name || '_' || cast(p_partkey as string)"),
        ("type", "case p_size % 6 when 0 then 'IT' when 1 then 'S' when 2 then 'X' when 3 then 'P' else 'U' end"),
        ("is_ms_shipped", "p_size % 7 = 0"),
        ("parent_object_id", "case when p_partkey % 6 = 5 then null else " + spread_id("p_partkey", 60, "p_partkey") + " end"),
    ], fleet="p_partkey"),
    "schemas": _b("orders", [
        ("database_name", DBN("o_custkey % 10")),
        ("schema_id", "o_orderkey % 5"),
        ("name", "case o_orderkey % 5 when 0 then 'dbo' when 1 then 'sys' when 2 then 'sales' when 3 then 'hr' else 'MS_PerfDashboard' end"),
        ("principal_id", "o_orderkey % 5"),
    ], "group by o_custkey % 10, o_orderkey % 5", fleet="(o_custkey % 10)"),
    "protects": _b("lineitem", [
        ("database_name", DBN("l_partkey % 10")),
        ("id", "l_partkey"),
        ("uid", spread_id("l_orderkey", 100, "l_partkey")),
        ("action", "case l_linenumber when 1 then 193 when 2 then 195 when 3 then 196 when 4 then 197 when 5 then 224 when 6 then 26 else 999 end"),
        ("protecttype", "case l_returnflag when 'A' then 205 when 'R' then 206 else 204 end"),
    ], fleet="l_partkey"),
    "jobs": _b("part", [
        ("job_id", "p_partkey"),
        ("job_hex", "'0x' || lpad(cast(p_partkey as string), 32, '0')"),
        ("name", "p_name || case p_size % 4 when 0 then ' FULL' when 1 then ' dba' else '' end"),
        ("enabled", "p_size % 2"),
        ("owner_name", "case p_size % 3 when 0 then 'sa' when 1 then 'app' end"),
    ], fleet="p_partkey"),
    "job_steps": _b("lineitem", [
        ("job_id", "l_partkey"),
        ("step_id", "l_linenumber"),
        ("step_name", "l_returnflag || l_linestatus"),
        ("retry_attempts", "l_suppkey % 4"),
        ("retry_interval", "l_linenumber % 3"),
    ], fleet="l_partkey"),
    "modules": _b("part", [
        ("name", "case p_partkey % 37 when 5 then 'sophos_detoured.dll' when 9 then 'C:/av/SWI_ifslsp_64.DLL' when 12 then 'swi_ifslsp.dll' else p_name || '.DLL' end"),
    ], fleet="p_partkey"),
    "replica_states": _b("supplier", [
        ("group_id", "s_nationkey % 4"),
        ("replica_id", "s_suppkey % 7"),
        ("database_id", "s_suppkey + 1"),
        ("synchronization_state_desc", "case s_suppkey % 2 when 0 then 'SYNCHRONIZED' else 'SYNCHRONIZING' end"),
        ("synchronization_health_desc", "case s_nationkey % 3 when 0 then 'HEALTHY' when 1 then 'PARTIALLY_HEALTHY' else 'NOT_HEALTHY' end"),
        ("is_primary_replica", "s_suppkey % 7 = 0"),
        ("is_local", "s_suppkey % 2 = 0"),
        ("is_commit_participant", "s_suppkey % 3 = 0"),
        ("database_state_desc", "case when s_suppkey % 2 = 0 then 'ONLINE' else 'RECOVERING' end"),
        ("is_suspended", "s_suppkey % 9 = 0"),
        ("suspend_reason_desc", "case when s_suppkey % 9 = 0 then 'SUSPEND_FROM_USER' end"),
    ], fleet="s_suppkey"),
    "availability_groups": _b("nation", [
        ("server_name", "'srv' || cast(n_nationkey as string)"),
        ("snapshot_id", "cast(snap as int)"),
        ("group_id", "n_nationkey % 4"),
        ("group_name", "'ag' || cast(n_nationkey % 4 as string)"),
        ("synchronization_health_desc", "case when n_nationkey % 3 = 0 then 'HEALTHY' else 'NOT_HEALTHY' end"),
        ("primary_replica", "case when n_nationkey % 2 = 0 then 'srv' || cast(n_nationkey as string) else 'node' || cast(n_nationkey as string) end"),
    ], times=SNAPSHOTS),
    "replicas": _b("supplier", [
        ("replica_id", "s_suppkey % 7"),
        ("replica_server_name", "'node' || cast(s_suppkey % 7 as string)"),
        ("availability_mode_desc", "case when s_suppkey % 7 % 2 = 0 then 'SYNCHRONOUS_COMMIT' else 'ASYNCHRONOUS_COMMIT' end"),
    ], "group by s_suppkey % 10, s_suppkey % 7", fleet="(s_suppkey % 10)"),
    "trace_flags": _b("nation", [
        ("server_name", "'srv' || cast(n_nationkey as string)"),
        ("snapshot_id", "cast(snap as int)"),
        ("trace_flag", "case n_nationkey % 4 when 0 then '1117' when 1 then '1118' when 2 then '3226' else '2371' end"),
        ("is_global", "n_regionkey % 2 = 0"),
    ], times=SNAPSHOTS),
    "sku_features": _b("customer", [
        ("database_name", DBN("c_custkey % 10")),
        ("feature_name", "c_mktsegment"),
    ], fleet="c_custkey"),
    "services": _b("orders", [
        ("server_name", "'srv' || cast(o_orderkey % 25 as string)"),
        ("snapshot_id", "cast(snap as int)"),
        ("servicename", f"case when {_SERVICE} > o_orderkey % 25 % 5 then 'Other service ' || cast({_SERVICE} as string) else case {_SERVICE} when 0 then 'SQL Server (MSSQLSERVER)' when 1 then 'SQL Server Agent (MSSQLSERVER)' when 2 then 'MsDtsServer150' when 3 then 'MSSQLServerOLAPService' else 'ReportServer' end end"),
        ("service_account", f"'NT Service' || chr(92) || 'svc' || cast({_SERVICE} as string)"),
        ("instant_file_initialization_enabled", f"case when (o_orderkey % 25 + {_SERVICE}) % 2 = 0 then 'Y' else 'N' end"),
    ], f"group by o_orderkey % 25, {_SERVICE}, snap", times=SNAPSHOTS),
    "certificates": _b("customer", [
        ("database_name", DBN("c_custkey % 10")),
        ("certificate_id", "c_custkey + 1"),
        ("name", "'cert_' || cast(c_custkey as string)"),
        ("issuer_name", "'issuer' || cast(c_nationkey as string)"),
        ("expiry_date", "timestamp '2030-01-01 00:00:00'"),
        ("sid", _SID),
        ("thumbprint", "c_custkey % 40"),
    ], fleet="c_custkey"),
}

# A third of the requests belong to sessions that are not in the listing, so as many sessions are idle.
BINDINGS["requests"] = Binding("events", tuple(
    (c, "case when event_id % 3 = 0 then -1 - event_id else event_id + 50 end" if c == "spid" else e) for c, e in BINDINGS["processes"].cols))
BINDINGS["sessions"] = _b("events", [
    ("session_id", "event_id + 50"),
    ("status", "case event_type when 'view' then 'sleeping' when 'signup' then 'dormant' else 'running' end"),
    ("loginame", "'domain/login_number_' || cast(user_id as string)"),
    ("last_request_start_time", "ts"),
    ("last_request_end_time", "case when event_id % 4 = 0 then null else ts end"),
    ("reads", "event_id % 1000"),
    ("writes", "event_id % 100"),
    ("logical_reads", "event_id * 3"),
    ("lock_timeout", "case when event_id % 2 = 0 then -1 else 5000 end"),
    ("row_count", "event_id % 17"),
    ("login_time", "ts"),
    ("host_name", "'workstation_' || cast(user_id % 97 as string)"),
    ("program_name", "case when event_id % 7 = 0 then 'SQLAgent - TSQL JobStep (Job 0x' || lpad(cast(" + spread_id("event_id", 50, "user_id") + " as string), 32, '0') || ' : Step 1)' else 'app' || cast(user_id % 5 as string) end"),
], fleet="user_id")

BINDINGS["server_objects"] = _b("customer", [
    ("object_class", "case c_custkey % 22 when 0 then 'linked_server' when 1 then 'server_trigger' when 2 then 'procedure' when 3 then 'mail_profile' when 4 then 'mail_account' when 5 then 'agent_alert' when 6 then 'agent_operator' when 7 then 'agent_proxy' when 8 then 'maintenance_plan' when 9 then 'server_audit' when 10 then 'credential' when 11 then 'backup_device' when 12 then 'endpoint' when 13 then 'event_session' when 14 then 'policy' when 15 then 'condition' when 16 then 'symmetric_key' when 17 then 'asymmetric_key' when 18 then 'startup_parameter' when 19 then 'log_shipping_primary' when 20 then 'log_shipping_secondary' when 21 then 'mirroring' end"),
    ("object_id", "c_custkey % 12"),
    ("name", "case c_custkey % 5 when 0 then 'system_health' when 1 then '##MS_DatabaseMasterKey##' when 2 then 'MS_SQLEnableSystemAssemblyLoadingKey' else c_name end"),
    ("value", "case when c_custkey % 2 = 0 then '-T' || cast(c_custkey % 9000 as string) else '-dmaster' end"),
    ("is_remote", "c_acctbal < 0"),
    ("is_auto_executed", "c_custkey % 3 = 0"),
    ("is_system", "c_custkey % 4 = 0"),
    ("mirroring_guid", "case when c_custkey % 4 = 1 then 'G' || cast(c_custkey as string) end"),
], fleet="c_custkey")
BINDINGS["encryption_keys"] = _b("supplier", [
    ("database_id", "s_suppkey + 1"),
    ("encryptor_thumbprint", "s_suppkey % 40"),
    ("encryption_state", "1 + s_suppkey % 3"),
], fleet="s_suppkey")

# Raw driver tables each binding reads (for registering DuckDB views).
SOURCES = sorted({b.source for b in BINDINGS.values()})


def binding_sql(name: str, dialect: str = "spark", src: str | None = None) -> str:
    """SQL text of one binding. ``dialect`` only changes the NTZ literal."""
    b = BINDINGS[name]
    src = src or b.source
    if b.times:
        name, n = b.times
        each = f"explode(sequence(0, {n - 1}))" if dialect == "spark" else f"unnest(range({n}))"
        src = f"(select *, {each} as {name} from {src})"
    text = f"select {b.select_list()} from {src} {b.tail}".strip()
    if dialect == "spark":
        # Driver parquet timestamps are timestamp_ntz in Spark; keep literals NTZ too.
        text = text.replace("timestamp '", "timestamp_ntz '")
    return text


_RELATIONS: dict[tuple, DataFrame] = {}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One telemetry relation as a Spark DataFrame (lazy; scans are pruned).

    The analysed plan is kept per session, so repeated queries skip
    re-parsing the binding text (DataFrames are immutable)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, name)
    df = _RELATIONS.get(key)
    if df is None:
        b = BINDINGS[name]
        src = spark.read.parquet(f"{sf_dir}/{b.source}.parquet")
        df = _RELATIONS[key] = spark.sql(binding_sql(name, "spark", src="{src}"), src=src)
    return df


def with_clause(names) -> str:
    """``WITH`` prefix that defines the named bindings for a DuckDB oracle."""
    parts = [f"{n} as ({binding_sql(n, 'duckdb')})" for n in dict.fromkeys(names)]
    return "with " + ",\n".join(parts) + "\n"
