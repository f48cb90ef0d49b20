"""Family E — sessions and blocking.

Session snapshots are large (every session of every server at every
snapshot). Statement text is landed per server: it is attached by fleet key
and handle through ``lookup_join``, which spreads idle sessions (no handle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tsql import datediff_boundaries, tsql_len, tsql_substring
from ..plans.shape import kcols, lookup_join
from .backup import _as_of

# Transaction isolation level names (spelling as reported).
ISOLATION = {0: "Unspecified", 1: "ReadUncomitted", 2: "ReadCommitted", 3: "Repeatable",
             4: "Serializable", 5: "Snapshot"}
AGENT_PREFIX = "SQLAgent%Job%"


def _isolation(c):
    out = None
    for code, name in ISOLATION.items():
        out = F.when(c == code, name) if out is None else out.when(c == code, name)
    return out


def duration_text(start, as_of) -> F.Column:
    """'<h> hr <m> min <s> sec' from boundary counts: hours only past 60
    minutes, minutes only past 60 seconds; NULL start gives NULL."""
    mins = datediff_boundaries("minute", start, as_of)
    secs = datediff_boundaries("second", start, as_of)
    hr = F.when(mins > 60, F.concat(F.call_function("div", mins, F.lit(60)).cast("string"), F.lit(" hr ")))\
        .otherwise(F.lit(""))
    mn = F.when(secs > 60, F.concat((mins % 60).cast("string"), F.lit(" min "))).otherwise(F.lit(""))
    return F.concat(hr, mn, (secs % 60).cast("string"), F.lit(" sec"))


def statement_text(text, start_off, end_off, plus_one: bool = True, end_when_negative: bool = True):
    """Running statement from UTF-16 byte offsets. ``plus_one`` false keeps
    the blocking report's start = offset/2 (no +1)."""
    t = F.col(text)
    full = tsql_len(t) * 2
    end = F.when(F.col(end_off) < 0 if end_when_negative else F.col(end_off) == -1, full)\
        .otherwise(F.col(end_off))
    start = F.call_function("div", F.col(start_off), F.lit(2))
    length = F.call_function("div", end - F.col(start_off), F.lit(2))
    if plus_one:
        return tsql_substring(t, start + 1, length + 1)
    return tsql_substring(t, start, length)


def active_sessions(sessions: DataFrame, requests: DataFrame, sql_text: DataFrame,
                    databases: DataFrame, jobs: DataFrame, as_of, keys=None) -> DataFrame:
    """Every non-sleeping session with its request (NULL when idle):
    duration text, ETA minutes, running statement, wait seconds, Agent job
    name decoded from the program name, isolation level name."""
    k = kcols(keys)
    now = _as_of(as_of)
    req = requests.select(*k, F.col("spid").alias("session_id"), F.col("status").alias("req_status"),
                          F.col("blocked").alias("blocked_by"), "command", F.col("dbid").alias("database_id"),
                          "percent_complete", "start_time", "estimated_completion_time", "sql_handle",
                          "statement_start_offset", "statement_end_offset", "waittime",
                          F.col("wait_type").alias("last_wait_type"), F.col("open_tran").alias("open_transaction_count"),
                          "isolation_level", "cpu", "wait_resource")
    ses = sessions.filter(F.lower("status") != "sleeping").select(
        *k, "session_id", F.col("loginame").alias("original_login_name"), "login_time", "host_name",
        "program_name", "last_request_start_time", "last_request_end_time", "reads", "writes", "logical_reads",
        "lock_timeout", "row_count")
    # Text is attached after the session filter, so only surviving requests
    # carry (and shuffle) statement text.
    j = ses.join(req, k + ["session_id"], "left")
    j = lookup_join(j, sql_text.select(*k, "sql_handle", "text", F.col("object_id").alias("objectid")), k + ["sql_handle"], "left")
    dbs = databases.select(*k, "database_id", F.col("name").alias("database_name"))
    j = j.join(dbs, k + ["database_id"], "left")
    # Agent job: the job id's hex sits at characters 30..63 of the program name.
    agent = F.lower("program_name").like(AGENT_PREFIX.lower())
    jb = jobs.select(*k, F.upper("job_hex").alias("_prog_hex"), F.col("name").alias("_job_name"))
    j = j.withColumn("_prog_hex", F.when(agent, F.upper(F.substring("program_name", 30, 34))))
    j = j.join(jb, k + ["_prog_hex"], "left")
    after_colon = F.expr("right(program_name, length(program_name) - instr(program_name, ':'))")
    prog = F.when(agent, F.concat(F.lit("(SQLAgent Job - "), F.col("_job_name"), F.lit(" - "), after_colon))\
        .otherwise(F.col("program_name"))
    return j.select(
        *k, "session_id", "original_login_name", F.col("req_status").alias("status"), "blocked_by", "command",
        "database_name", "percent_complete",
        duration_text(F.col("start_time"), now).alias("duration"),
        F.call_function("div", F.col("estimated_completion_time"), F.lit(60000)).alias("eta_min"),
        "text", statement_text("text", "statement_start_offset", "statement_end_offset").alias("running_statement"),
        F.call_function("div", F.col("waittime"), F.lit(1000)).alias("wait_time_sec"), "last_wait_type",
        "login_time", "host_name", prog.alias("program_name"), "open_transaction_count",
        _isolation(F.col("isolation_level")).alias("transaction_isolation_level"), "cpu", "objectid", "wait_resource",
        "last_request_start_time", "last_request_end_time", "reads", "writes", "logical_reads", "lock_timeout", "row_count")


def lead_blockers(processes: DataFrame, requests: DataFrame, sql_text: DataFrame, databases: DataFrame,
                  keys=None) -> DataFrame:
    """Sessions that block others and are not blocked themselves, with
    names cut to 12/12/10 characters and the statement taken from offset/2
    without +1 (as the source does). Duplicate spids are kept."""
    k = kcols(keys)
    blockers = processes.select(*k, F.col("blocked").alias("spid")).distinct()
    lead = processes.filter(F.col("blocked") == 0).join(blockers, k + ["spid"], "left_semi").select(
        *k, "spid", "status", "loginame", "hostname", "blocked", "open_tran", "dbid", "command", "waittype",
        "waittime", "last_batch")
    er = requests.select(*k, "spid", "sql_handle", "statement_start_offset", "statement_end_offset")
    dbs = databases.select(*k, F.col("database_id").alias("dbid"), F.col("name").alias("_dbname"))
    j = lead.join(er, k + ["spid"], "left").join(dbs, k + ["dbid"], "left")
    # Only lead blockers get their statement text.
    j = lookup_join(j, sql_text.select(*k, "sql_handle", "text"), k + ["sql_handle"], "left")
    return j.select(
        *k, "spid", "status", F.substring("loginame", 1, 12).alias("loginame"),
        F.substring("hostname", 1, 12).alias("hostname"),
        F.rpad(F.col("blocked").cast("string"), 3, " ").alias("blk"), "open_tran",
        F.substring("_dbname", 1, 10).alias("dbname"), F.col("command").alias("cmd"), "waittype", "waittime",
        "last_batch",
        statement_text("text", "statement_start_offset", "statement_end_offset", plus_one=False,
                       end_when_negative=False).alias("sql_statement"))


def rolling_back(processes: DataFrame, keys=None) -> DataFrame:
    """Sessions killed and still rolling back."""
    return processes.filter(F.lower("command") == "killed/rollback").select(
        *kcols(keys), "spid", "kpid", "login_time", "last_batch", "status", "hostname", "loginame", "cpu",
        "physical_io", "nt_username", "hostprocess", "memusage")


def sessions_in_database(processes: DataFrame, databases: DataFrame, self_spid: int | None = None,
                         keys=None) -> DataFrame:
    """Per database, the lowest session id and the number of sessions
    connected to it (excluding ``self_spid``) — what a kill loop would visit."""
    k = kcols(keys)
    p = processes if self_spid is None else processes.filter(F.col("spid") != self_spid)
    a = p.groupBy(*k, "dbid").agg(F.min("spid").alias("min_spid"), F.count(F.lit(1)).alias("session_count"))
    dbs = databases.select(*k, F.col("database_id").alias("dbid"), F.col("name").alias("database_name"))
    return a.join(dbs, k + ["dbid"], "inner").select(*k, "database_name", "min_spid", "session_count")
