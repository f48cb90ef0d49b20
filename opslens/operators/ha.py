"""Family H — availability groups.

H3 reads extended-event payloads (XML text). Each payload is parsed once
with ``from_xml`` into just the fields used; the operator is stateless, so
it runs unchanged on a streaming event source (see ``streaming``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rules import run_checks
from ..plans.shape import kcols, spread
from . import checks as K

STATE_CHANGE = "availability_replica_state_change"
EVENT_SCHEMA = "_timestamp string, data array<struct<_name: string, value: string, text: string>>"


def ag_replicas(replica_states: DataFrame, groups: DataFrame, replicas: DataFrame, databases: DataFrame,
                keys=None) -> DataFrame:
    """H1: per database replica: group, replica server, role, synchronization
    state and health, availability mode."""
    k = kcols(keys)
    g = groups.select(*k, "group_id", "group_name")
    r = replicas.select(*k, "replica_id", "replica_server_name", "availability_mode_desc")
    d = databases.select(*k, "database_id", F.col("name").alias("database_name"))
    j = replica_states.join(g, k + ["group_id"], "inner").join(r, k + ["replica_id"], "inner") \
        .join(d, k + ["database_id"], "left")
    return j.select(*k, "database_name", "group_name", "replica_server_name", "is_primary_replica",
                    "synchronization_state_desc", "synchronization_health_desc", "availability_mode_desc", "is_local",
                    "is_commit_participant", "database_state_desc", "is_suspended", "suspend_reason_desc")


def ag_health(groups: DataFrame, keys=None) -> DataFrame:
    """H2: finding per server when any availability group is not healthy."""
    return run_checks([K.AG_HEALTH], {"availability_groups": groups}, keys)


def _data(arr, name, field):
    return F.try_element_at(F.filter(arr, lambda d: d["_name"] == name), F.lit(1))[field]


def ag_state_changes(xe_events: DataFrame, utc_offset_hours: int = 0, tz: str | None = None,
                     keys=None, streaming: bool = False) -> DataFrame:
    """H3: replica state changes from the availability-group event files:
    local event time, group, previous and current state (NULL when absent).

    ``tz`` converts by time-zone rules (DST-correct); otherwise a fixed
    ``utc_offset_hours`` is added, as the source does with today's offset."""
    k = kcols(keys)
    ev = xe_events.filter(F.col("object_name") == STATE_CHANGE)
    x = (ev if streaming or ev.isStreaming else spread(ev)) \
        .select(*k, "object_name", F.from_xml("event_data", EVENT_SCHEMA).alias("e"))
    ts = F.col("e._timestamp").try_cast("timestamp_ntz")
    if tz:
        local = F.from_utc_timestamp(ts.cast("timestamp"), tz).cast("timestamp_ntz")
    else:
        local = F.timestamp_add("HOUR", F.lit(utc_offset_hours), ts)
    arr = F.col("e.data")
    return x.select(*k, "object_name", local.alias("event_timestamp"),
                    _data(arr, "availability_group_name", "value").alias("ag_name"),
                    _data(arr, "previous_state", "text").alias("previous_state"),
                    _data(arr, "current_state", "text").alias("current_state"))
