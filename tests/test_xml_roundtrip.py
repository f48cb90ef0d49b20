"""XML round trip: event payloads built from columns (with
characters that need escaping) parse back to the same columns; a missing
element gives NULL."""

from pyspark.sql import functions as F

from opslens.operators import ha as H, index as G

VALUES = [("ag&1", "PRIMARY<x>", "RESOLVING \"q\""), ("plain", "SECONDARY_NORMAL", None), ("a'b", "x > y", "z")]


def _esc(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def test_event_payload_round_trip(spark):
    df = spark.createDataFrame([("s", 0, i, *v) for i, v in enumerate(VALUES)],
                               "server_name string, snapshot_id int, i int, ag string, prev string, cur string")
    cur = F.when(F.col("cur").isNotNull(),
                 F.concat(F.lit('<data name="current_state"><text>'), _esc(F.col("cur")), F.lit("</text></data>"))) \
        .otherwise(F.lit(""))
    xe = df.select("server_name", "snapshot_id", "i", F.lit(H.STATE_CHANGE).alias("object_name"), F.concat(
        F.lit('<event name="x" timestamp="2024-01-0'), (F.col("i") + 1).cast("string"), F.lit(' 10:00:00">'),
        F.lit('<data name="availability_group_name"><value>'), _esc(F.col("ag")), F.lit("</value></data>"),
        F.lit('<data name="previous_state"><text>'), _esc(F.col("prev")), F.lit("</text></data>"), cur,
        F.lit("</event>")).alias("event_data"))
    out = sorted((r.ag_name, r.previous_state, r.current_state, r.event_timestamp.day)
                 for r in H.ag_state_changes(xe.drop("i")).collect())
    assert out == sorted((a, p, c, i + 1) for i, (a, p, c) in enumerate(VALUES))


def test_namespaced_event_still_parses(spark):
    xe = spark.createDataFrame([("s", 0, H.STATE_CHANGE,
                                 '<event xmlns="urn:x" timestamp="2024-01-01 00:00:00"><data name="availability_group_name">'
                                 "<value>ag</value></data></event>")],
                               "server_name string, snapshot_id int, object_name string, event_data string")
    r = H.ag_state_changes(xe).collect()[0]
    assert (r.ag_name, r.previous_state) == ("ag", None)


def test_plan_statement_round_trip(spark):
    plan = ('<ShowPlanXML xmlns="http://schemas.microsoft.com/sqlserver/2004/07/showplan"><BatchSequence><Batch>'
            '<Statements><StmtSimple StatementText="select &quot;a&quot; &amp; b"><QueryPlan><MissingIndexes>'
            '<MissingIndexGroup Impact="12.5"><MissingIndex Database="[d]" Schema="[s]" Table="[t_1]">'
            '<ColumnGroup Usage="EQUALITY"><Column Name="[z]"/><Column Name="[a]"/><Column Name="[a]"/></ColumnGroup>'
            '<ColumnGroup Usage="INCLUDE"><Column Name="[c]"/></ColumnGroup></MissingIndex></MissingIndexGroup>'
            '</MissingIndexes></QueryPlan></StmtSimple><StmtSimple StatementText="no index"/></Statements>'
            '</Batch></BatchSequence></ShowPlanXML>')
    plans = spark.createDataFrame([("s", 0, 500, plan)], "server_name string, snapshot_id int, usecounts long, "
                                  "query_plan string")
    r = G.missing_indexes_from_plans(plans).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.sql_text, r.impact, r.equality_columns, r.inequality_columns, r.include_columns) == \
        ('select "a" & b', 12.5, "[a], [z]", None, "[c]")
    assert r.potential_ddl == "CREATE NONCLUSTERED INDEX IX_s_t1_az ON [s].[t_1]([a], [z]) INCLUDE ([c])"


def test_time_zone_conversion_is_dst_aware(spark):
    ev = lambda ts: ("s", 0, H.STATE_CHANGE, f'<event timestamp="{ts}"><data name="availability_group_name">'  # noqa: E731
                     "<value>ag</value></data></event>")
    xe = spark.createDataFrame([ev("2024-01-15 12:00:00"), ev("2024-07-15 12:00:00")],
                               "server_name string, snapshot_id int, object_name string, event_data string")
    by_tz = sorted(r.event_timestamp.hour for r in H.ag_state_changes(xe, tz="America/New_York").collect())
    fixed = sorted(r.event_timestamp.hour for r in H.ag_state_changes(xe, utc_offset_hours=-5).collect())
    assert by_tz == [7, 8]   # EST in January, EDT in July
    assert fixed == [7, 7]   # the source's "today's offset" applied to every event
