"""Views landed bucketed by the fleet key join and aggregate without a shuffle."""

from opslens.operators import storage as C
from opslens.sources import loader as L
from opslens.sources.bindings import relation

from .conftest import SF_SMALL


def test_bucketed_landings_join_without_exchange(spark):
    L.land_bucketed(relation(spark, SF_SMALL, "databases"), "dbs_bucketed", 8)
    L.land_bucketed(relation(spark, SF_SMALL, "master_files"), "files_bucketed", 8)
    dbs, files = spark.table("dbs_bucketed"), spark.table("files_bucketed")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for two large landings
    try:
        joined = files.join(dbs.select("server_name", "snapshot_id", "state_desc"), ["server_name", "snapshot_id"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan, plan
        # A per-server check over a bucketed landing needs no shuffle either.
        check = C.tempdb_file_count(files)
        assert "Exchange hashpartitioning" not in check._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert check.count() == C.tempdb_file_count(relation(spark, SF_SMALL, "master_files")).count()
