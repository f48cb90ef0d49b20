"""NOT IN per scope, compared with DuckDB's three-valued NOT IN; names of
system databases without case; equal database names."""

import datetime as dt

import duckdb

from opslens.operators import backup as D, discovery as K
from opslens.plans.notin import not_in

SNAPC = "server_name string, snapshot_id int"
SCHEMA = f"{SNAPC}, v int"
ROWS = [("s", 0, 1), ("s", 0, 2), ("s", 0, None), ("t", 0, 1), ("t", 0, None), ("t", 0, None), ("u", 0, 1), ("u", 0, None), ("s", 1, 2)]
VALUES = [("s", 0, 2), ("s", 0, 2), ("t", 0, None), ("t", 0, 5), ("s", 1, None)]


def test_matches_three_valued_not_in(spark):
    con = duckdb.connect()
    for name, rows in (("x", ROWS), ("y", VALUES)):
        con.execute(f"create table {name} (server_name text, snapshot_id int, v int)")
        con.executemany(f"insert into {name} values (?, ?, ?)", rows)
    want = con.execute("select * from x where v not in (select v from y where y.server_name = x.server_name and y.snapshot_id = x.snapshot_id)").fetchall()
    got = not_in(spark.createDataFrame(ROWS, SCHEMA), "v", spark.createDataFrame(VALUES, SCHEMA), "v", ["server_name", "snapshot_id"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()


def test_no_values_keep_everything(spark):
    got = not_in(spark.createDataFrame(ROWS, SCHEMA), "v", spark.createDataFrame([], SCHEMA), "v", ["server_name", "snapshot_id"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(ROWS, key=repr)


def test_objects_without_parent_id(spark):
    schema = f"{SNAPC}, database_name string, object_id long, schema_id int, name string, type string, is_ms_shipped boolean, parent_object_id long"
    objects = spark.createDataFrame([
        ("s", 0, "master", 1, 1, "a", "U", True, 0), ("s", 0, "master", 2, 1, "b", "U", False, None), ("s", 0, "master", 3, 1, "c", "U", False, 0),
        ("s", 0, "model", 2, 1, "b", "U", False, None), ("s", 0, "model", 3, 1, "c", "U", False, 2)], schema)
    schemas = spark.createDataFrame([("s", 0, d, 1, "dbo", 1) for d in ("master", "model")],
                                    f"{SNAPC}, database_name string, schema_id int, name string, principal_id int")
    assert {(r.database_name, r.user_objects) for r in K.user_object_counts(objects, schemas).collect()} == {("master", 1), ("model", 2)}


def test_names_without_case_and_equal_names(spark):
    databases = spark.createDataFrame([("s", 0, 5, "Db", 1, None), ("s", 0, 6, "Db", 1, None), ("s", 0, 1, "MASTER", 3, None)],
                                      f"{SNAPC}, database_id long, name string, recovery_model int, source_database_id int")
    backups = spark.createDataFrame([("s", 0, "Db", t, "FULL", dt.datetime(2001, 1, d)) for t, d in (("D", 2), ("D", 4), ("L", 3))],
                                    f"{SNAPC}, database_name string, type string, recovery_model string, backup_finish_date timestamp_ntz")
    assert [r.database_name for r in D.backup_plan(databases, "x/", "2001-02-01 00:00:00").collect()] == ["Db", "Db"]
    full = {r.database_name: r.last_full_backup for r in D.last_full_backup(databases, backups).collect()}
    assert D.last_full_backup(databases, backups).count() == 2 and full == {"Db": dt.datetime(2001, 1, 4), "MASTER": None}
    assert [tuple(r)[2:] for r in D.stale_log_backup(databases, backups, "2001-02-01 00:00:00").collect()] == [("Db", dt.datetime(2001, 1, 3), 29)]
    assert [r.observed for r in D.stale_log_backup_count(databases, backups, "2001-02-01 00:00:00").collect()] == ["1"]
