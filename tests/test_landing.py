"""Snapshot choice, result replacement, rollover sets, per-database output."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opslens.operators import storage as C
from opslens.plans.stored import new_folder
from opslens.sources import database_output as O, results as R, rollover as V, snapshots as N

SNAPC = "server_name string, snapshot_id int"


# ------------------------------------------------------------- snapshot choice
def _register(spark, rows):
    return spark.createDataFrame(rows, f"{SNAPC}, snapshot_ts string, view_name string").withColumn("snapshot_ts", F.col("snapshot_ts").cast("timestamp_ntz"))


def test_newest_complete_snapshot_at_a_time(spark):
    register = _register(spark, [("a", 1, "2024-01-01 00:00:00", "x"), ("a", 1, "2024-01-01 00:05:00", "y"), ("a", 2, "2024-01-02 00:00:00", "x"),
                                 ("a", 2, "2024-01-02 00:00:00", "x"), ("a", 3, "2024-01-03 00:00:00", "x"), ("a", 3, "2024-01-03 00:00:00", "y"),
                                 ("b", 7, "2024-01-01 00:00:00", "x"), ("c", 1, "2024-01-02 00:00:00", "x"), ("c", 1, "2024-01-02 00:00:00", "y"),
                                 ("c", 2, "2024-01-02 00:00:00", "x"), ("c", 2, "2024-01-02 00:00:00", "y"), ("c", 3, "2024-01-09 00:00:00", "z")])
    chosen = lambda *views, at=None: {r.server_name: r.snapshot_id for r in N.newest_snapshots(register, views, at).collect()}
    assert chosen("x", "y") == {"a": 3, "c": 2}
    assert chosen("x", "y", at="2024-01-02 12:00:00") == {"a": 1, "c": 2}
    assert chosen("x", "y", at="2024-01-01 00:04:59") == {}
    assert chosen("x", at="2024-01-02 12:00:00") == {"a": 2, "b": 7, "c": 2}
    assert chosen() == {"a": 3, "b": 7, "c": 3}


def test_only_chosen_partitions_are_read(spark):
    root = new_folder(spark)
    rows = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 10).alias("server_name"), (F.col("id") % 40 / 10).cast("int").alias("snapshot_id"),
                                   F.col("id").cast("string").alias("name"), F.lit("o").alias("owner_name"))
    rows.repartition(1).write.partitionBy("server_name", "snapshot_id").parquet(f"{root}/packages")
    register = _register(spark, [(f"s{s}", i, f"2024-01-0{i + 1} 00:00:00", "packages") for s in range(10) for i in range(4) if s < 8 or i < 2])
    register.write.parquet(f"{root}/register")
    got = N.load_newest(spark, root, ["packages"])["packages"]
    assert Counter((r.server_name, r.snapshot_id) for r in got.collect()) == Counter({(f"s{s}", 3 if s < 8 else 1): 10 for s in range(10)})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan, plan
    scans = [x for x in _leaves(got._jdf.queryExecution().executedPlan()) if "packages" in x.toString() and x.metrics().contains("numPartitions")]
    assert {x.metrics().apply("numPartitions").value() for x in scans} == {10}  # of 40


def _leaves(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _leaves(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return _leaves(plan.plan())
    children = plan.children()
    kids = [children.apply(i) for i in range(children.size())]
    return [plan] if not kids else [x for c in kids for x in _leaves(c)]


# --------------------------------------------------------- result replacement
def _rows(spark, values):
    return spark.createDataFrame(values, "server_name string, snapshot_ts string, v string").withColumn("snapshot_ts", F.col("snapshot_ts").cast("timestamp"))


def _pairs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "snapshot_date string, server_name string")


def test_a_run_replaces_what_it_covers(spark):
    root, day = new_folder(spark), "2024-01-02 10:00:00"
    now = lambda: sorted((r.server_name, str(r.snapshot_date), r.v) for r in R.read_results(spark, root).collect())
    first = R.replace_results(_rows(spark, [("a", day, "1"), ("b", day, "1"), ("a", "2024-01-03 00:00:00", "1")]), root,
                              _pairs(spark, ("2024-01-02", "a"), ("2024-01-02", "b"), ("2024-01-03", "a")))
    assert now() == [("a", "2024-01-02", "1"), ("a", "2024-01-03", "1"), ("b", "2024-01-02", "1")]
    R.replace_results(_rows(spark, [("b", day, "2"), ("b", day, "3")]), root, _pairs(spark, ("2024-01-02", "a"), ("2024-01-02", "b"), ("2024-01-02", "b")))
    assert now() == [("a", "2024-01-03", "1"), ("b", "2024-01-02", "2"), ("b", "2024-01-02", "3")]
    # A run without any rows clears what it covers; rows outside of its cover are not read.
    R.replace_results(_rows(spark, []), root, _pairs(spark, ("2024-01-02", "b")))
    R.replace_results(_rows(spark, [("c", day, "9")]), root, _pairs(spark, ("2024-01-05", "c")))
    assert now() == [("a", "2024-01-03", "1")]
    assert first not in {r.run for r in R.superseded_runs(spark, root).collect()}


def test_a_run_that_dies_changes_nothing(spark):
    root, day = new_folder(spark), "2024-01-02 10:00:00"
    R.replace_results(_rows(spark, [("a", day, "1")]), root, _pairs(spark, ("2024-01-02", "a")))
    run = R.stage_run(_rows(spark, [("a", day, "2")]), root)                   # dies before it is published
    spark.createDataFrame([(run, 1 << 62, 2, "2024-01-02", "a")], "run string, published long, covered long, snapshot_date string, server_name string") \
        .withColumn("snapshot_date", F.to_date("snapshot_date")).write.mode("append").parquet(f"{root}/manifest")   # dies within the manifest
    assert [r.v for r in R.read_results(spark, root).collect()] == ["1"]


# -------------------------------------------------------------- rollover sets
def test_names_of_sets_and_numbers(spark):
    paths = {"/x/server_name=a/snapshot_id=1/log_12.trc/part-0.parquet": ("log", 12), "/x/log.trc": ("log", 0), "/x/AlwaysOn_health_0_1330.xel.json": ("AlwaysOn_health", 1330),
             "/x/landed_file=log_3.trc/part-1": ("log", 3), "/x/my_log_7.trc": ("my_log", 7), "/x/other.txt": (None, None)}
    got = {r.p: (r.s, r.n) for r in spark.createDataFrame([(p,) for p in paths], "p string")
           .select("p", V.file_set(F.col("p")).alias("s"), V.file_number(F.col("p")).alias("n")).collect()}
    assert got == paths


EVENT = f"{SNAPC}, event_class int, database_name string, start_time timestamp_ntz"
# (file number, event class, database): two events of file 2 are equal.
EVENTS = [(1, 92, "a"), (2, 92, "b"), (2, 92, "b"), (2, 93, "c"), (3, 94, "d"), (3, 94, None)]


def _land(spark, root, snapshot, numbers, extra=()):
    rows = [(e, d, n) for n, e, d in [*EVENTS, *extra] if n in numbers]
    spark.createDataFrame(rows, "event_class int, database_name string, n int") \
        .withColumn("start_time", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")) \
        .withColumn("server_name", F.lit("s")).withColumn("snapshot_id", F.lit(snapshot)) \
        .withColumn("f", F.concat(F.lit("log_"), F.col("n").cast("string"), F.lit(".trc"))).drop("n") \
        .repartition(2).write.mode("append").partitionBy("server_name", "snapshot_id", "f").parquet(root)


def _seen(rows):
    return Counter((r.file_no, r.event_class, r.database_name) for r in rows)


def test_events_of_three_snapshots_count_once(spark):
    root = new_folder(spark)
    _land(spark, root, 1, {1, 2})
    _land(spark, root, 2, {1, 2, 3})
    _land(spark, root, 3, {2, 3}, extra=[(3, 95, "late")])
    once = V.events_once(V.read_rollover(spark, root, EVENT))
    assert _seen(once.collect()) == Counter([*EVENTS, (3, 95, "late")])
    assert {r.database_name: r.snapshot_id for r in once.collect()}["late"] == 3
    names = spark.createDataFrame([("s", i, n, f"e{n}") for i in (1, 2, 3) for n in range(92, 96)], f"{SNAPC}, trace_event_id int, event_name string")
    grown = C.trace_coverage(once.drop("file_set", "file_no"), names)
    assert grown.count() == 3


def test_ledger_across_loads_and_reruns(spark):
    root, ledger, out = new_folder(spark), new_folder(spark), new_folder(spark)
    sink = lambda batch: lambda rows: rows.write.mode("overwrite").parquet(f"{out}/b={batch}")
    got = lambda batch: _seen(spark.read.schema(f"{EVENT}, file_set string, file_no long").parquet(f"{out}/b={batch}").collect())
    for batch, numbers in ((1, {1, 2}), (2, {2, 3}), (3, {1, 2, 3})):
        _land(spark, f"{root}/{batch}", batch, numbers)
        V.take_new(V.read_rollover(spark, f"{root}/{batch}", EVENT), ledger, batch, sink(batch))
    assert got(1) == Counter(e for e in EVENTS if e[0] < 3) and got(2) == Counter(e for e in EVENTS if e[0] == 3) and got(3) == Counter()
    with pytest.raises(ZeroDivisionError):  # a sink that dies leaves the ledger as it was
        _land(spark, f"{root}/4", 4, {3}, extra=[(3, 95, "late")])
        V.take_new(V.read_rollover(spark, f"{root}/4", EVENT), ledger, 4, lambda rows: 1 / 0)
    for _ in range(2):  # and a batch that is run again gives the same
        V.take_new(V.read_rollover(spark, f"{root}/4", EVENT), ledger, 4, sink(4))
        assert got(4) == Counter([(3, 95, "late")])


def test_stream_equals_batch(spark):
    root, ledger, out, checkpoint = (new_folder(spark) for _ in range(4))
    events = lambda **how: V.read_rollover(spark, root, EVENT, **how)
    sink = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/b={batch}")
    for snapshot, numbers in ((1, {1, 2}), (2, {1, 2, 3}), (3, {2, 3})):
        _land(spark, root, snapshot, numbers)
        V.stream_once(events(stream=True, options={"maxFilesPerTrigger": 1}), ledger, checkpoint, sink).awaitTermination()
    taken = spark.read.schema(f"{EVENT}, file_set string, file_no long").parquet(out)
    assert _seen(taken.collect()) == _seen(V.events_once(events()).collect()) == Counter(EVENTS)


# -------------------------------------------------------- per-database output
def test_drifting_and_broken_databases_do_not_stop_the_others(spark, tmpdir_path):
    def land(database, *lines):
        folder = os.path.join(tmpdir_path, "server_name=s", "snapshot_id=3", f"database_name={database}")
        os.makedirs(folder)
        with open(os.path.join(folder, "out.json"), "wb") as f:
            f.write(b"\n".join(x if isinstance(x, bytes) else json.dumps(x).encode() for x in lines))
    land("good", {"name": "a", "size": 5}, {"size": "6", "name": "b"})
    land("2019", {"name": "c", "bytes": 7, "extra": {"x": 1}}, {"name": "d"})
    land("broken", b"\xff\xfe\x00 not json", b'{"name": "e", "siz', {"name": "f", "size": "many"}, {"size": 1}, [1, 2], {"name": "g", "size": 9})
    land("empty")
    out = O.read_output(spark, tmpdir_path, "name string, size int", required=["name"], renames={"bytes": "size"})
    assert sorted((r.database_name, r.name, r["size"], r.snapshot_id) for r in O.good_rows(out).collect()) == sorted(
        [("good", "a", 5, 3), ("good", "b", 6, 3), ("2019", "c", 7, 3), ("2019", "d", None, 3), ("broken", "g", 9, 3)], key=str)
    bad = Counter(x for r in O.quarantine(out).collect() for x in r.reasons)
    assert bad == Counter({"not a JSON object": 3, "size: many is no int": 1, "name is missing": 1})
    assert all("database_name=broken" in r.file for r in O.quarantine(out).collect())
    drift = {(r.database_name, r.column_name): (r.declared, r.n_lines) for r in O.drift(out).collect()}
    assert drift[("2019", "extra")] == (False, 1) and drift[("2019", "size")] == (True, 1) and drift[("good", "name")] == (True, 2)
