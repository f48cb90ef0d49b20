"""Pattern tables against comparing every pair."""

import random

import duckdb

from opslens.operators import database as B, job as I
from opslens.plans.patterns import like_any_of, match_patterns


def test_ten_thousand_patterns_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcXY.\\[(é0") for _ in range(n))
    texts = [word(rng.randrange(1, 14)) + rng.choice([".dll", ".DLL", "", "_x"]) for _ in range(300)] + ["", "a", "%", "_"]
    patterns = {rng.choice(["%", "", "_"]) + word(rng.randrange(0, 4)) + rng.choice(["%", "_", ""]) + word(rng.randrange(0, 3)) + rng.choice(["%", "%.dll", ""])
                for _ in range(14_000)} | {"%", "", "_", "__", "%%", "%a%", "a_c%"}
    patterns = sorted(patterns)[:10_000]
    con = duckdb.connect()
    con.execute("create table t (v text)")
    con.execute("create table p (pattern text)")
    con.execute("insert into t select unnest(?)", [texts])
    con.execute("insert into p select unnest(?)", [patterns])
    want = con.execute("select v, pattern from t, p where lower(v) like lower(pattern)").fetchall()
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "v string")
    table = spark.createDataFrame([(p, i) for i, p in enumerate(patterns)] + [(None, -1)], "pattern string, number int")
    pairs = match_patterns(rows, "v", table)
    assert sorted((r.v, r.pattern) for r in pairs.collect()) == sorted(want)
    assert sorted(r.v for r in like_any_of(rows, "v", table).collect()) == sorted(t for t in texts if t in {v for v, _ in want})
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pattern_tables_equal_the_fixed_lists(spark):
    modules = spark.createDataFrame([("s", 0, n) for n in ("C:\\x\\Sophos_a.DLL", "swi_ifslsp.dll", "other.dll", None)] + [("t", 0, "a.dll")],
                                    "server_name string, snapshot_id int, name string")
    table = spark.createDataFrame([(p,) for p in B.MODULE_PATTERNS], "pattern string")
    for check in (B.module_listing, B.module_check):
        assert sorted(map(repr, check(modules).collect())) == sorted(map(repr, check(modules, patterns=table).collect()))
    jobs = spark.createDataFrame([("s", 0, 1, "Nightly FULL", 1), ("s", 0, 2, "other", 1)], "server_name string, snapshot_id int, job_id int, name string, enabled int")
    steps = spark.createDataFrame([("s", 0, j, "x", 1, 0, 0) for j in (1, 2)],
                                  "server_name string, snapshot_id int, job_id int, step_name string, step_id int, retry_attempts int, retry_interval int")
    table = spark.createDataFrame([(p,) for p in I.MAINTENANCE_PATTERNS], "pattern string")
    assert sorted(I.maintenance_job_steps(jobs, steps).collect()) == sorted(I.maintenance_job_steps(jobs, steps, patterns=table).collect())
