"""Interval joins by blocks, and version rules from landed tables."""

import random

from pyspark.sql import functions as F

from opslens.operators import instance as A
from opslens.plans.intervals import LEVELS, interval_keys, point_keys


def test_points_and_intervals_share_one_block_or_none(spark):
    rng = random.Random(1)
    top = 2 ** LEVELS - 1
    ends = [(0, 0), (0, top), (top, top), (5, 4), (3, 1 << 30), (7, 1 << 40), (-3, 2)] + \
        [tuple(sorted(rng.choice([rng.randrange(50), rng.randrange(top)]) for _ in range(2))) for _ in range(200)]
    points = sorted({0, 1, 2, 3, 4, 5, 7, 8, top, *[x + k for lo, hi in ends for x in (lo, hi) for k in (-1, 0, 1) if 0 <= x + k <= top]})
    i = spark.createDataFrame([(n, lo, hi) for n, (lo, hi) in enumerate(ends)], "i int, lo long, hi long")
    p = spark.createDataFrame([(x,) for x in [*points, -1, None]], "p long")
    joined = p.withColumn("b", F.explode(point_keys(F.col("p")))).join(i.withColumn("b", F.explode(interval_keys(F.col("lo"), F.col("hi")))), "b")
    got = sorted((r.p, r.i) for r in joined.select("p", "i").collect())
    assert got == sorted((x, n) for x in points for n, (lo, hi) in enumerate(ends) if lo <= x <= hi)


def test_landed_rules_equal_the_fixed_ones_and_grow(spark):
    versions = ["11.0.5058.0", "13.0.5026.0", "10.50.4000.0", "14.0.2000.0", "15.0.2000.5", "11.0.3000.0", "7.0.623.0", None, "bad"]
    inst = spark.createDataFrame([(f"s{i}", 0, v) for i, v in enumerate(versions)], "server_name string, snapshot_id int, product_version string")
    fixed = spark.createDataFrame(A.support_rules() + A.risk_rules() + A.patch_rules(), A.RULE_SCHEMA)
    more = spark.range(20_000).select(F.lit("patch").alias("rule_set"), F.lit("15").alias("major"), F.lit(None).cast("string").alias("minor_prefix"),
                                      F.col("id").alias("lo"), (F.col("id") + 3).alias("hi"), F.lit(None).cast("string").alias("exact_version"),
                                      (F.lit(30_000) - F.col("id")).cast("int").alias("priority"), F.col("id").cast("string").alias("outcome"),
                                      F.lit(False).alias("obsolete"), F.lit(None).cast("int").alias("compat"), F.array(F.lit("m")).alias("messages"))
    for check in (A.support_level, A.risky_build, A.side_channel_patch):
        assert sorted(map(repr, check(spark, inst).collect())) == sorted(map(repr, check(spark, inst, rules=fixed).collect()))
    landed = A.side_channel_patch(spark, inst, rules=fixed.unionByName(more))
    assert {r.server_name: r.patch_status for r in landed.collect()}["s4"] == "2000"
    plan = landed._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
