"""Distributed numbering against a plain row number."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from opslens.plans.numbering import numbered


def test_matches_row_number_with_a_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.xxhash64("id").alias("v"), "id")
    got = numbered(rows, ["g"], ["v", "id"], total="n")
    group = Window.partitionBy("g")
    want = rows.withColumn("seq", F.row_number().over(group.orderBy("v", "id")).cast("long")).withColumn("n", F.count(F.lit(1)).over(group))
    assert got.columns == ["g", "v", "id", "seq", "n"]
    assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(want.collect(), key=lambda r: r["id"])


def test_one_group_without_keys_and_nulls_first(spark):
    rows = spark.createDataFrame([(None,), ("b",), ("a",), ("b",)], "x string")
    assert sorted((r["seq"], r["x"]) for r in numbered(rows, [], ["x"]).collect()) == [(1, None), (2, "a"), (3, "b"), (4, "b")]


def test_empty_table(spark):
    assert numbered(spark.createDataFrame([], "x string, y int"), ["x"], ["y"]).collect() == []
