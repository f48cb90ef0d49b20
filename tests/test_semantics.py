"""Dialect rules of SURVEY 1.3 on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from opslens.functions import tsql as T


def one(spark, col, schema="x int"):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def test_integer_division_truncates(spark):
    assert one(spark, T.idiv(F.lit(7), F.lit(2))) == 3
    assert one(spark, T.idiv(F.lit(-7), F.lit(2))) == -3
    assert one(spark, T.idiv(F.lit(7), F.lit(0))) is None
    assert one(spark, T.safe_idiv(F.lit(7), F.lit(0))) == 0


def test_truncation_before_sum(spark):
    df = spark.createDataFrame([(100,), (100,)], "size long")
    per_row = df.agg(F.sum(T.pages_to_mb_trunc("size"))).collect()[0][0]
    assert per_row == 0  # 100*8/1024 = 0 per row; the sum of sizes would give 1


def test_datediff_counts_boundaries(spark):
    a = F.lit(dt.datetime(2024, 1, 1, 0, 0, 59)).cast("timestamp_ntz")
    b = F.lit(dt.datetime(2024, 1, 1, 0, 1, 0)).cast("timestamp_ntz")
    assert one(spark, T.datediff_boundaries("minute", a, b)) == 1
    assert one(spark, T.datediff_boundaries("second", a, b)) == 1
    c = F.lit(dt.datetime(2024, 1, 1, 23, 59, 0)).cast("timestamp_ntz")
    d = F.lit(dt.datetime(2024, 1, 2, 0, 1, 0)).cast("timestamp_ntz")
    assert one(spark, T.datediff_boundaries("day", c, d)) == 1


def test_substring_start_zero_shortens(spark):
    assert one(spark, T.tsql_substring(F.lit("abcdef"), F.lit(0), F.lit(3))) == "ab"
    assert one(spark, T.tsql_substring(F.lit("abcdef"), F.lit(2), F.lit(3))) == "bcd"
    assert one(spark, T.tsql_substring(F.lit("abc"), F.lit(-5), F.lit(3))) == ""


def test_len_ignores_trailing_blanks(spark):
    assert one(spark, T.tsql_len(F.lit("ab  "))) == 2


def test_parsename_and_version(spark):
    assert one(spark, T.parsename(F.lit("13.0.5026.0"), 2)) == "5026"
    assert one(spark, T.parsename(F.lit("13.0.5026.0"), 4)) == "13"
    assert one(spark, T.version_name(F.lit("10.50.6000.34"))) == "2008 R2"
    assert one(spark, T.version_name(F.lit("16.0.1000.6"))) is None


def test_quotename_and_str(spark):
    assert one(spark, T.quotename(F.lit("a]b"))) == "[a]]b]"
    assert one(spark, T.str10(F.lit(5))) == "         5"


def test_money_rounds_half_up_to_cents(spark):
    assert one(spark, T.money(F.lit(1234567.125))) == "1,234,567.13"
    assert one(spark, T.money(F.lit(0.0))) == "0.00"


def test_scaled_is_exact(spark):
    assert str(one(spark, T.scaled(F.lit(19615), 3, "decimal(18,2)"))) == "19.62"
    assert str(one(spark, T.scaled(F.lit(1234500), 6, "decimal(10,3)"))) == "1.235"


def test_like_any_case_insensitive(spark):
    assert one(spark, T.ci_like_any(F.lit("Nightly BACKUP"), ["%backup%", "%dba%"])) is True
