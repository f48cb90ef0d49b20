"""Property tests: dialect helpers against plain-Python reference semantics,
many generated rows evaluated in one Spark job."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from opslens.functions import tsql as T


def py_substring(s, start, length):
    """Positions start .. start+length-1 (1-based) that fall on the string."""
    first, last = max(start, 1), start + length - 1
    return "" if last < first else s[first - 1:last]


def py_div(a, b):
    q = abs(a) // abs(b)
    return q if (a >= 0) == (b > 0) else -q


rows = st.lists(st.tuples(st.text(alphabet="abc d", max_size=8), st.integers(-5, 10), st.integers(0, 10),
                          st.integers(-10**6, 10**6), st.integers(-50, 50).filter(lambda x: x != 0)),
                min_size=1, max_size=60)


@settings(max_examples=5, deadline=None)
@given(rows)
def test_substring_and_division_match_reference(spark, data):
    df = spark.createDataFrame(data, "s string, st int, ln int, a long, b long")
    out = df.select(T.tsql_substring("s", "st", "ln").alias("sub"), T.idiv("a", "b").alias("q"),
                    T.tsql_len("s").alias("n")).collect()
    for (s, st_, ln, a, b), r in zip(data, out):
        assert r.sub == py_substring(s, st_, ln)
        assert r.q == py_div(a, b)
        assert r.n == len(s.rstrip(" "))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=40))
def test_money_text_is_half_up_cents(spark, ints):
    df = spark.createDataFrame([(i / 1000.0,) for i in ints], "x double")
    out = [r[0] for r in df.select(T.money("x")).collect()]
    for i, text in zip(ints, out):
        cents = int(__import__("math").floor(i / 1000.0 * 100 + 0.5))
        assert text == f"{cents // 100:,}.{cents % 100:02d}"


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**7), st.integers(0, 10**7)), min_size=1, max_size=40))
def test_datediff_counts_unit_boundaries(spark, pairs):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(seconds=a), base + dt.timedelta(seconds=b)) for a, b in pairs]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    out = df.select(*[T.datediff_boundaries(u, "a", "b").alias(u) for u in ("second", "minute", "hour", "day")]).collect()
    for (a, b), r in zip(pairs, out):
        for unit, size in (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86400)):
            assert r[unit] == b // size - a // size, (unit, a, b)
