"""Matching rows with a table of LIKE patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
# LIKE without an escape character, as a backslash is part of a path.
_NO_ESCAPE = "\x01"


def _grams(text: Column, size: Column | int) -> Column:
    """All substrings of ``size`` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.length(text) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, size))).otherwise(F.array().cast("array<string>"))


def match_patterns(rows: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Each row with each pattern that its ``column`` is LIKE (% and _, no
    escape, without case), and the pattern's other columns.

    A text that matches holds every literal part of the pattern, and so their
    grams of ``GRAM`` characters (shorter parts: their own length). Of each
    pattern the gram that the fewest texts hold is joined with the grams of
    the texts, by equality; only pairs that share it are compared with LIKE.
    Patterns with a gram that no text holds drop out before. A pattern of
    wildcards alone has the empty gram, which all texts hold.

    Texts are compared once each, however many rows have them; NULL matches
    nothing; equal patterns are one row each."""
    text, like = F.lower(F.col(column)), F.lower(F.col(pattern))
    texts = rows.select(text.alias("_text")).where("_text is not null").distinct()
    sizes = [_grams(F.col("_text"), n) for n in range(1, GRAM + 1)]
    held = texts.select("_text", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *sizes))).alias("_gram"))
    asked = patterns.select(like.alias("_like")).where("_like is not null").distinct()
    parts = F.filter(F.split("_like", "[%_]"), lambda p: p != "")
    own = F.flatten(F.transform(parts, lambda p: _grams(p, F.least(F.length(p), F.lit(GRAM)))))
    grams = asked.select("_like", F.explode(F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(own))).alias("_gram"))
    common = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_many"))
    keyed = grams.join(common, "_gram", "left").groupBy("_like") \
        .agg(F.min_by("_gram", F.struct(F.coalesce("_many", F.lit(0)), F.length("_gram"), "_gram")).alias("_gram"))
    pairs = held.join(keyed, "_gram").where(F.expr(f"_text like _like escape '{_NO_ESCAPE}'")).select("_text", "_like")
    return rows.withColumn("_text", text).join(pairs, "_text").join(patterns.withColumn("_like", like), "_like").drop("_text", "_like")


def like_any_of(rows: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Rows whose ``column`` is LIKE one of the patterns or more, once each."""
    texts = rows.select(F.lower(F.col(column)).alias("_t")).where("_t is not null").distinct()
    found = match_patterns(texts, "_t", patterns.select(pattern), pattern).select("_t").distinct()
    return rows.withColumn("_t", F.lower(F.col(column))).join(found, "_t", "left_semi").drop("_t")
