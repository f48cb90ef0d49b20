"""Consecutive numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

# monotonically_increasing_id holds the partition above these bits, the row's place in it below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], seq: str = "seq",
             total: str | None = None) -> DataFrame:
    """``rows`` with ``seq``, 1 .. n in ``order`` inside each group of
    ``keys`` (null is a key like any other), and the group's n as ``total``
    if asked for.

    Rows are dealt into sorted ranges of (keys, order), however large a group
    is; a range numbers its own rows, and a group's ranges add the rows of
    those before them. No task holds a group, only the counts per range meet:
    at most one row for each range and group in it. Rows that agree in keys
    and order stay in one range, so many of them need a tie-break in
    ``order``. The ranges are checkpointed, since their bounds come from a
    sample that another run would draw anew.
    """
    placed = stored(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                    .withColumn("__at", F.monotonically_increasing_id())
                    .withColumn("__range", F.shiftright("__at", _PLACE_BITS)))
    runs = placed.groupBy("__range", *keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                          (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift"),
                          F.sum("__n").over(group).alias("__total"))
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & placed[k].eqNullSafe(F.col(f"__k{i}"))
    out = placed.join(offsets, same).withColumn(seq, F.col("__at") + F.col("__shift"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.select(*rows.columns, seq, *([total] if total else []))
