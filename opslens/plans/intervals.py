"""Interval joins by equal keys, for any number of intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points and interval ends are whole numbers from 0 to 2 ** LEVELS - 1.
LEVELS = 31


def interval_keys(lo: Column, hi: Column) -> Column:
    """The closed interval [lo, hi] as an array of disjoint blocks (level,
    block) that cover it exactly: block b of a level k holds the points b *
    2**k to (b + 1) * 2**k - 1. At most two blocks a level, whatever the
    interval's length; none if it is empty or an end is NULL."""
    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first, end = F.ceil(F.greatest(lo, F.lit(0)) / size), F.floor((F.least(hi, F.lit(2 ** LEVELS - 1)) + 1) / size)
        block = lambda b: F.struct(level.alias("level"), b.cast("long").alias("block"))
        return F.array_compact(F.array(F.when((first < end) & (first % 2 == 1), block(first)),
                                       F.when((first < end) & (end % 2 == 1), block(end - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def point_keys(point: Column) -> Column:
    """All blocks that hold the point. A point is in an interval if and only
    if they share a key, and then they share exactly one."""
    here = F.when((point >= 0) & (point < 2 ** LEVELS), point)
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)),
                       lambda level: F.struct(level.alias("level"), F.floor(here / F.call_function("shiftleft", F.lit(1).cast("long"), level)).alias("block")))
