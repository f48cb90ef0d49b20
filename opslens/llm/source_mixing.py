"""Operator 9: mixing sources to target weights by Pareto order sampling
(DataFrame functions only).

Every source gets a target number of words: its weight's share of the total,
at most ``max_repeat`` times its own size; what a full source cannot take is
shared out again by weight. A document is expected target / size-of-source
times. The whole part of that is certain: that many whole copies. For the
rest, documents are ranked by Pareto's variable, their random odds divided
by their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken from the
smallest on until the source's remaining words are filled, so the sample has
a fixed size. The document at the boundary is taken in part (its first
words), which makes every source meet its target to the word.

``u`` is derived from the id by a hash, so reruns agree. Running totals over
a source are taken in two steps, over ``buckets`` ranges of the ranking
variable and inside one range, so no task sorts a whole source.

The per-source table (one row a source) is ranked in one task: its size is
the number of sources, not of documents.

Edge cases: null or empty text has size 0 and is never taken; a null source
is a source of its own, after all others; rows without an id draw from their
text; tied rows are ranked by id, then size; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """(source, source_size) -> the same with ``target``. Sources by code
    point, null last, weigh ``weights``, repeating. Water filling in closed
    form: sources in order of cap / weight are full as long as their cap is
    at most the level that the others would then stand at."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                      (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))) \
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / \
            (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = ranked.withColumn("level", level).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    # The level of the first source that is not full holds for all that are not.
    share = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return filled.select("source", "source_size",
                         F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * share["level"]).alias("target"))


def _uniform(id_col: Column, text: Column, seed: int) -> Column:
    """52 hash bits as a number strictly between 0 and 1."""
    key = F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, seed: int = 0,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                buckets: int = 1 << 14) -> DataFrame:
    """One row per input row: id, source, size (words), source_size, target,
    taken (words the mix takes, repeats counted)."""
    text = F.col(text_col)
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                              F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                              _uniform(F.col(id_col), text, seed).alias("u")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("copies", copies) \
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("copies")).otherwise(F.lit(0.0))) \
        .withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("copies") * F.col("source_size")))
    odds = F.col("u") / (1 - F.col("u"))
    rank = F.when(F.col("p") > 0, odds / (F.col("p") / (1 - F.col("p")))).otherwise(F.col("u"))
    ranked = rows.alias("r").join(plan.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source")) \
        .withColumn("rank", rank).withColumn("bucket", F.floor(F.lit(buckets) * F.col("u")))  # inside a source the rank grows with u, which is evenly spread
    per_bucket = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    placed = ranked.alias("r").join(before.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source"))
                                    & (F.col("r.bucket") == F.col("b.bucket"))).drop(F.col("b.source")).drop(F.col("b.bucket"))
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                         (F.col("copies") * F.col("size") + extra).alias("taken"))
