"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, comp) after joining what ``links`` (a, b: ids) connect;
    a component is named by its smallest member's former name.

    Links are lifted to components and contracted: every component points to
    its smallest neighbour (or itself), pointers are followed once more, and
    links between the merged components are kept for the next round, until
    none is left. A round at least halves every chain of components."""
    of_a, of_b = labels.select(F.col("id").alias("a"), F.col("comp").alias("u")), labels.select(F.col("id").alias("b"), F.col("comp").alias("v"))
    links = stored(links.join(of_a, "a").join(of_b, "b").where("u != v").select("u", "v").distinct())
    while not links.isEmpty():
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to"))
        further = least.select(F.col("u").alias("to"), F.col("to").alias("then"))
        jump = stored(least.join(further, "to", "left").select("u", F.coalesce("then", "to").alias("to")))
        labels = labels.join(jump.withColumnRenamed("u", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        links = stored(links.join(jump.withColumnRenamed("to", "x"), "u")
                       .join(jump.select(F.col("u").alias("v"), F.col("to").alias("y")), "v")
                       .where("x != y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
    return stored(labels)
