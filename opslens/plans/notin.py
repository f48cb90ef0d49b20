"""NOT IN with NULLs (three-valued logic), per scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(rows: DataFrame, column: str, values: DataFrame, value: str, scope: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` is NOT IN the ``value``s of their ``scope`` (a
    server, a database ...), as SQL means it:

    * a scope without values keeps all its rows, NULLs too;
    * a scope whose values hold a NULL keeps none;
    * otherwise rows with a NULL go, and so do those with an equal value.

    Spark's own null-aware anti join takes one column and broadcasts the
    values; here they are joined by scope and value like any other key, and
    what NULLs decide is one small row per scope.
    """
    scope = list(scope)
    said = values.select(*scope, F.col(value).alias("__value"))
    facts = said.groupBy(*scope).agg(F.max(F.col("__value").isNull()).alias("__null_value"))
    equal = said.where(F.col("__value").isNotNull()).distinct().withColumnRenamed("__value", column)
    decided = rows.join(facts, scope, "left") \
        .where(F.col("__null_value").isNull() | (~F.col("__null_value") & F.col(column).isNotNull())).drop("__null_value")
    return decided.join(equal, [*scope, column], "left_anti").select(*rows.columns)
