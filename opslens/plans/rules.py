"""Checks as rules over few measures, merged into one aggregate per source.

A check says what it needs of each source, as named aggregates, and which
findings follow from them. ``run_checks`` merges the measures of all checks
that it is given into one aggregate per source, so every source is scanned
and shuffled once however many checks read it; lays the aggregates of a
server side by side (one more small shuffle); and unpivots the findings of
all checks in one pass.

Measures with the same name are the same measure. A measure is NULL where a
server has no row in the source.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shape import FINDING_COLS, kcols

Tables = Mapping[str, DataFrame]


class Source(NamedTuple):
    """The rows that measures aggregate; ``rows(tables, keys)`` prepares them
    from the landed tables."""

    name: str
    rows: Callable[[Tables, list[str]], DataFrame]


class Check(NamedTuple):
    """``measures(given)``: {source: {name: aggregate}}; ``items(given)``:
    (check_id, severity, observed, message, holds) over the measures, where
    ``holds`` says for which servers there is a finding. ``given`` holds what
    the caller passes on (as_of, limits ...)."""

    measures: Callable[[Mapping[str, Any]], dict[Source, dict[str, Column]]]
    items: Callable[[Mapping[str, Any]], list[tuple[str, Column, Column, Column, Column]]]


def landed(name: str) -> Source:
    return Source(name, lambda tables, keys, name=name: tables[name])


def facts(checks: list[Check], tables: Tables, keys=None, given: Mapping[str, Any] | None = None) -> DataFrame:
    """One row per server: keys and the measures of all ``checks``."""
    k, given = kcols(keys), given or {}
    merged: dict[str, tuple[Source, dict[str, Column]]] = {}
    for check in checks:
        for source, measures in check.measures(given).items():
            merged.setdefault(source.name, (source, {}))[1].update(measures)
    frames = [source.rows(tables, k).groupBy(*k).agg(*[c.alias(n) for n, c in measures.items()]) for source, measures in merged.values()]
    if len(frames) == 1:
        return frames[0]
    kinds = {f.name: f.dataType for frame in frames for f in frame.schema if f.name not in k}
    sides = [frame.select(*k, *[F.col(n) if n in frame.columns else F.lit(None).cast(kind).alias(n) for n, kind in kinds.items()]) for frame in frames]
    # Of every measure one row at most has a value.
    return reduce(DataFrame.union, sides).groupBy(*k).agg(*[F.first(n, ignorenulls=True).alias(n) for n in kinds])


def run_checks(checks: list[Check], tables: Tables, keys=None, **given) -> DataFrame:
    """The findings of all ``checks``."""
    k = kcols(keys)
    found = [F.struct(F.when(F.coalesce(holds, F.lit(False)), F.lit(check_id)).alias("check_id"), severity.alias("severity"),
                      observed.cast("string").alias("observed"), message.alias("message"))
             for check in checks for check_id, severity, observed, message, holds in check.items(given)]
    rows = facts(checks, tables, keys, given).select(*k, F.explode(F.array(*found)).alias("f"))
    return rows.select(*k, "f.*").where(F.col("check_id").isNotNull()).select(*k, *FINDING_COLS)


def counted(check_id: str, n: Column, bad: str, good: str, holds: Column) -> tuple[str, Column, Column, Column, Column]:
    """A finding that warns when ``n`` is above 0 (``bad`` may name it by %d)."""
    text = F.format_string(bad, n) if "%d" in bad else F.lit(bad)
    return check_id, F.when(n > 0, "warn").otherwise("ok"), n, F.when(n > 0, text).otherwise(F.lit(good)), holds
