"""Registered operators for the driver contract.

``CASES[name] = (spark_fn, oracle)`` where ``spark_fn(spark, sf_dir)`` runs the
operator over telemetry relations bound to the driver's tables, and
``oracle`` is independent DuckDB SQL over the same bindings (or ``None`` when
the operator is not SQL-expressible). Column names are identical on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.bindings import relation, with_clause

CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def case(name: str, oracle_rels: list[str] | None = None, oracle_body: str | None = None):
    """Register ``fn`` under ``name`` with its DuckDB oracle."""
    def deco(fn):
        sql = None
        if oracle_body is not None:
            body = oracle_body.strip()
            if not oracle_rels:
                sql = body
            else:
                prefix = with_clause(oracle_rels)
                sql = prefix + ("" if body.lower().startswith("select") else ", ") + body
        CASES[name] = (fn, sql)
        return fn
    return deco


def rel(spark, sf_dir, *names):
    out = [relation(spark, sf_dir, n) for n in names]
    return out[0] if len(out) == 1 else out


# Modules below register their cases on import.
from . import suite_cases  # noqa: E402,F401
