"""Plan building blocks shared by the operators.

* ``SNAP`` — the fleet key every operator groups/partitions by.
* ``top_n`` / ``rank_in`` / ``with_total`` — per-key top lists, ranks and
  totals, windows partitioned by the fleet key over aggregated rows.
* ``kjoin`` — join per-server relations on the fleet key (or, with
  ``keys=[]``, one instance's one-row aggregates).
* ``finding`` — the common output shape of every *check* operator.
* ``dim`` — literal dimension tables (bounded by construction, so they are
  safe to broadcast).
* ``lookup_join`` — many-to-one join whose rows without a key are spread
  over many tasks (hot keys are split by adaptive execution).
* ``spread`` — even parallelism for CPU-heavy per-row work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAP = ["server_name", "snapshot_id"]
FINDING_COLS = ["check_id", "severity", "observed", "message"]

# A literal dimension is broadcast only if it has at most this many rows.
MAX_DIM_ROWS = 10_000
# Partitions that rows without a key are spread over in ``lookup_join``.
NULL_SALTS = 1024


def kcols(keys: Sequence[str] | None) -> list[str]:
    return list(SNAP if keys is None else keys)


def _const_key(df: DataFrame, name: str = "_all") -> DataFrame:
    return df.withColumn(name, F.lit(0))


def top_n(df: DataFrame, keys, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per ``keys`` by ``order`` (give a unique tie-break).

    Per key this plans as a ``WindowGroupLimit`` + window; for ``keys=[]``
    as ``TakeOrderedAndProject`` — never a window over one partition.
    """
    keys = kcols(keys)
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def rank_in(df: DataFrame, keys, order: list[Column], name: str = "rn") -> DataFrame:
    """``row_number`` per keys. Callers aggregate first, so partitions hold
    one server's databases / wait types, never raw fact rows. With
    ``keys=[]`` the input is one instance's aggregate (e.g. at most 52 wait
    types), so the single window partition is bounded."""
    keys = kcols(keys)
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def with_total(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Add ``out`` = sum(value) over ``keys``.

    With keys the window is partitioned by the fleet key; for ``keys=[]`` the
    total is a one-row aggregate joined back on a constant key (broadcast).
    """
    keys = kcols(keys)
    if keys:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys)))
    tot = df.agg(F.sum(value).alias(out))
    return _const_key(df).join(F.broadcast(_const_key(tot)), "_all").drop("_all")


def finding(df: DataFrame, keys, check_id: str, severity: Column | str,
            observed: Column, message: Column | str) -> DataFrame:
    """Shape rows as findings: keys, check_id, severity, observed, message."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    msg = F.lit(message) if isinstance(message, str) else message
    return df.select(*kcols(keys), F.lit(check_id).alias("check_id"), sev.alias("severity"),
                     observed.cast("string").alias("observed"), msg.alias("message"))


def dim(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal dimension table, broadcast-marked (its size is fixed)."""
    if len(rows) > MAX_DIM_ROWS:
        raise ValueError(f"literal dim of {len(rows)} rows exceeds {MAX_DIM_ROWS}")
    return F.broadcast(spark.createDataFrame(rows, schema))


def lookup_join(fact: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a large ``fact`` to a ``dimension`` with one row per key.

    A plain shuffled equi-join: both sides grow with the data (statement
    text, backup sets), so nothing is broadcast by hint, sort-merge spills,
    and a hot key's fact rows are split by adaptive execution at run time.
    That cannot help rows whose key is NULL: they match nothing, but would
    all hash to one partition. In a left join they get a salt (a hash of the
    row), so they spread over ``NULL_SALTS`` partitions; in an inner join
    Spark filters them before the shuffle."""
    if how not in ("inner", "left"):
        raise ValueError("lookup_join supports inner and left")
    if how == "inner":
        return fact.join(dimension, on, how)
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(c).isNull()
    hashable = [F.col(c) for c, t in fact.dtypes if not t.startswith("map")]
    salted = fact.withColumn("_salt", F.when(missing, F.pmod(F.xxhash64(*hashable), F.lit(NULL_SALTS)) + 1).otherwise(F.lit(0)).cast("int"))
    # Always 0, but not a literal: the optimizer would take a literal out of the join keys again.
    zero = F.pmod(F.hash(*on), F.lit(1))
    return salted.join(dimension.withColumn("_salt", zero), on + ["_salt"], how).drop("_salt")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Deal rows out evenly before CPU-heavy per-row work (XML parsing): the
    rows' cost depends on their content, not on the size of an input split."""
    return df.repartition(min_partitions) if min_partitions else df.hint("rebalance")


def kjoin(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join two per-server relations on the fleet key. With ``keys=[]``
    (single-instance mode) the right side is the one row of the one instance:
    an equi-join on a constant, which Spark broadcasts as long as the right
    side's size allows."""
    if keys:
        return left.join(right, keys, how)
    # Always 0, but not a literal: the optimizer would make a nested loop of it.
    zero = lambda df: F.pmod(F.hash(df.columns[0]), F.lit(1))
    return left.withColumn("_one", zero(left)).join(right.withColumn("_one", zero(right)), "_one", how).drop("_one")
