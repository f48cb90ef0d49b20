"""Sources and sinks.

Collectors land each catalog view / DMV / msdb table / event file as a table
of ``server_name, snapshot_id, snapshot_ts`` + the view's own columns. These
helpers read such landings with a declared schema (nothing inferred), add the
fleet key when a single-instance landing lacks it, and write results back
partitioned by snapshot date.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import SCHEMAS

FORMATS = ("parquet", "json", "csv", "orc")


def load_snapshot(spark: SparkSession, path: str, name: str | None = None, *,
                  schema: StructType | str | None = None, fmt: str = "parquet",
                  server_name: str | None = None, snapshot_id: int | None = None,
                  options: dict | None = None) -> DataFrame:
    """Read one landed view.

    ``path`` may be a directory or glob (R4/R5: all rollover files of a trace
    or event-file set are one read, so no path arithmetic is needed). Partition
    columns such as ``snapshot_date=`` are discovered, so filters on them prune.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt}")
    reader = spark.read.format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    target = f"{path}/{name}" if name else path
    df = reader.load(target)
    if "server_name" not in df.columns:
        df = df.withColumn("server_name", F.lit(server_name or "local"))
    if "snapshot_id" not in df.columns:
        df = df.withColumn("snapshot_id", F.lit(snapshot_id or 0).cast("long"))
    return df


def union_landed(frames: Iterable[DataFrame]) -> DataFrame:
    """Per-database outputs appended into one relation (``unionByName``)."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_result(df: DataFrame, path: str, *, date_col: str | None = "snapshot_ts",
                 mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Persist findings / listings / report lines.

    Partitioned by snapshot date and server, and only the partitions that
    ``df`` has rows for are replaced: a re-run of a day writes the same files
    again instead of doubling them, and other servers' results stay. The rows
    are rebalanced first, so adaptive execution splits a large server over
    several files and tasks and packs small ones together.
    """
    if not (date_col and date_col in df.columns):
        df.write.mode(mode).format(fmt).save(path)
        return
    parts = ["snapshot_date"] + (["server_name"] if "server_name" in df.columns else [])
    w = df.withColumn("snapshot_date", F.to_date(date_col)).hint("rebalance", *[F.col(p) for p in parts])
    w.write.mode(mode).option("partitionOverwriteMode", "dynamic").format(fmt).partitionBy(*parts).save(path)


def load_fleet(spark: SparkSession, root: str, names: Iterable[str], fmt: str = "parquet",
               schemas: dict | None = None) -> dict[str, DataFrame]:
    """Read a landing folder laid out as ``<root>/<view name>/`` (each a
    table, typically partitioned by snapshot date) into a name -> DataFrame
    map for the operators, with the declared schemas (``schemas.SCHEMAS``
    unless others are given), so types never come from the files. Reads are
    lazy; nothing is scanned here."""
    schemas = SCHEMAS if schemas is None else schemas
    return {n: load_snapshot(spark, f"{root}/{n}", schema=schemas.get(n), fmt=fmt) for n in names}


def load_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
              lower_bound: int | None = None, upper_bound: int | None = None, num_partitions: int = 64,
              fetch_size: int = 10_000, properties: dict | None = None,
              server_name: str | None = None, snapshot_id: int | None = None) -> DataFrame:
    """R1-R3 straight from a server's catalog over JDBC (no landing step).

    With ``partition_column`` and bounds the read is split into
    ``num_partitions`` parallel range queries (one task each) instead of a
    single connection; ``fetch_size`` batches rows per round trip. Filters
    and column selections are pushed into the generated SQL by Spark.
    Not exercised by the tests here: that needs a live database server.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size)
    if partition_column is not None:
        if lower_bound is None or upper_bound is None:
            raise ValueError("partitioned JDBC reads need lower_bound and upper_bound")
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
             .option("upperBound", upper_bound).option("numPartitions", num_partitions))
    df = r.options(**(properties or {})).load()
    if "server_name" not in df.columns:
        df = df.withColumn("server_name", F.lit(server_name or "local"))
    if "snapshot_id" not in df.columns:
        df = df.withColumn("snapshot_id", F.lit(snapshot_id or 0).cast("long"))
    return df


def land_bucketed(df: DataFrame, table: str, buckets: int, keys: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Land a view as a table bucketed (and sorted) by the fleet key.

    Views that are joined on the fleet key again and again (databases,
    files, I/O counters, backup history) then read co-partitioned: two
    tables bucketed the same way join and aggregate by the key without a
    shuffle. Use the same bucket count for tables that meet in joins.
    """
    keys = list(keys or ["server_name", "snapshot_id"])
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
