"""Command output collected from every database.

A collector runs one command in each database and lands its rows as JSON
lines under ``server_name=/snapshot_id=/database_name=/``. All databases are
one read. A database whose output has drifted (columns added, renamed or
missing) is merged into the declared columns; a line that cannot be used goes
to quarantine with its reasons, and neither stops the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PLACE = ["server_name", "snapshot_id", "database_name"]
_LINES = "value string, server_name string, snapshot_id int, database_name string"


def read_output(spark: SparkSession, path: str, schema: str | StructType, *, required: Sequence[str] = (),
                renames: Mapping[str, str] | None = None) -> DataFrame:
    """One row per landed line: place, the declared columns (NULL if the line
    does not have them), ``unknown_columns``, and for quarantine ``line``,
    ``file`` and ``reasons`` (empty if the line is good).

    ``renames``: name in drifted output -> declared name. A line is bad if it
    is no JSON object, if a value cannot be cast to its declared type, or if
    a ``required`` column is missing or NULL."""
    fields = spark.createDataFrame([], schema).schema.fields
    renames = dict(renames or {})
    lines = spark.read.schema(_LINES).text(path).select("*", F.col("_metadata.file_path").alias("file"))
    names = [f.name for f in fields] + [n for n in renames if n not in {f.name for f in fields}]
    # All values are read as text first, so that a wrong one spoils its own line only.
    texts = F.from_json("value", ", ".join(f"`{n}` string" for n in names))
    rows = lines.withColumn("_keys", F.json_object_keys("value")).withColumn("_t", texts)
    is_object = F.col("_keys").isNotNull()

    def text(name: str) -> Column:
        return F.coalesce(F.col("_t")[name], *[F.col("_t")[old] for old, new in renames.items() if new == name])

    reasons = [F.when(~is_object, F.lit("not a JSON object"))]
    for f in fields:
        kind = f.dataType.simpleString()
        bad = is_object & text(f.name).isNotNull() & text(f.name).try_cast(f.dataType).isNull()
        reasons.append(F.when(bad, F.concat(F.lit(f"{f.name}: "), text(f.name), F.lit(f" is no {kind}"))))
        if f.name in required:
            reasons.append(F.when(is_object & text(f.name).isNull(), F.lit(f"{f.name} is missing")))
    unknown = F.array_except(F.col("_keys"), F.array(*[F.lit(n) for n in names]))
    return rows.select(*PLACE, *[text(f.name).try_cast(f.dataType).alias(f.name) for f in fields],
                       F.coalesce(unknown, F.array().cast("array<string>")).alias("unknown_columns"),
                       F.col("value").alias("line"), "file", F.array_compact(F.array(*reasons)).alias("reasons"))


def good_rows(output: DataFrame) -> DataFrame:
    return output.where(F.size("reasons") == 0).drop("unknown_columns", "line", "file", "reasons")


def quarantine(output: DataFrame) -> DataFrame:
    """(place, file, line, reasons) of the lines that could not be used."""
    return output.where(F.size("reasons") > 0).select(*PLACE, "file", "line", "reasons")


def drift(output: DataFrame) -> DataFrame:
    """Per database and column (declared ones, and others that occur):
    whether it is ``declared``, the good lines, and how many of them have it."""
    names = [c for c in output.columns if c not in (*PLACE, "unknown_columns", "line", "file", "reasons")]
    own = [F.struct(F.lit(c).alias("name"), F.lit(True).alias("declared"), F.col(c).isNotNull().cast("int").alias("n")) for c in names]
    others = F.transform("unknown_columns", lambda c: F.struct(c.alias("name"), F.lit(False).alias("declared"), F.lit(1).alias("n")))
    cells = output.where(F.size("reasons") == 0).select(*PLACE, F.explode(F.concat(F.array(*own), others)).alias("cell"))
    return cells.groupBy(*PLACE, F.col("cell.name").alias("column_name"), F.col("cell.declared").alias("declared")) \
        .agg(F.sum("cell.n").alias("n_lines"))
