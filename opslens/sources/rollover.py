"""Rollover sets of event files.

A server writes its trace or event session to a set of files, ``log_12.trc``,
``log_13.trc`` ... or ``AlwaysOn_health_0_1330.xel``. Every snapshot lands
the files that exist at that time, so most events land several times.

``read_rollover`` reads all landed files of all sets at once and tells from
each row's path which set and file it came from. ``events_once`` keeps each
event as often as its file holds it, however many snapshots landed the file;
``take_new`` does the same across loads, with a ledger of what earlier loads
have taken, and ``stream_once`` for a stream of landed files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.stored import stored

# <set>_<numbers>.trc or .xel as a component of the path, a file or a folder.
FILE = r"([^/=]+?)((?:_[0-9]+)*)\.(?:trc|xel)(?=[./]|$)"
SCOPE = ["server_name", "file_set", "file_no"]


def file_set(path: Column) -> Column:
    """The set's base name: the file's name without rollover numbers."""
    return F.nullif(F.regexp_extract(path, FILE, 1), F.lit(""))


def file_number(path: Column) -> Column:
    """The last rollover number; 0 for a file without one."""
    numbers = F.regexp_extract(path, FILE, 2)
    return F.when(file_set(path).isNotNull(), F.coalesce(F.element_at(F.split(numbers, "_"), -1).try_cast("long"), F.lit(0)))


def read_rollover(spark: SparkSession, path: str, schema: str, *, fmt: str = "parquet", stream: bool = False,
                  options: dict | None = None) -> DataFrame:
    """All landed event files under ``path``, with ``file_set`` and
    ``file_no``. ``schema`` declares the event columns and the partition
    columns of the landing (server_name, snapshot_id)."""
    reader = (spark.readStream if stream else spark.read).schema(schema).format(fmt).options(**(options or {}))
    rows = reader.load(path)
    place = F.col("_metadata.file_path")
    declared = spark.createDataFrame([], schema).columns
    return rows.select(*declared, file_set(place).alias("file_set"), file_number(place).alias("file_no"))


def _identity(events: DataFrame) -> list[str]:
    return [c for c in events.columns if c not in (*SCOPE, "snapshot_id")]


def _per_landing(events: DataFrame) -> DataFrame:
    """How often each landing of a file holds each event."""
    return events.groupBy(*SCOPE, "snapshot_id", *_identity(events)).agg(F.count(F.lit(1)).alias("_n"))


def _times(rows: DataFrame, times: str) -> DataFrame:
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop("_k", times)


def events_once(events: DataFrame) -> DataFrame:
    """``events`` of any number of snapshots without repeats between them.
    Events that are equal inside one file are different events, so each stays
    as often as the landing that holds most of it. ``snapshot_id`` becomes the
    first that had the event."""
    counted = _per_landing(events).groupBy(*SCOPE, *_identity(events)) \
        .agg(F.max("_n").alias("_n"), F.min("snapshot_id").alias("snapshot_id"))
    return _times(counted, "_n").select(*events.columns)


_LEDGER = "server_name string, file_set string, file_no long, event string, snapshot_id long, n long, batch long"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException:  # nothing taken yet
        return spark.createDataFrame([], _LEDGER)


def take_new(events: DataFrame, ledger: str, batch: int, sink: Callable[[DataFrame], None]) -> None:
    """Give ``sink`` the events that no earlier batch has given, and then
    enter the batch into the ledger (a folder).

    The ledger counts each event per landing, so a landing may come in pieces.
    A batch that is run again ignores its own entries: if the job died, the
    sink gets the same events once more and has to replace those of the batch.
    An event is known by SHA-256 of its columns."""
    spark = events.sparkSession
    columns = _identity(events)
    event = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    landed = stored(_per_landing(events).withColumn("_event", event))
    ident = [*SCOPE, "_event"]
    earlier = _ledger(spark, ledger).where(F.col("batch") != batch).withColumnRenamed("event", "_event") \
        .groupBy(*ident, "snapshot_id").agg(F.sum("n").alias("_before"))
    # Only what this batch holds, too, is looked up.
    earlier = earlier.join(landed.select(*ident).distinct(), ident, "left_semi")
    both = landed.select(*ident, "snapshot_id", F.col("_n").alias("_now"), F.lit(0).cast("long").alias("_before")) \
        .unionByName(earlier.select(*ident, "snapshot_id", F.lit(0).cast("long").alias("_now"), "_before"))
    each = both.groupBy(*ident, "snapshot_id").agg(F.sum("_now").alias("_now"), F.sum("_before").alias("_before"))
    new = each.groupBy(*ident).agg((F.max(F.col("_now") + F.col("_before")) - F.max("_before")).alias("_new")).where("_new > 0")
    values = landed.groupBy(*SCOPE, "_event", *columns).agg(F.min("snapshot_id").alias("snapshot_id"))
    sink(_times(values.join(new, ident), "_new").select(*events.columns))
    landed.select(*SCOPE, F.col("_event").alias("event"), F.col("snapshot_id").cast("long").alias("snapshot_id"), F.col("_n").alias("n")) \
        .write.mode("overwrite").parquet(f"{ledger}/batch={batch}")


def stream_once(events: DataFrame, ledger: str, checkpoint: str, sink: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """Each event of the stream once, whatever snapshots land it: ``sink``
    (rows, batch) has to replace what it holds of the batch, if any."""
    def run(rows: DataFrame, batch: int) -> None:
        take_new(rows, ledger, batch, lambda new: sink(new, batch))

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


