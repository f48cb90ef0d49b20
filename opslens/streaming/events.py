"""Structured Streaming runners for the stateless event operators.

Trace events (C14) and availability-group events (H3) arrive as append-only
files. Both operators are stateless row filters/projections plus a join to a
small static dimension, so the batch code runs unchanged on ``readStream``;
no watermark or state store is needed. Checkpoints go under the shared
``spark.checkpoint.dir`` (read from the session) so a restarted driver or a
lost executor resumes exactly-once from the last committed batch.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.ha import ag_state_changes
from ..operators.storage import autogrow_events


def _checkpoint(spark: SparkSession, name: str, location: str | None) -> str:
    if location:
        return location
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir (a shared folder) or pass checkpoint_location")
    return posixpath.join(base, "opslens-streams", name)


def read_events(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of landed event files (schema declared, not inferred)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def _start(df: DataFrame, sink_path: str, query_name: str, checkpoint: str, available_now: bool,
           fmt: str) -> StreamingQuery:
    w = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.format(fmt).start(sink_path)


def stream_autogrow_events(spark: SparkSession, trace_path: str, trace_schema, trace_events: DataFrame,
                           sink_path: str, variant: str = "detail",
                           checkpoint_location: str | None = None, available_now: bool = True,
                           fmt: str = "parquet") -> StreamingQuery:
    """C14 on a stream of trace-event files."""
    out = autogrow_events(read_events(spark, trace_path, trace_schema), trace_events, variant=variant)
    return _start(out, sink_path, "autogrow_events", _checkpoint(spark, "autogrow_events", checkpoint_location),
                  available_now, fmt)


def stream_ag_state_changes(spark: SparkSession, xe_path: str, xe_schema, sink_path: str,
                            utc_offset_hours: int = 0, tz: str | None = None,
                            checkpoint_location: str | None = None, available_now: bool = True,
                            fmt: str = "parquet") -> StreamingQuery:
    """H3 on a stream of extended-event rows (object_name, event_data)."""
    src = read_events(spark, xe_path, xe_schema)
    # ``spread`` needs a static partition count; a stream is already split by file.
    out = ag_state_changes(src, utc_offset_hours=utc_offset_hours, tz=tz, streaming=True)
    return _start(out, sink_path, "ag_state_changes", _checkpoint(spark, "ag_state_changes", checkpoint_location),
                  available_now, fmt)
