"""The stateless event operators give the same rows on a stream as in batch."""

import os

from opslens.operators import ha as H, storage as C
from opslens.sources.bindings import relation
from opslens.streaming import events as S
from tools.oracle_check import rows_of

from .conftest import SF_SMALL


def _rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def test_autogrow_stream_matches_batch(spark, tmpdir_path):
    trace = relation(spark, SF_SMALL, "trace_log")
    dim = relation(spark, SF_SMALL, "trace_events")
    src = os.path.join(tmpdir_path, "trace")
    trace.repartition(3).write.parquet(src)
    out = os.path.join(tmpdir_path, "trace_out")
    q = S.stream_autogrow_events(spark, src, trace.schema, dim, sink_path=out,
                                 checkpoint_location=os.path.join(tmpdir_path, "ck1"))
    q.awaitTermination()
    assert _rows(spark.read.parquet(out)) == _rows(C.autogrow_events(trace, dim))


def test_ag_state_changes_stream_matches_batch(spark, tmpdir_path):
    xe = relation(spark, SF_SMALL, "xe_events")
    src = os.path.join(tmpdir_path, "xe")
    xe.repartition(2).write.parquet(src)
    out = os.path.join(tmpdir_path, "xe_out")
    q = S.stream_ag_state_changes(spark, src, xe.schema, sink_path=out, utc_offset_hours=-5,
                                  checkpoint_location=os.path.join(tmpdir_path, "ck2"))
    q.awaitTermination()
    assert _rows(spark.read.parquet(out)) == _rows(H.ag_state_changes(xe, utc_offset_hours=-5))


def test_stream_restart_processes_only_new_files(spark, tmpdir_path):
    """Exactly-once resume: a restarted query (same checkpoint) sees only the
    files that arrived since the last committed batch."""
    trace = relation(spark, SF_SMALL, "trace_log")
    dim = relation(spark, SF_SMALL, "trace_events")
    src, out, ck = (os.path.join(tmpdir_path, x) for x in ("in", "out", "ck"))
    first, second = trace.filter("duration_us % 2 = 0"), trace.filter("duration_us % 2 = 1")
    first.write.parquet(os.path.join(src, "part=1"))
    S.stream_autogrow_events(spark, src, trace.schema, dim, sink_path=out, checkpoint_location=ck).awaitTermination()
    n1 = spark.read.parquet(out).count()
    second.write.parquet(os.path.join(src, "part=2"))
    S.stream_autogrow_events(spark, src, trace.schema, dim, sink_path=out, checkpoint_location=ck).awaitTermination()
    assert n1 == C.autogrow_events(first, dim).count()
    assert _rows(spark.read.parquet(out)) == _rows(C.autogrow_events(trace, dim))
