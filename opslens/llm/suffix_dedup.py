"""Operator 5: byte-level removal of repeated substrings by sampled, induced
suffix sorting.

External induced sorting orders a sample of suffixes (local minima) by name,
recursively, and induces all others from them, with priority queues on disk
that carry suffix tuples. Here the sample are the anchors of ``repeats``:
local minima among the names (hashes) of ``seed``-byte strings, at least one
in every ``window`` bytes. Spark's external shuffle sort takes the place of
the priority queues: it carries tuples (name, span, document, place) and
spills to disk, so a shard may be far larger than memory. The windows next
to an anchor are induced from it: neighbouring suffixes with a common prefix
over their whole span first (one comparison for up to ``window`` suffixes),
then one by one where spans below one name differ. The README says why the
full suffix array is not written out.

``suffix_dedup`` removes every byte covered by a ``window``-byte string that
also starts earlier (smaller id, or same document and smaller offset).

Edge cases: null text counts as empty; texts shorter than a window are kept
whole; rows without an id are kept whole and are nobody's source; rows that
share an id are one document whose windows are ordered by offset; an empty
table gives no rows. Other input columns are ignored, whatever their names.
Cuts fall on bytes, so the kept part is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import repeated_starts, with_repeats
from .substring_dedup import inside_runs, runs_per_doc, span_lists
from .textarrays import Block

SEED = 20
SCHEMA = "doc long, n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ARROW = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", _SPANS),
                    ("kept", pa.large_binary())])


def byte_symbols(block: Block) -> tuple[np.ndarray, np.ndarray]:
    return block.data.astype(np.uint64) + np.uint64(1), block.offsets


def cut(window: int):
    def run(batches):
        for batch in batches:
            doc = batch.column("doc")
            for block, first, start, owner in repeated_starts(batch, byte_symbols):
                lo, hi, own = runs_per_doc(start, owner, first, window)
                n = len(first) - 1
                data, offsets = block.data, first
                if len(lo):
                    gone = inside_runs(lo, hi, own, first)
                    before = np.concatenate([[0], np.cumsum(~gone)])
                    data, offsets = data[~gone], before[first]
                removed = np.bincount(own, weights=hi - lo, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    doc[block.rows], pa.array(np.diff(first)), pa.array(removed), span_lists(lo, hi, own, n),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)),
                                                                            pa.py_buffer(np.ascontiguousarray(data))]),
                ], schema=_ARROW)

    return run


def suffix_dedup(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, removed (byte spans),
    kept (remaining bytes)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    marked = with_repeats(base, byte_symbols, window, min(SEED, window // 2), within=True, blocks_of=(10, 1))
    return marked.mapInArrow(cut(window), SCHEMA).withColumnRenamed("doc", id_col)
