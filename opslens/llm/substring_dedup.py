"""Operator 1: substring deduplication on words, by level-wise doubling.

Windows that repeat at one length alone are extended to about twice that
length, until no candidate survives:

* level ``window // 2 + 1`` words: anchors (see ``repeats``). A seed found
  in one place only is dropped.
* level ``window`` .. : windows below repeated seeds, twice the seed's
  length, first as whole spans of neighbouring windows, then, where spans
  below one seed differ, window by window.
* ``longest_repeats`` goes on from there: 2, 4, 8 ... times ``window``,
  from survivors alone, until none is left.

``substring_dedup`` removes every word that lies in a window of ``window``
words which also starts in a document with a smaller id.

Edge cases: null text counts as empty; texts shorter than a window are kept
whole; rows without an id are kept whole and are nobody's source; rows that
share an id are one document, so they never remove words from each other,
and identical rows get identical results; an empty table gives no rows.
Input columns other than id and text are ignored, whatever their names.
Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; kept words are joined by one
space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import repeated_starts, with_repeats
from .stored import stored
from .textarrays import Block, SpanHasher, blocks, covered_runs, owners, window_starts, words

SCHEMA = "doc long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ARROW = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", _SPANS),
                    ("kept_text", pa.large_string())])


def word_symbols(block: Block) -> tuple[np.ndarray, np.ndarray]:
    w = words(block)
    return SpanHasher(block.data)(w.start, w.end), w.first


def runs_per_doc(start: np.ndarray, owner: np.ndarray, first: np.ndarray, window: int):
    """Maximal covered runs of sorted (owner, start) windows: run start, run
    end (both within the document) and owner."""
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z
    shift = np.arange(len(first) - 1) * window + first[:-1]  # a gap of a window between documents
    lo, hi = covered_runs(start + shift[owner], window)
    own = np.searchsorted(shift, lo, "right") - 1
    return lo - shift[own], hi - shift[own], own


def span_lists(lo: np.ndarray, hi: np.ndarray, own: np.ndarray, n_docs: int) -> pa.Array:
    offsets = np.searchsorted(own, np.arange(n_docs + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), values).cast(_SPANS)


def inside_runs(lo: np.ndarray, hi: np.ndarray, own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mask over all symbols of a block: covered by a run."""
    change = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(change, lo + first[own], 1)
    np.add.at(change, hi + first[own], -1)
    return np.cumsum(change[:-1]) > 0


def _join_kept(block: Block, w, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of every document joined by one space: (offsets, bytes)."""
    start, end = w.start[keep], w.end[keep]
    per_doc = np.bincount(owners(w.first)[keep], minlength=len(w.first) - 1)
    length = end - start + 1  # the word and a space
    out_end = np.cumsum(length)
    total = int(out_end[-1]) if len(out_end) else 0
    take = np.repeat(start - (out_end - length), length) + np.arange(total)
    out = np.append(block.data, np.uint8(32))[take] if total else np.zeros(0, np.uint8)
    drop = np.ones(total, bool)
    if total:
        out[out_end - 1] = 32
        last = np.cumsum(per_doc)[per_doc > 0] - 1  # the last kept word of a document has no space
        drop[out_end[last] - 1] = False
    sizes = np.bincount(np.repeat(owners(w.first)[keep], length)[drop], minlength=len(per_doc)) if total else np.zeros(len(per_doc), np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), out[drop]


def cut(window: int):
    def run(batches):
        for batch in batches:
            doc = batch.column("doc")
            for block, first, start, owner in repeated_starts(batch, word_symbols):
                w = words(block)
                lo, hi, own = runs_per_doc(start, owner, first, window)
                gone = inside_runs(lo, hi, own, first)
                offsets, data = _join_kept(block, w, ~gone)
                n = len(first) - 1
                removed = np.bincount(own, weights=hi - lo, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    doc[block.rows], pa.array(np.diff(first)), pa.array(removed), span_lists(lo, hi, own, n),
                    pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)),
                ], schema=_ARROW)

    return run


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, removed (word spans),
    kept_text."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    marked = with_repeats(base, word_symbols, window, window // 2 + 1, within=False)
    return marked.mapInArrow(cut(window), SCHEMA).withColumnRenamed("doc", id_col)


def _level_rows(length: int, of_length: int | None):
    """mapInArrow function: one row per window of ``length`` words; with
    ``of_length``, only where both halves (of that length) are among the
    document's survivors."""

    def run(batches):
        for batch in batches:
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            alive = batch.column("alive") if of_length else None
            for block in blocks(batch.column("text")):
                symbol, first = word_symbols(block)
                h, h2 = SpanHasher(symbol), SpanHasher(symbol, 1)
                start, own = window_starts(first, length)
                if of_length:
                    ok = np.zeros(len(start), bool)
                    for i in np.unique(own):
                        here = np.flatnonzero(own == i)
                        known = alive[block.rows.start + i].values.to_numpy()
                        s = start[here]
                        ok[here] = (np.isin(h(s, s + of_length).view(np.int64), known)
                                    & np.isin(h(s + length - of_length, s + length).view(np.int64), known))
                    start, own = start[ok], own[ok]
                yield pa.RecordBatch.from_arrays([pa.array(h(start, start + length).view(np.int64)),
                                                  pa.array(h2(start, start + length).view(np.int64)),
                                                  pa.array(doc[block.rows][own].astype(np.int64))], ["key", "second", "doc"])

    return run


def longest_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that shares a window of ``window`` words with another:
    ``longest``, the largest of window, 2 window, 4 window ... at which it
    still shares one. Each level reads only documents with survivors and
    extends only windows whose two halves both survived; survivors are
    checkpointed per level, and the loop ends when there are none."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")) \
        .where("doc is not null and text is not null")
    out, alive, length, half = None, None, window, None
    while True:
        source = base if alive is None else base.join(alive, "doc")
        rows = source.mapInArrow(_level_rows(length, half), "key long, second long, doc long").distinct()
        shared = rows.groupBy("key", "second").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
        alive = stored(rows.join(shared, ["key", "second"], "left_semi").groupBy("doc")
                       .agg(F.collect_list("key").alias("alive")))
        if alive.isEmpty():
            break
        here = alive.select(F.col("doc").alias(id_col), F.lit(length).alias("longest"))
        out = here if out is None else out.unionByName(here)
        length, half = 2 * length, length
    empty = base.select(F.col("doc").alias(id_col), F.lit(0).alias("longest")).limit(0)
    return (out if out is not None else empty).groupBy(id_col).agg(F.max("longest").alias("longest"))
