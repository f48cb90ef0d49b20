"""Repeated windows across a corpus: which windows of ``window`` symbols have
an earlier occurrence. Shared by the word-level (substring_dedup) and the
byte-level (suffix_dedup) operators.

The work goes level by level, and only what repeats at one level is looked at
in the next:

1. *Anchors.* Every window is represented by its anchor, the smallest hash
   among its seeds of ``seed`` symbols. Equal windows have equal anchors at
   equal offsets, so comparing windows below one seed is enough. Consecutive
   windows with one anchor form a group; only one row per group is shuffled
   (a fraction 2 / (window - seed + 2) of all positions).
2. *Groups.* A group whose whole span occurred earlier is repeated as a
   whole. Of equal spans the earliest is their representative; where a seed
   has several different spans, the representatives stay open.
3. *Finer blocks.* Open groups are cut into blocks of windows by their offset
   from the anchor, ``blocks_of`` windows each, down to 1. A block is
   compared like a group, below the symbols that all its windows share.

A seed that occurs once ends there, and so does a span that has no rival.

Skew. Before each shuffle a task compares its own batch: of equal spans only
the earliest travels by its hash, later ones are already known to be repeats
and travel by document. Seeds that have several spans within one batch are
known to stay open; their spans travel by span, with one marker row per
batch for the seed. So no key receives more than about two rows per batch of
documents, however many copies a passage has. Nothing is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textarrays import SpanHasher, anchored, blocks, mix

_U = np.uint64
# The two lowest bits of ``key`` say what a row travels by.
BY_SEED, BY_SPAN, BY_DOC = 0, 1, 2
ROW_SCHEMA = "key long, content long, doc long, at long"
_ARROW = pa.schema([(c, pa.int64()) for c in ("key", "content", "doc", "at")])
# ``at`` packs a group: first start (28 bits), number of starts (8), anchor's
# distance from the first start (8), fingerprint of the document (19).
_LO, _N, _OFF = 35, 27, 19
_PRINT = (1 << _OFF) - 1


def _key(values: np.ndarray, by: int) -> np.ndarray:
    return (values & ~_U(3) | _U(by)).view(np.int64)


def fingerprints(h: SpanHasher, first: np.ndarray) -> np.ndarray:
    """Some bits of every document's hash: tells rows with one id but
    different texts apart when flags come back by id."""
    return (h(first[:-1], first[1:]) >> _U(64 - _OFF)).astype(np.int64)


def _compared(parts: list[tuple], within: bool) -> pa.RecordBatch:
    """Rows (seed, span, doc, at) of a batch, compared among themselves and
    given the key they travel by."""
    s, c, d, at = (np.concatenate([p[i] for p in parts]) for i in range(4))
    by = np.lexsort((at, d, c, s))
    s, c, d, at = s[by], c[by], d[by], at[by]
    new_seed, new = np.ones(len(s), bool), np.ones(len(s), bool)
    new_seed[1:] = s[1:] != s[:-1]
    new[1:] = new_seed[1:] | (c[1:] != c[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    later = d > d[first]
    if within:
        later |= (d == d[first]) & (at > at[first])
    several = np.bincount(np.cumsum(new_seed) - 1, weights=new)[np.cumsum(new_seed) - 1] > 1
    rival, alone, marker = ~later & several, ~later & ~several, new_seed & several
    none = np.full(int(marker.sum()), -1)
    columns = zip((_key(mix(d[later].view(_U)), BY_DOC), c[later].view(np.int64), d[later], at[later]),
                  (_key(mix(c[rival] ^ s[rival]), BY_SPAN), c[rival].view(np.int64), d[rival], at[rival]),
                  (_key(s[alone], BY_SEED), c[alone].view(np.int64), d[alone], at[alone]),
                  (_key(s[marker], BY_SEED), none, none, none))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], schema=_ARROW)


def group_rows(symbols, window: int, seed: int, within: bool):
    """mapInArrow function: (doc, text) -> one row per group of windows."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("doc").is_valid())
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            parts = []
            for block in blocks(batch.column("text")):
                symbol, first = symbols(block)
                n = int(first[-1])
                if n < window:
                    continue
                h = SpanHasher(symbol)
                p = np.arange(n - seed + 1)
                seeds = h(p, p + seed)
                g = anchored(first, seeds, window, seed)
                content = h(g.lo, g.hi + window) ^ mix((g.anchor - g.lo).astype(_U))
                at = (g.lo - first[g.doc]) << _LO | (g.hi - g.lo + 1) << _N | (g.anchor - g.lo) << _OFF | fingerprints(h, first)[g.doc]
                parts.append((seeds[g.anchor], content, doc[block.rows][g.doc], at))
            if parts:
                yield _compared(parts, within)

    return run


def block_rows(symbols, window: int, size: int, within: bool):
    """mapInArrow function: documents with open groups -> one row per block
    of ``size`` offsets of those groups."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("doc").is_valid())
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            groups = _Flags(batch.column("groups"))
            parts = []
            for block in blocks(batch.column("text")):
                at, is_open, owner = groups.of(block.rows)
                if not is_open.any():
                    continue
                symbol, first = symbols(block)
                h, h2 = SpanHasher(symbol), SpanHasher(symbol, 1)
                mark = fingerprints(h, first)
                keep = is_open & ((at & _PRINT) == mark[owner])
                at, owner = at[keep], owner[keep]
                far = at >> _OFF & 0xFF                       # offset of the first window from the anchor
                near = far - (at >> _N & 0xFF) + 1            # and of the last
                anchor = (at >> _LO) + far + first[owner]
                count = far // size - near // size + 1
                j = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - near // size, count)
                anchor, owner = np.repeat(anchor, count), np.repeat(owner, count)
                far = np.minimum(np.repeat(far, count), j * size + size - 1)
                near = np.maximum(np.repeat(near, count), j * size)
                core = anchor - j * size                      # the symbols that all windows of the block share
                seeds = h(core, core - size + 1 + window) ^ mix(j.astype(_U))
                content = h2(anchor - far, anchor - near + window) ^ mix(far.astype(_U))
                at = (anchor - far - first[owner]) << _LO | (far - near + 1) << _N | far << _OFF | mark[owner]
                parts.append((seeds, content, doc[block.rows][owner], at))
            if parts:
                yield _compared(parts, within)

    return run


class _Flags:
    """A list<struct<at, open>> column as flat arrays, with the row of every entry."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        count = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self._first = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        self._at = flat.field("at").to_numpy(zero_copy_only=False)
        self._open = flat.field("open").to_numpy(zero_copy_only=False).astype(bool)

    def of(self, rows: slice):
        a, b = self._first[rows.start], self._first[rows.stop]
        owner = np.repeat(np.arange(rows.stop - rows.start), np.diff(self._first[rows.start:rows.stop + 1]))
        return self._at[a:b], self._open[a:b], owner


def _judged(rows: DataFrame, within: bool) -> DataFrame:
    """Per document (``home``) the list of its groups that are repeated as a
    whole, or are still open."""
    place = F.struct("doc", "at") if within else F.col("doc")
    by = F.col("key").bitwiseAND(F.lit(3))
    at_key, at_span = Window.partitionBy("key"), Window.partitionBy("key", "content")
    found = (rows.repartition("key")
             .withColumn("first", F.min(place).over(at_span))
             .withColumn("rival", F.min("content").over(at_key) != F.max("content").over(at_key))
             .withColumn("whole", (by == BY_DOC) | (place > F.col("first")))
             .where((F.col("at") >= 0) & (F.col("whole") | (by == BY_SPAN) | F.col("rival"))))
    return found.groupBy(F.col("doc").alias("home")).agg(F.collect_list(F.struct("at", (~F.col("whole")).alias("open"))).alias("groups"))


def with_repeats(docs: DataFrame, symbols, window: int, seed: int, within: bool, blocks_of: Sequence[int] = (1,)) -> DataFrame:
    """``docs`` (doc long, text) with a column ``groups``: the groups of
    repeated windows of every document, to be read with ``repeated_starts``.
    ``within``: an earlier start in the same document counts as well."""
    if not 0 < seed < window <= seed + 254 or blocks_of[-1] != 1:
        raise ValueError("seed is shorter than window, by 254 symbols at most; the last blocks hold one window")
    # Rows without an id have nothing to look up: they are dealt out evenly, by a hash of their place in the input.
    text = docs.select("doc", "text", F.coalesce("doc", F.xxhash64(F.monotonically_increasing_id())).alias("home")).repartition("home")
    levels = [_judged(docs.select("doc", "text").mapInArrow(group_rows(symbols, window, seed, within), ROW_SCHEMA), within)]
    for size in blocks_of:
        still = text.join(levels[-1], "home").select("doc", "text", "groups")
        levels.append(_judged(still.mapInArrow(block_rows(symbols, window, size, within), ROW_SCHEMA), within))
    out = text
    for k, level in enumerate(levels):
        out = out.join(level.withColumnRenamed("groups", f"g{k}"), "home", "left")
    none = F.array().cast("array<struct<at:bigint,open:boolean>>")
    return out.select("doc", "text", F.concat(*[F.coalesce(f"g{k}", none) for k in range(len(levels))]).alias("groups"))


def repeated_starts(batch: pa.RecordBatch, symbols):
    """Iterate over blocks of a ``with_repeats`` batch: (block, first symbol
    of every document, start, owner); ``start`` are the sorted starts of
    repeated windows, counted within document ``owner``."""
    groups = _Flags(batch.column("groups"))
    known = batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
    for block in blocks(batch.column("text")):
        symbol, first = symbols(block)
        at, is_open, owner = groups.of(block.rows)
        if len(at):
            whole = ~is_open & ((at & _PRINT) == fingerprints(SpanHasher(symbol), first)[owner]) & known[block.rows][owner]
            at, owner = at[whole], owner[whole]
            n = at >> _N & 0xFF
            start = np.repeat((at >> _LO) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            owner = np.repeat(owner, n)
            by = np.lexsort((start, owner))
            start, owner = start[by], owner[by]
        else:
            start = at
        yield block, first, start, owner
