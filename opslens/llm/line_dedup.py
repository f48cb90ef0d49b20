"""Operator 6: line deduplication within an edit distance, by a deletion
neighbourhood join.

Lines are compared as word sequences, and an edit inserts, removes or
replaces one word; the bound is one edit for lines of at least ``min_words``
words, shorter lines must be equal. All variants of a line within the bound
(itself, and itself without word i) are emitted as 128-bit keys. Lines that
agree in a variant are within one edit exactly if one of them is the variant,
or both lack the word at the same place; so the join is grouped by (variant,
place), where all members are mutual neighbours, and needs no pairs. The
partner that decides a line's fate is then compared with it word by word.

Only lines that can have a neighbour emit variants: of two lines within one
edit, the first or the last half is untouched, so a line whose halves occur
in no other line has none.

A line is removed if an equal line or a neighbour occurs earlier (smaller
id, or same document and earlier line); lines are judged on the input, not on
what is left.

Skew: equal lines and members of one (variant, place) are first compared
inside each task's batch; later ones are decided there and do not travel.

Edge cases: null text counts as empty; lines without words are never
removed; rows without an id are kept whole and are nobody's source; rows
that share an id are one document, in which equal line numbers tie and stay;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored
from .textarrays import Block, SpanHasher, blocks, mix, owners, words

_U = np.uint64
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
LINE_SCHEMA = "h1 long, h2 long, doc long, line long, later boolean, halves array<long>"
VARIANT_SCHEMA = "v1 long, v2 long, place int, h1 long, h2 long, doc long, line long, near_doc long, near_line long"
OUT_SCHEMA = "doc long, n_lines long, n_removed long, removed array<int>, kept_text string"


@dataclass
class Lines:
    """Lines with words of a block: words [lo, hi), document, line number."""

    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray
    number: np.ndarray


def lines_of(block: Block, w) -> Lines:
    own = owners(w.first)
    before = np.concatenate([[0], np.cumsum(block.data == 10)])
    number = before[w.start] - before[block.offsets[:-1]][own] if len(own) else own
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (number[1:] != number[:-1])
    lo = np.flatnonzero(new)
    return Lines(lo, np.append(lo[1:], len(own)), own[lo], number[lo])


def _half_keys(h: SpanHasher, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(lines x 4) hashes of the first and last halves. Two lines within one
    edit, the longer of M words, agree in floor(M / 2) words at one end; M is
    a line's own length or one more. (Of an even length the halves of both
    are the same: the third and fourth column repeat the first two.)"""
    m = hi - lo
    keys = []
    for half in (m // 2, (m + 1) // 2):
        keys += [mix(h(lo, lo + half) ^ _U(1)), mix(h(hi - half, hi) ^ _U(2))]
    return np.stack(keys, 1)


def _line_rows(min_words: int):
    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("doc").is_valid())
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            parts = []
            for block in blocks(batch.column("text")):
                w = words(block)
                symbol = SpanHasher(block.data)(w.start, w.end)
                h, h2, at = SpanHasher(symbol), SpanHasher(symbol, 1), lines_of(block, w)
                parts.append((h(at.lo, at.hi), h2(at.lo, at.hi), ids[block.rows][at.doc], at.number, at.hi - at.lo, _half_keys(h, at.lo, at.hi)))
            if not parts:
                continue
            a, b, doc, line, m, halves = (np.concatenate([p[i] for p in parts]) for i in range(6))
            by = np.lexsort((line, doc, b, a))
            a, b, doc, line, m, halves = a[by], b[by], doc[by], line[by], m[by], halves[by]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            later = (doc != doc[first]) | (line != line[first])
            fuzzy = ~later & (m >= min_words)
            wanted = fuzzy[:, None] & np.stack([np.ones(len(m), bool)] * 2 + [m % 2 == 1] * 2, 1)
            offsets = np.concatenate([[0], np.cumsum(wanted.sum(1))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(halves[wanted].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array(line), pa.array(later),
                 keys.cast(pa.list_(pa.int64()))], names=["h1", "h2", "doc", "line", "later", "halves"])

    return run


def _variant_rows(batches):
    """Documents with the numbers of their open lines -> one row per variant.
    ``near_doc``, ``near_line``: an earlier neighbour found in this batch."""
    for batch in batches:
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        asked = batch.column("asked")
        parts = []
        for block in blocks(batch.column("text")):
            w = words(block)
            symbol = SpanHasher(block.data)(w.start, w.end)
            at = lines_of(block, w)
            here = asked.slice(block.rows.start, block.rows.stop - block.rows.start)
            want = here.flatten()
            owner = np.repeat(np.arange(len(here)), here.value_lengths().to_numpy(zero_copy_only=False))
            h, h2 = SpanHasher(symbol), SpanHasher(symbol, 1)
            keep = np.isin(at.doc.astype(np.int64) << 32 | at.number, owner.astype(np.int64) << 32 | want.field("line").to_numpy(zero_copy_only=False))
            lo, hi, doc, number = at.lo[keep], at.hi[keep], at.doc[keep], at.number[keep]
            a, b = h(lo, hi), h2(lo, hi)
            own = np.isin(a.view(np.int64), want.field("h1").to_numpy(zero_copy_only=False))  # not a row with the same id and another text
            lo, hi, doc, number, a, b = (x[own] for x in (lo, hi, doc, number, a, b))
            m = hi - lo
            row = np.repeat(np.arange(len(lo)), m + 1)
            place = np.arange(int((m + 1).sum())) - np.repeat(np.cumsum(m + 1) - (m + 1), m + 1) - 1  # -1: nothing left out
            left = np.where(place < 0, lo[row], lo[row] + place)
            right = np.where(place < 0, lo[row], lo[row] + place + 1)
            v = [x.joined(lo[row], left, right, hi[row]) for x in (h, h2)]
            parts.append((v[0], v[1], place, a[row], b[row], ids[block.rows][doc][row], number[row]))
        if not parts:
            continue
        v1, v2, place, a, b, doc, line = (np.concatenate([p[i] for p in parts]) for i in range(7))
        by = np.lexsort((line, doc, place, v2, v1))
        v1, v2, place, a, b, doc, line = (x[by] for x in (v1, v2, place, a, b, doc, line))
        new = np.ones(len(v1), bool)
        new[1:] = (v1[1:] != v1[:-1]) | (v2[1:] != v2[:-1]) | (place[1:] != place[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(v1)), 0))
        decided = ((doc != doc[first]) | (line != line[first])) & ((a != a[first]) | (b != b[first]))
        key = np.where(decided, mix(a ^ doc.view(_U)), v1)  # decided rows are dealt out by line
        near = [pa.array(x[first], mask=~decided) for x in (doc, line)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(v2.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(a.view(np.int64)),
             pa.array(b.view(np.int64)), pa.array(doc), pa.array(line), *near],
            names=["v1", "v2", "place", "h1", "h2", "doc", "line", "near_doc", "near_line"])


def _cut(batches):
    for batch in batches:
        drop = batch.column("drop")
        for block in blocks(batch.column("text")):
            here = drop.slice(block.rows.start, block.rows.stop - block.rows.start)
            n = len(here)
            size = here.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            want = here.flatten()
            owner, number = np.repeat(np.arange(n), size), want.field("line").to_numpy(zero_copy_only=False)
            w = words(block)
            symbol = SpanHasher(block.data)(w.start, w.end)
            at = lines_of(block, w)
            # A flag names line and hash, so that a row with the same id and another text is not cut by it.
            flags = mix(want.field("h1").to_numpy(zero_copy_only=False).astype(np.int64).view(_U) ^ (owner.astype(np.int64) << 32 | number).view(_U))
            mine = mix(SpanHasher(symbol)(at.lo, at.hi) ^ (at.doc.astype(np.int64) << 32 | at.number).view(_U))
            gone = np.isin(mine, flags)
            lines_before = np.concatenate([[0], np.cumsum(block.data == 10)])
            total = lines_before[block.offsets[1:]] - lines_before[block.offsets[:-1]] + (np.diff(block.offsets) > 0)
            change = np.zeros(len(block.data) + 1, np.int32)
            ends = np.append(np.flatnonzero(block.data == 10), len(block.data))
            starts = w.start[at.lo[gone]] if gone.any() else np.zeros(0, np.int64)
            k = np.searchsorted(ends, starts)
            line_start = np.maximum(np.where(k > 0, ends[k - 1] + 1, 0), block.offsets[at.doc[gone]])
            line_end = np.minimum(ends[k] + 1, block.offsets[at.doc[gone] + 1])
            np.add.at(change, line_start, 1)
            np.add.at(change, line_end, -1)
            keep = np.cumsum(change[:-1]) == 0
            before = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
            removed = np.bincount(at.doc[gone], minlength=n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(removed)]).astype(np.int32)),
                                             pa.array(at.number[gone].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc")[block.rows], pa.array(total.astype(np.int64)), pa.array(removed.astype(np.int64)),
                 lists.cast(pa.list_(pa.int32())),
                 pa.LargeStringArray.from_buffers(n, pa.py_buffer(before[block.offsets]), pa.py_buffer(np.ascontiguousarray(block.data[keep])))],
                names=["doc", "n_lines", "n_removed", "removed", "kept_text"])


def _one_edit(a, b):
    """Word lists a and b differ by one edit at most: their common beginning
    and end cover all but one word of the longer."""
    def common(x, y):
        n = F.least(F.size(x), F.size(y))
        differs = F.array_position(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p != q), True)
        return F.when(differs > 0, differs - 1).otherwise(n)
    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def line_dedup(docs: DataFrame, min_words: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines, n_removed, removed (line numbers),
    kept_text (the other lines, with their line ends)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    text = base.withColumn("home", F.coalesce("doc", F.xxhash64(F.monotonically_increasing_id()))).repartition("home")
    lines = base.mapInArrow(_line_rows(min_words), LINE_SCHEMA)
    seen = stored(lines.drop("halves"))
    distinct = seen.where("not later").groupBy("h1", "h2").agg(F.min(F.struct("doc", "line")).alias("first"))
    halves = lines.where("not later").select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b")
    near = halves.join(shared, "half", "left_semi").select("h1").distinct()
    asked = distinct.join(near, "h1").groupBy(F.col("first.doc").alias("home")) \
        .agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "h1")).alias("asked"))
    variants = text.join(asked, "home").select("doc", "text", "asked").mapInArrow(_variant_rows, VARIANT_SCHEMA)
    same_place, same = Window.partitionBy("v1", "v2", "place"), Window.partitionBy("v1", "v2")
    spot = F.struct("doc", "line")
    open_ = F.col("near_doc").isNull()
    whole = F.min(F.when(open_ & (F.col("place") < 0), spot)).over(same)
    part = F.min(F.when(open_ & (F.col("place") >= 0), spot)).over(same)
    peer = F.min(F.when(open_, spot)).over(same_place)
    nearest = F.when(~open_, F.struct(F.col("near_doc").alias("doc"), F.col("near_line").alias("line"))) \
        .when(F.col("place") < 0, part).otherwise(F.least(whole, peer))
    near = variants.repartition("v1").withColumn("near", nearest).where(F.col("near") < spot) \
        .groupBy("h1", "h2").agg(F.min("near").alias("near"), F.min(spot).alias("spot"))
    found = _verified(near, text)
    firsts = distinct.select("h1", "h2", "first").join(found, ["h1", "h2"], "left") \
        .select("h1", "h2", F.coalesce(F.least("first", "near"), "first").alias("limit"))
    gone = seen.where("not later").join(firsts, ["h1", "h2"]).where(spot > F.col("limit")).select("doc", "line", "h1") \
        .union(seen.where("later").select("doc", "line", "h1"))
    per_doc = gone.groupBy(F.col("doc").alias("home")).agg(F.collect_list(F.struct("line", "h1")).alias("drop"))
    none = F.array().cast("array<struct<line:bigint,h1:bigint>>")
    out = text.join(per_doc, "home", "left").select("doc", "text", F.when(F.col("doc").isNull(), none).otherwise(F.coalesce("drop", none)).alias("drop"))
    return out.mapInArrow(_cut, OUT_SCHEMA).withColumnRenamed("doc", id_col)


def _line_words(batches):
    """Documents with the lines asked for (structs with a field ``line``) ->
    each of them with its words. A document is split once; rows without an
    id, which only share a place with one, have none."""
    for batch in batches:
        asked = batch.column("asked")
        known = batch.column("doc").is_valid().to_pylist()
        flat, counts = asked.flatten(), asked.value_lengths().to_pylist()
        numbers, at, found = flat.field("line").to_pylist(), 0, []
        for text, count, named in zip(batch.column("text"), counts, known):
            lines = (text.as_py() or "").split("\n") if named else []
            for n in numbers[at + len(found):at + len(found) + count]:
                found.append([w for w in _BLANK.split(lines[n]) if w] if n < len(lines) else None)
            if len(found) >= 4096:
                yield _asked_words(flat, at, found)
                at, found = at + len(found), []
        if found:
            yield _asked_words(flat, at, found)


def _asked_words(flat, at: int, found: list):
    return pa.RecordBatch.from_arrays([flat.slice(at, len(found)), pa.array(found, pa.list_(pa.string()))], names=["asked", "words"])


def _verified(near: DataFrame, text: DataFrame) -> DataFrame:
    """``near`` after comparing each line with the neighbour that decides its
    fate, word by word. One comparison a line; a neighbour's words travel once,
    however many lines it decides. Rows that share an id give several texts
    for one line: any pair within the bound will do."""
    def words(asked, kind):
        # Joined on the column that ``text`` is dealt out by, with all its columns, so that its one shuffle serves every use.
        lists = asked.where("home is not null").groupBy("home").agg(F.collect_list("asked").alias("asked"))
        return text.join(lists, "home").select("doc", "text", "asked").mapInArrow(_line_words, f"asked {kind}, words array<string>")
    spot = near.select(F.col("spot.doc").alias("home"), F.struct(F.col("spot.line").alias("line"), "h1", "h2", "near").alias("asked"))
    peer = near.select(F.col("near.doc").alias("home"), F.struct(F.col("near.line").alias("line"), F.col("near.doc").alias("doc")).alias("asked")).distinct()
    a = words(spot, "struct<line:bigint,h1:bigint,h2:bigint,near:struct<doc:bigint,line:bigint>>") \
        .select("asked.h1", "asked.h2", "asked.near", F.col("words").alias("a"))
    b = words(peer, "struct<line:bigint,doc:bigint>").select(F.struct("asked.doc", "asked.line").alias("near"), F.col("words").alias("b"))
    return a.join(b, "near").where(_one_edit(F.col("a"), F.col("b"))).select("h1", "h2", "near").distinct()
