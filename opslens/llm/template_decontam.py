"""Operator 10: benchmark decontamination by template canonicalisation.

Texts become template tokens: words without the marks around them, in lower
case; numbers, units after a number, and names become typed placeholders. A
window of ``window`` template tokens that a document shares with a benchmark
item is a hit. Placeholders hide which number or name stood there, so
questions with other parameters still hit; slot consistency then tells them
from chance: along one alignment of document and item, equal slots of the
item must stand for equal values in the document. A window whose slots hold
the item's own values always counts; one with other values counts unless it
holds a value of the item that stands for several values in the alignment.

An item is leaked into a document when at least ``min_windows`` of its
windows (all of them, if it has fewer) count.
Eight tokens and six windows mean a run of 13 tokens, or as much with a
change in between.

Whether a word is a name, or a unit, depends on its case and on what stands
before it, so the same words can be other template tokens elsewhere. Windows
are therefore taken in three forms: the template, the template with names as
plain words, and plain words alone, all in lower case. A window of the item
found in any form is found. A window with placeholders holds at least
``MIN_LITERAL`` words; windows of values alone (a table of numbers) are found
by their values, as plain words.

The benchmark is the query set, every document is searched whole. Hashes of
the benchmark's windows are sent to the tasks if there are at most
``MAX_SENT`` of them, which keeps windows without a hit off the network;
beyond that all windows are joined by a shuffle, with the same result.

Edge cases: null text counts as empty; items shorter than a window are
searched as one window of their own length, items of fewer than ``MIN_ITEM``
tokens not at all; documents and items with null ids match like others
(results name them by null and by ``text_hash``); equal items are reported
each; rows that repeat count once per (id, text); empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored
from .textarrays import Block, SpanHasher, blocks, mix, window_starts, words

_U = np.uint64
MIN_ITEM = 5
MIN_LITERAL = 2
MAX_SENT = 2_000_000
# Unit words that may follow a number (fixed values).
UNITS = ("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs ms day days week weeks month months year years "
         "hour hours minute minutes second seconds meter meters metre metres mile miles kilometer kilometers gram grams "
         "kilogram kilograms liter liters litre litres percent dollar dollars euro euros cent cents usd eur gbp kmh mph hz khz "
         "mhz ghz w kw v a j kj n pa c f k").split()
_NUMBER, _UNIT, _NAME = (mix(np.array([k], _U))[0] for k in (101, 102, 103))
WINDOW_SCHEMA = "id long, text_hash long, h1 long, h2 long, pos int, slots array<string>"

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_INK = np.zeros(256, bool)  # letters, digits, and whatever is not ASCII
_INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    end = np.cumsum([len(u) for u in UNITS])
    return np.sort(SpanHasher(data)(np.concatenate([[0], end[:-1]]), end))


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte capitals À to Þ."""
    out = np.where(_UPPER[data], data + 32, data).astype(np.uint8)
    second = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[second] += 0x20
    return out


def _capital(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A capital letter (one byte, or two from À to Þ) begins at ``at``."""
    nxt = data[np.minimum(at + 1, len(data) - 1)]
    return _UPPER[data[at]] | ((data[at] == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97))


def template(block: Block):
    """Tokens of a block: (forms, first token of every document, lowered
    text, start, end). A form is (token hash, is a slot, tokens that it alone
    shows like this): the template; the template with names as plain words;
    all words plain. Windows without a token of the last kind (None: all
    have one) are the same in another form."""
    w = words(block)
    data, low = block.data, _lower(block.data)
    inked = np.concatenate([[0], np.cumsum(_INK[data])])
    place = np.flatnonzero(_INK[data])
    some = inked[w.end] > inked[w.start]
    word = np.flatnonzero(some)
    start = place[inked[w.start[word]]]
    end = place[inked[w.end[word]] - 1] + 1
    first = np.concatenate([[0], np.cumsum(some)])[w.first]
    token = SpanHasher(low)(start, end)
    number = _DIGIT[data[start]] if len(start) else np.zeros(0, bool)
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & np.isin(token[1:], _unit_hashes())
    opening = first[:-1][np.diff(first) > 0]  # first words of documents
    unit[opening] = False
    opens = np.zeros(len(start), bool)  # first word of a document, line or sentence
    opens[opening] = True
    if len(start):
        newline = np.concatenate([[0], np.cumsum(data == 10)])
        closing = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".!?:;|", np.uint8)))])
        opens[1:] |= (newline[start[1:]] > newline[end[:-1]]) | (closing[start[1:]] > closing[end[:-1]])
    after = np.minimum(start + 1 + (data[start] == 0xC3 if len(start) else 0), np.maximum(end - 1, 0))
    name = np.zeros(len(start), bool)
    if len(start):
        name = ~opens & ~number & _capital(data, start) & (after > start) & ~_capital(data, after)
    name &= ~unit
    value = number | unit
    named = np.where(number, _NUMBER, np.where(unit, _UNIT, token))
    forms = (np.where(name, _NAME, named), value | name, None), (named, value, name), (token, np.zeros(len(token), bool), value)
    return forms, first, low, start, end


def _windows(lengths: tuple[int, ...], wanted):
    """mapInArrow function: (id, text_hash, text) -> its windows; only those
    in ``wanted`` (a broadcast sorted array) if given."""

    def run(batches):
        keys = None if wanted is None else wanted.value
        for batch in batches:
            for block in blocks(batch.column("text")):
                forms, first, low, start, end = template(block)
                raw = low.tobytes()
                rows = batch.slice(block.rows.start, block.rows.stop - block.rows.start)
                for token, slot, own in forms:
                    h, h2 = SpanHasher(token), SpanHasher(token, 1)
                    slots_before = np.concatenate([[0], np.cumsum(slot)])
                    own_before = None if own is None else np.concatenate([[0], np.cumsum(own)])
                    at = np.flatnonzero(slot)
                    for length in lengths:
                        pos, doc = window_starts(first, length)
                        if own is not None:
                            differs = own_before[pos + length] > own_before[pos]
                            pos, doc = pos[differs], doc[differs]
                        literal = length - (slots_before[pos + length] - slots_before[pos])
                        enough = literal >= np.minimum(MIN_LITERAL, length)
                        pos, doc = pos[enough], doc[enough]
                        key = h(pos, pos + length)
                        if keys is not None:
                            k = np.searchsorted(keys, key)
                            hit = keys[np.minimum(k, len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool)
                            pos, doc, key = pos[hit], doc[hit], key[hit]
                        if not len(pos):
                            continue
                        a, b = slots_before[pos], slots_before[pos + length]
                        count = b - a
                        which = at[np.repeat(a - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
                        values = [raw[x:y].decode("utf-8", "replace") for x, y in zip(start[which].tolist(), end[which].tolist())]
                        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [rows.column("id").take(pa.array(doc)), rows.column("text_hash").take(pa.array(doc)), pa.array(key.view(np.int64)),
                             pa.array(h2(pos, pos + length).view(np.int64)), pa.array((pos - first[doc]).astype(np.int32)),
                             pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.string())).cast(pa.list_(pa.string()))],
                            names=["id", "text_hash", "h1", "h2", "pos", "slots"])

    return run


def _lengths(batches):
    for batch in batches:
        for block in blocks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(template(block)[1]))], names=["n"])


def leaked_items(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_windows: int = 6, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_sent: int = MAX_SENT) -> DataFrame:
    """One row per (document, item) with a leak: id, text_hash (xxhash64 of
    the text), item id, n_windows (of the item, found), item_windows,
    reparameterised (a slot holds another value than in the item)."""
    def rows(df, key, text):
        return df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))

    items = rows(benchmark, item_col, item_text_col).distinct()
    short = items.select("text").mapInArrow(_lengths, "n long").where(F.col("n").between(MIN_ITEM, window - 1)).distinct()
    lengths = tuple(sorted(r["n"] for r in short.collect()))  # fewer than ``window`` numbers
    whole = items.mapInArrow(_windows((window,), None), WINDOW_SCHEMA)
    for n in lengths:
        whole = whole.unionByName(items.mapInArrow(_of_length(n), WINDOW_SCHEMA))
    asked = stored(whole)
    n_keys = asked.select("h1").distinct().count()
    wanted = None
    if n_keys <= max_sent:
        keys = np.array([r[0] for r in asked.select("h1").distinct().collect()], np.int64).view(_U)  # at most max_sent numbers
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(keys))
    hits = rows(docs, id_col, text_col).mapInArrow(_windows((window, *lengths), wanted), WINDOW_SCHEMA)
    item_side = asked.select("h1", "h2", F.col("id").alias("item"), F.col("text_hash").alias("item_hash"), F.col("pos").alias("item_pos"),
                             F.col("slots").alias("item_slots"))
    matched = hits.join(item_side, ["h1", "h2"])
    slot_pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots"))))
    aligned = matched.groupBy("id", "text_hash", "item", "item_hash", (F.col("pos") - F.col("item_pos")).alias("shift")) \
        .agg(F.collect_set(F.struct("item_pos", "item_slots", "slots")).alias("found"), slot_pairs["item_slots"].alias("values"))
    # Values of the item that stand for several values in the document.
    torn = F.filter("values", lambda v, i: F.array_position("values", v) != i + 1)
    same = lambda w: w["item_slots"] == w["slots"]
    counted = aligned.withColumn("torn", torn) \
        .withColumn("found", F.filter("found", lambda w: same(w) | ~F.arrays_overlap(w["item_slots"], F.col("torn"))))
    sizes = asked.groupBy(F.col("id").alias("item"), F.col("text_hash").alias("item_hash")).agg(F.count_distinct("pos").alias("item_windows"))
    per_item = counted.where(F.size("found") > 0).groupBy("id", "text_hash", "item", "item_hash") \
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("found.item_pos")))).cast("long").alias("n_windows"),
             F.max(F.exists("found", lambda w: ~same(w))).alias("reparameterised"))
    return per_item.alias("p").join(sizes.alias("s"), F.col("p.item").eqNullSafe(F.col("s.item")) & (F.col("p.item_hash") == F.col("s.item_hash"))) \
        .where(F.col("n_windows") >= F.least("item_windows", F.lit(min_windows))) \
        .select(F.col("p.id").alias(id_col), F.col("p.text_hash"), F.col("p.item").alias(item_col), "n_windows", "item_windows", "reparameterised")


def _of_length(n: int):
    """Items of exactly ``n`` tokens as one window each."""
    windows = _windows((n,), None)

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                size = np.diff(template(block)[1])
                rows = batch.slice(block.rows.start, block.rows.stop - block.rows.start)
                yield from windows([rows.filter(pa.array(size == n))])

    return run
