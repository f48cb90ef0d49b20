"""Operator 2: near-duplicate detection with min-max hashing.

Under each permutation both the smallest and the largest value of a
document's shingle set are kept. Either agrees between two sets with
probability J (their Jaccard similarity), so half the hash evaluations give
a signature of the same length, and less variance, as the two are drawn
without replacement. Bands of ``rows`` values (min and max of rows / 2
permutations) become bucket keys. With 64 permutations and bands of 4, a
pair of similarity 0.8 shares no bucket with probability
(1 - 0.8 ** 4) ** 32 = 5e-8.

Candidates are confirmed on the full sets, and nothing in a bucket is capped:

* Equal sets are one vertex (grouped with partial aggregation, so a third of
  all rows may be copies of one text).
* A bucket whose members are all connected is settled, as further links
  could not change the result. First one member of each bucket, the most
  central, is compared with all others: the one that meets most texts over
  all its buckets. Of the copies of a text that is the text itself or the
  least changed copy, which is nearer to the others than they are to each
  other, so little is left open.
* What is left are pairs of different components. For them an exact prefix
  join takes over: with the shingles in one order, rarest first, a pair that
  reaches the threshold must share one of its first (1 - threshold) of
  shingles, and the places p and q of the first one that it shares bound the
  intersection by 1 + min(|x| - p, |y| - q). Only pairs of different
  components that pass this bound are compared.

So the comparisons grow with the texts that stay apart although they look
alike, not with the square of a group's size.

Results: one row per document with its set's size, its component's smallest
id, and whether it is the one that stays.

Edge cases: null text counts as empty; without words a document has an empty
set, links with nothing and stays; with fewer words than a shingle the whole
sequence is its one shingle; rows without an id link with nothing and stay
(component null); rows that share an id are one document with several texts;
an empty table gives no rows; other columns are ignored. Only A-Z are
lower-cased; words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import merge_components
from .stored import stored
from .textarrays import Block, SpanHasher, blocks, lower_ascii, mix, words

_U = np.uint64


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document: (hashes, first)."""
    lowered = Block(block.rows, lower_ascii(block.data), block.offsets)
    w = words(lowered)
    h = SpanHasher(SpanHasher(lowered.data)(w.start, w.end))
    lo, hi = w.first[:-1], w.first[1:]
    sets = []
    for a, b in zip(lo.tolist(), hi.tolist()):
        start = np.arange(a, max(a + 1, b - size + 1)) if b > a else np.zeros(0, np.int64)
        sets.append(np.unique(h(start, np.minimum(start + size, b))))
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), first


def _bands(hashes: np.ndarray, first: np.ndarray, permutations: int, rows: int) -> np.ndarray:
    """(documents with a set x bands) keys; min and max per permutation."""
    some = np.flatnonzero(np.diff(first))
    at = first[some]
    per_band = rows // 2
    keys = np.zeros((len(some), permutations // per_band), _U)
    multipliers = mix(np.arange(1, permutations + 1, dtype=_U)) | _U(1)
    for p in range(permutations):
        x = mix(hashes ^ multipliers[p])
        band = p // per_band
        for value in (np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)):
            keys[:, band] = mix(keys[:, band] * _U(0x9E3779B97F4A7C15) + value)
    return mix(keys + np.arange(keys.shape[1], dtype=_U) * _U(0xD6E8FEB86659FD93))


def _signatures(size: int, permutations: int, rows: int):
    n_bands = permutations // (rows // 2)

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                hashes, first = shingle_sets(block, size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                keys = np.zeros((2, len(n)), _U)
                if len(some):
                    keys[0, some] = mix(np.add.reduceat(mix(hashes), first[some]))
                    keys[1, some] = mix(np.add.reduceat(mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)), first[some]))
                    flat = _bands(hashes, first, permutations, rows).view(np.int64).ravel()
                else:
                    flat = np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum((n > 0) * n_bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[block.rows], pa.array(n), *[pa.array(k.view(np.int64)) for k in keys],
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(pa.list_(pa.int64()))],
                    names=["id", "n", "k1", "k2", "bands"])

    return run


def _set_rows(size: int):
    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                hashes, first = shingle_sets(block, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[block.rows],
                     pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64))).cast(pa.list_(pa.int64()))],
                    names=["id", "shingles"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, permutations: int = 64, rows: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept. Documents
    are linked when 100 * |A and B| >= percent * |A or B|."""
    if rows % 2 or permutations % (rows // 2):
        raise ValueError("rows is even, and permutations a multiple of rows / 2")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(base.mapInArrow(_signatures(shingle, permutations, rows), "id long, n long, k1 long, k2 long, bands array<long>"))
    vertices = signed.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    members = vertices.select("id", "n", F.explode("bands").alias("bucket"))
    several = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(members.join(several, "bucket"))
    # How many others a text meets, over all its buckets: the text that the others were copied from meets most.
    central = members.groupBy("id").agg(F.sum("size").alias("met"))
    members = stored(members.drop("size").join(central, "id"))
    labels = stored(members.select("id").distinct().withColumn("comp", F.col("id")))
    sets = stored(base.join(labels.select("id"), "id").mapInArrow(_set_rows(shingle), "id long, shingles array<long>"))
    leaders = members.groupBy("bucket").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("a"))
    stars = members.select("bucket", F.col("id").alias("b")).join(leaders, "bucket").where("a != b") \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = merge_components(labels, _confirmed(stars, sets, percent))
    members = _unsettled(members, labels)
    if not members.isEmpty():
        pairs = _prefix_pairs(members, _in_order(members, sets), percent)
        labels = merge_components(labels, _confirmed(pairs, sets, percent))
    names = vertices.select("k1", "k2", F.col("id").alias("vertex")) \
        .join(labels.withColumnRenamed("id", "vertex"), "vertex", "left").select("k1", "k2", F.coalesce("comp", "vertex").alias("comp"))
    known, rest = "n > 0 and id is not null", "not (n > 0 and id is not null)"
    found = signed.where(known).select("id", "n", "k1", "k2").join(names, ["k1", "k2"]).select("id", "n", "comp")
    alone = signed.where(rest).select("id", "n", F.col("id").alias("comp"))
    return found.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"),
                                     F.col("id").eqNullSafe(F.col("comp")).alias("kept"))


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, id, n, comp) of buckets with several components."""
    placed = members.select("bucket", "id", "n").join(labels, "id")
    several = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return stored(placed.join(several, "bucket", "left_semi"))


def _in_order(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Per member its shingles (id, ordered), those that fewest members have first."""
    single = sets.join(members.select("id").distinct(), "id").select("id", F.explode("shingles").alias("shingle"))
    counted = single.join(single.groupBy("shingle").agg(F.count(F.lit(1)).alias("many")), "shingle")
    per_id = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("many", "shingle"))).alias("o"))
    return per_id.select("id", F.col("o.shingle").alias("ordered"))


def _prefix_pairs(members: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach the threshold."""
    n = F.size("ordered")
    needed = F.ceil(n * F.lit(percent) / 100).cast("int")
    rows = stored(ordered.join(members.select("id", "comp").distinct(), "id").select(
        "id", "comp", n.alias("n"), F.posexplode(F.slice("ordered", 1, n - needed + 1)).alias("at", "shingle")))
    side = lambda *names: rows.select("shingle", *[F.col(c).alias(x) for c, x in zip(("id", "comp", "n", "at"), names)])
    most = 1 + F.least(F.col("n_a") - F.col("p") - 1, F.col("n_b") - F.col("q") - 1)
    possible = (F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & (100 * most >= percent * (F.col("n_a") + F.col("n_b") - most))
    return side("a", "c", "n_a", "p").join(side("b", "d", "n_b", "q"), "shingle").where(possible).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold."""
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b") \
        .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a") \
        .where(100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b").distinct()
