"""Operator 13: ranked lexical search by pipelined term partitioning.

The terms of the queries (items) are owned by stages: rare terms by the
first, common ones by the last. Documents are indexed in blocks; an index row
holds what one stage owns of one block: for each of its terms the documents
of the block and the term's whole contribution to their scores, an integer.
Items travel in bundles. A bundle visits a block stage by stage: at each, it
is cogrouped with that stage's index row, adds the contributions to its sparse
accumulators (item, document, score), and goes on. After the last stage each
item's best documents of the block are known, and a ranking over all blocks
selects the final ones.

Between two stages a bundle leaves behind the accumulators that cannot get
into the item's best ``top`` of the block any more, even with the most that
all later stages can add (a term of weight w adds less than 1,000,000 w).
That loses nothing: ``top`` documents of the block already have more. As the
last stage, where nearly every document gets an accumulator, ends in the
selection, the large table of (item, document) scores is never shuffled.

Groups are bounded: a block has at most ``block_docs`` documents, a bundle at
most ``bundle_items`` items, whatever terms are common. The queries
themselves are taken in passes of about ``pairs_per_pass`` (item, term)
pairs; a pass sends its terms and items to the tasks (at most that many pairs,
or one item's, each of at most 65 bytes, as longer terms go by SHA-256) and
reads all documents twice: for the statistics, and for the index.

Scores: with N documents that have a term, L terms in all of them, n in one
document, df documents with the term, tf times in this one,
w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 75 + (25 n N) div L, an item's
terms, repeats included, add w ((10^9 tf) div (1000 tf + 12 m)).

Edge cases: null text has no term, neither has one without word characters;
such documents are in no count and no result, such items have no result;
every row is a document of its own and every item row a query of its own,
also if ids are null, tie or repeat; equal scores rank by id, null last;
documents of any length are read whole, in pieces; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.stored import stored, written
from .exact_dedup import lower_ascii
from .license_scan import WORD_BYTES

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LONG_TERM = 64
PIECE_BYTES = 1 << 20
MOST = 1_000_000  # a term of weight w adds less than MOST * w


def term_counts(data: bytes) -> Counter:
    """A text's terms and how often each occurs."""
    plain = data.translate(WORD_BYTES)
    counts: Counter = Counter()
    at = 0
    while at < len(plain):
        cut = plain.find(b" ", at + PIECE_BYTES)
        cut = len(plain) if cut < 0 else cut
        counts.update(plain[at:cut].split())
        at = cut
    return counts


def _query_terms(counts: Counter, vocabulary: dict[bytes, int], long_terms: bool) -> list[tuple[int, int]]:
    """(number, tf) of the terms of the queries."""
    found = [(vocabulary[t], counts[t]) for t in counts.keys() & vocabulary.keys()]
    if long_terms:
        keys = ((b" " + hashlib.sha256(t).hexdigest().encode(), tf) for t, tf in counts.items() if len(t) > LONG_TERM)
        found += [(vocabulary[k], tf) for k, tf in keys if k in vocabulary]
    return found


class Pass:
    """One block of the query set: its terms, by number, and its items."""

    def __init__(self, pairs: pa.Table, bundle_items: int):
        keys = [k.encode() for k in pairs.column("key").to_pylist()]
        self.vocabulary = {k: i for i, k in enumerate(sorted(set(keys)))}
        self.long_terms = any(k[:1] == b" " for k in self.vocabulary)
        self.items = sorted(set(pairs.column("item").to_pylist()))
        place = {item: i for i, item in enumerate(self.items)}
        term = np.array([self.vocabulary[k] for k in keys], np.int64)
        item = np.array([place[i] for i in pairs.column("item").to_pylist()], np.int64)
        times = np.array(pairs.column("times").to_pylist(), np.int64)
        self.bundle_items = bundle_items
        self.bundles = -(-len(self.items) // bundle_items)
        order = np.lexsort((item, term))
        term, item, times = term[order], item[order], times[order]
        # Of each bundle: its terms, and for each of them its items (by place in the bundle) and how often they hold it.
        self.of_bundle = []
        for b in range(self.bundles):
            mine = item // bundle_items == b
            own, first = np.unique(term[mine], return_index=True)
            self.of_bundle.append((own, np.append(first, np.count_nonzero(mine)), item[mine] % bundle_items, times[mine]))

    def weigh(self, df: dict[int, int], n_docs: int, shares: tuple[float, ...]) -> None:
        """Weights, owner stages, and what later stages can add to an item."""
        count = np.array([df.get(t, 0) for t in range(len(self.vocabulary))], np.int64)
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in count.tolist()], np.int64)
        self.stage = np.searchsorted(np.array(shares) * n_docs, count, "left") if len(shares) else np.zeros(len(count), np.int64)
        self.stages = len(shares) + 1
        self.later = []
        for terms, first, item, times in self.of_bundle:
            per_pair = np.repeat(terms, np.diff(first))
            most = np.zeros((self.stages, self.bundle_items), np.int64)
            np.add.at(most, (self.stage[per_pair], item), MOST * self.weight[per_pair] * times)
            self.later.append(most[::-1].cumsum(axis=0)[::-1] - most)


def _texts(batch):
    for text in batch.column("text"):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _statistics(query: Pass):
    """df of each term; under -1 the documents with a term, under -2 all terms."""
    def run(batches):
        total = Counter()
        for batch in batches:
            for text in _texts(batch):
                counts = term_counts(text)
                if counts:
                    total[-1] += 1
                    total[-2] += counts.total()
                    total.update(t for t, _ in _query_terms(counts, query.vocabulary, query.long_terms))
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return run


def _index(query: Pass, n_docs: int, n_terms: int, block_docs: int, schema: pa.Schema):
    """Index rows: one per bundle, block and stage. The last stage's is
    always there and holds the block's document ids."""
    def rows(block, ids, terms, docs, counts, lengths):
        m = np.array([75 + 25 * n * n_docs // n_terms for n in lengths], np.int64)
        term, doc, tf = (np.array(x, np.int64) for x in (terms, docs, counts))
        gain = query.weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        order = np.argsort(term, kind="stable")
        term, doc, gain = term[order], doc[order], gain[order]
        stage = query.stage[term]
        out = []
        for b, (own, *_) in enumerate(query.of_bundle):
            mine = np.isin(term, own) if query.bundles > 1 else np.ones(len(term), bool)
            for s in range(query.stages):
                at = np.flatnonzero(mine & (stage == s))
                last = s == query.stages - 1
                if len(at) or last:
                    out.append((b, block, s, term[at], doc[at], gain[at], ids if last else [], len(ids)))
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        state = [], [], [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), _texts(batch)):
                found = term_counts(text)
                hits = _query_terms(found, query.vocabulary, query.long_terms)
                if not hits:
                    continue
                ids, terms, docs, counts, lengths = state
                terms += [t for t, _ in hits]
                counts += [c for _, c in hits]
                docs += [len(ids)] * len(hits)
                ids.append(doc_id)
                lengths.append(found.total())
                if len(ids) == block_docs:
                    yield rows(block, *state)
                    block, state = block + 1, ([], [], [], [], [])
        if state[0]:
            yield rows(block, *state)

    return run


def _scores(query: Pass, bundle: int, left: pa.Table, right: pa.Table, width: int) -> np.ndarray:
    """The bundle's accumulators of a block, with the stage's contributions."""
    scores = np.zeros((query.bundle_items, width), np.int64)
    flat = lambda table, name: table.column(name).combine_chunks().values.to_numpy(zero_copy_only=False)
    if left.num_rows:
        scores[flat(left, "items"), flat(left, "docs")] = flat(left, "scores")
    if right.num_rows:
        own, first, item, times = query.of_bundle[bundle]
        term, doc, gain = (flat(right, name) for name in ("terms", "docs", "gains"))
        if len(term):
            starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            for lo, hi, at in zip(starts, np.append(starts[1:], len(term)), np.searchsorted(own, term[starts])):
                who = slice(first[at], first[at + 1])
                scores[item[who, None], doc[None, lo:hi]] += times[who, None] * gain[None, lo:hi]
    return scores


def _best(scores: np.ndarray, later: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, document) places that may still be among the item's best."""
    if scores.shape[1] <= top:
        return np.nonzero(scores)
    least = np.partition(scores, -top, axis=1)[:, -top]
    return np.nonzero((scores > 0) & (scores + later[:, None] >= least[:, None]))


def _visit(query: Pass, stage: int, top: int):
    """A bundle's visit to a stage that is not the last."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left
        bundle, width = key[0].as_py(), right.column("width")[0].as_py()
        scores = _scores(query, bundle, left, right, width)
        item, doc = _best(scores, query.later[bundle][stage], top)
        return pa.table({"bundle": [bundle], "block": [key[1].as_py()], "items": [item.astype(np.int32)], "docs": [doc.astype(np.int32)],
                         "scores": [scores[item, doc]]}, schema=left.schema)

    return run


def _select(query: Pass, top: int, schema: pa.Schema):
    """The last visit: each item's best documents of the block."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        bundle = key[0].as_py()
        ids = right.column("ids")[0].as_py()
        scores = _scores(query, bundle, left, right, len(ids))
        item, doc = _best(scores, np.zeros(len(scores), np.int64), top)
        ranked = sorted(zip(item.tolist(), (-scores[item, doc]).tolist(), [(ids[d] is None, ids[d]) for d in doc.tolist()]))
        kept, so_far = [], Counter()
        for i, score, (_, doc_id) in ranked:
            if so_far[i] < top:
                so_far[i] += 1
                kept.append((query.items[bundle * query.bundle_items + i], doc_id, -score))
        columns = list(zip(*kept)) if kept else [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


_BUNDLES = "bundle int, block long, items array<int>, docs array<int>, scores array<long>"


def _search(rows: DataFrame, query: Pass, top: int, block_docs: int, shares: tuple[float, ...]) -> DataFrame | None:
    """(item, id, score): at least each item's best documents."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    counts = rows.select("text").mapInArrow(_statistics(query), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in counts.collect()}  # a row for each term of the pass
    n_docs, n_terms = df.pop(-1, 0), df.pop(-2, 0)
    if not n_docs:
        return None
    query.weigh(df, n_docs, shares)
    kind = rows.schema["id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"bundle int, block long, stage int, terms array<long>, docs array<long>, gains array<long>, ids array<{kind}>, width int")
    index = written(rows.mapInArrow(_index(query, n_docs, n_terms, block_docs, to_arrow_schema(empty.schema)), empty.schema), "stage")
    bundles = spark.createDataFrame([], _BUNDLES)
    meet = lambda s: bundles.groupBy("bundle", "block").cogroup(
        index.where(F.col("stage") == s).select("bundle", "block", "terms", "docs", "gains", "ids", "width").groupBy("bundle", "block"))
    for s in range(query.stages - 1):
        bundles = meet(s).applyInArrow(_visit(query, s, top), _BUNDLES)
    found = spark.createDataFrame([], f"item long, id {kind}, score long")
    return meet(query.stages - 1).applyInArrow(_select(query, top, to_arrow_schema(found.schema)), found.schema)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", block_docs: int = 2048, bundle_items: int = 256,
                  pairs_per_pass: int = 250_000, shares: tuple[float, ...] = (0.001, 0.02)) -> DataFrame:
    """Per item its ``top`` documents: item id, rank, id, score. ``shares``:
    up to which share of all documents a stage's terms may be in (the last
    stage has the rest)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    queries = numbered(items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")),
                       [], ["item_id", "text"], seq="item")
    term = F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)))
    key = F.when(F.octet_length("term") > LONG_TERM, F.concat(F.lit(" "), F.sha2(F.col("term").cast("binary"), 256))).otherwise(F.col("term"))
    pairs = queries.select("item", term.alias("term")).groupBy("item", key.alias("key")).agg(F.count(F.lit(1)).alias("times"))
    pairs = numbered(pairs, [], ["item", "key"], seq="at")
    passes = pairs.groupBy("item").agg(F.floor((F.min("at") - 1) / pairs_per_pass).alias("pass"))
    pairs = stored(pairs.join(passes, "item").select("pass", "item", "key", "times"))
    found = None
    for p in range((pairs.agg(F.max("pass")).first()[0] or 0) + 1):
        part = pairs.where(F.col("pass") == p).select("item", "key", "times").toArrow()
        part = _search(rows, Pass(part, bundle_items), top, block_docs, shares)
        if part is not None:
            found = part if found is None else found.union(part)
    if found is None:
        found = rows.where("false").select(F.lit(0).cast("long").alias("item"), "id", F.lit(0).cast("long").alias("score"))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(queries.select("item", "item_id"), "item") \
        .select(F.col("item_id").alias(item_id_col), "rank", F.col("id").alias(id_col), "score")
