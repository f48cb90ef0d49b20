"""Operator 4: quality classifier, a generalised additive model with pairwise
interactions.

Every text becomes a fixed list of numbers (shares of character kinds, word
shapes, repetition). Training is cyclic boosting: round after round, each
feature in turn gets a shallow tree on its bins, fitted to the logistic
loss's gradients and added, shrunk, to the feature's lookup table. The
feature pairs that explain most of what is left then get two-way tables in
the same manner. A score is the logistic of the sum of table entries, so
scoring is binning and additions.

The model is fitted on a bounded sample, at most ``max_rows`` labelled rows
with the smallest id hash; only their feature vectors come to the driver.
Scoring reads every whole text where it lies, without a shuffle. Labels,
ids, languages and sources are not among the inputs.

Edge cases: null text counts as empty and gets the score of an empty text;
labels other than 0 and 1 are ignored, and of several for one id the
smallest counts; with no labels the score is 0.5, with one class the
smoothed prior; rows are scored one by one, so repeats agree and null ids
pass through; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import Block, SpanHasher, blocks, mix, owners, words

FEATURES = ("log_words", "upper", "digit", "exclaim", "pipe", "symbol", "stop", "comma", "non_ascii", "newline", "other_mark",
            "word_length", "long_words", "capitalised", "same_as_last", "distinct", "marked_words", "control")
_KINDS = {
    "upper": range(65, 91), "digit": range(48, 58), "exclaim": b"!", "pipe": b"|", "symbol": b"#$%&*", "stop": b".?", "comma": b",;:",
    "non_ascii": range(128, 256), "newline": b"\n", "other_mark": b"\"'()+-/<=>@[\\]^_`{}~",
    "control": [*range(9), *range(11, 32), 127],
}


def features(block: Block) -> np.ndarray:
    """(documents x FEATURES) for a block."""
    n = len(block.offsets) - 1
    size = np.diff(block.offsets)
    kinds = np.zeros((256, len(_KINDS)))
    for k, chars in enumerate(_KINDS.values()):
        kinds[list(chars), k] = 1
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    shares = np.bincount(doc * 256 + block.data, minlength=n * 256).reshape(n, 256) @ kinds / np.maximum(size, 1)[:, None]
    share = dict(zip(_KINDS, shares.T))
    w = words(block)
    count = np.diff(w.first)
    some = np.maximum(count, 1)
    own = owners(w.first)
    h = SpanHasher(block.data)(w.start, w.end)
    length = w.end - w.start
    total = lambda x: np.bincount(own, weights=x, minlength=n)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    distinct = np.unique(mix(h + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    upper = lambda at: (at >= 65) & (at <= 90)
    letter = lambda at: upper(at) | ((at >= 97) & (at <= 122)) | (at >= 128)
    last = block.data[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    head = block.data[w.start] if len(h) else np.zeros(0, np.uint8)
    cols = share | {
        "log_words": np.log1p(count), "word_length": total(length) / some, "long_words": total(length > 14) / some,
        "capitalised": total(upper(head)) / some, "same_as_last": total(again) / some,
        "distinct": np.bincount(own[distinct], minlength=n) / some, "marked_words": total(~letter(last)) / some,
    }
    return np.column_stack([cols[f] for f in FEATURES]).astype(np.float64)


@dataclass
class Gam:
    """Lookup tables. ``cuts[f]`` are the bin edges of feature f, ``tables[f]``
    its additive terms; ``pairs`` holds (f, g, cuts_f, cuts_g, table)."""

    intercept: float = 0.0
    cuts: list = field(default_factory=lambda: [np.zeros(0) for _ in FEATURES])
    tables: list = field(default_factory=lambda: [np.zeros(1) for _ in FEATURES])
    pairs: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, f], "right")]
        for f, g, cf, cg, table in self.pairs:
            total += table[np.searchsorted(cf, x[:, f], "right"), np.searchsorted(cg, x[:, g], "right")]
        return _logistic(total)

    def to_json(self) -> str:
        plain = lambda o: o.tolist()
        return json.dumps(vars(self), default=plain)

    @classmethod
    def from_json(cls, text: str) -> Gam:
        d = json.loads(text)
        arrays = lambda rows: [np.array(r, float) for r in rows]
        return cls(d["intercept"], arrays(d["cuts"]), arrays(d["tables"]),
                   [(f, g, np.array(a, float), np.array(b, float), np.array(t, float)) for f, g, a, b, t in d["pairs"]])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Up to ``bins`` - 1 edges between distinct values, at quantiles."""
    values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    return values[values > x.min()]


def _stump(grad: np.ndarray, hess: np.ndarray, penalty: float, leaves: int) -> np.ndarray:
    """Newton step per bin from a tree of up to ``leaves`` leaves: the bins
    are split greedily where the loss falls most."""
    parts = [(0, len(grad))]
    gain_of = lambda g, h: g * g / (h + penalty)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
            gain = gain_of(g[:-1], h[:-1]) + gain_of(g[-1] - g[:-1], h[-1] - h[:-1]) - gain_of(g[-1], h[-1])
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(grad))
    for a, b in parts:
        step[a:b] = grad[a:b].sum() / (hess[a:b].sum() + penalty)
    return step


def _best_quarters(grad: np.ndarray, hess: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Best cut of a two-way table into four quarters: (gain, step)."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    quarter = lambda s: (s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1],
                         s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1])
    qg, qh = quarter(g), quarter(h)
    gain = sum(a * a / (b + penalty) for a, b in zip(qg, qh))
    if not gain.size:
        return 0.0, np.zeros_like(grad)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.empty_like(grad)
    value = [a[i, j] / (b[i, j] + penalty) for a, b in zip(qg, qh)]
    step[:i + 1, :j + 1], step[:i + 1, j + 1:], step[i + 1:, :j + 1], step[i + 1:, j + 1:] = value
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 20, rate: float = 0.25, bins: int = 64,
        pair_bins: int = 16, n_pairs: int = 6, leaves: int = 4, penalty: float = 2.0) -> Gam:
    """Cyclic boosting of main effects, then of the best pairs."""
    model = Gam()
    if not len(y):
        return model
    prior = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return model
    model.cuts = [_cuts(c, bins) for c in x.T]
    at = [np.searchsorted(c, v, "right") for c, v in zip(model.cuts, x.T)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f, bin_of in enumerate(at):
            p = _logistic(z)
            grad = np.bincount(bin_of, y - p, len(model.tables[f]))
            hess = np.bincount(bin_of, p * (1 - p), len(model.tables[f]))
            step = rate * _stump(grad, hess, penalty, leaves)
            model.tables[f] += step
            z += step[bin_of]
    coarse = [_cuts(c, pair_bins) for c in x.T]
    at = [np.searchsorted(c, v, "right") for c, v in zip(coarse, x.T)]

    def sums(f, g, p):
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        cell = at[f] * shape[1] + at[g]
        return [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p))]

    p = _logistic(z)
    gains = sorted(((-_best_quarters(*sums(f, g, p), penalty)[0], f, g) for f in range(len(FEATURES)) for g in range(f)))
    model.pairs = [(f, g, coarse[f], coarse[g], np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1))) for _, f, g in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for f, g, _, _, table in model.pairs:
            step = rate * _best_quarters(*sums(f, g, _logistic(z)), penalty)[1]
            table += step
            z += step[at[f], at[g]]
    return model


def _feature_rows(batches):
    for batch in batches:
        for block in blocks(batch.column("text")):
            x = features(block)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("label")[block.rows], flat], names=["label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, allowed=None, max_rows: int = 20_000, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality") -> Gam:
    """Fit on at most ``max_rows`` labelled rows (smallest id hash first); of
    rows that share an id, the smallest text. ``allowed`` maps the id column
    to the rows that may be learnt from."""
    key = F.col(id_col)
    known = labels.where(F.col(label_col).isin(0, 1) & key.isNotNull() & (allowed(key) if allowed else F.lit(True))) \
        .groupBy(key.alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # at most max_rows rows of two numbers: fit to broadcast
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id") \
        .groupBy("id", "label").agg(F.min("text").alias("text"))
    got = rows.select("text", "label").mapInArrow(_feature_rows, "label int, x array<double>").toArrow()
    y = got["label"].to_numpy().astype(float)
    x = np.array(got["x"].to_pylist(), float).reshape(len(y), len(FEATURES))
    by = np.lexsort((*x.T, y))  # the order rows arrive in must not matter
    return fit(x[by], y[by])


def _scores(model: Gam):
    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id")[block.rows], pa.array(model.score(features(block)))],
                                                 names=["id", "score"])

    return run


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, score, predicted."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scores(model), "id string, score double").select(
        F.col("id").cast(kind).alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_column(model: Gam, text):
    """The score as a column, for filters that keep all other columns."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(model.score(features(b))) for b in blocks(texts)]) if len(texts) else pa.array([], pa.float64())

    return score(text.cast("string"))
