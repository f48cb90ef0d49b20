"""Deduplication operators against brute force, and their edge cases."""

import hashlib
from collections import Counter

import pytest

from opslens.llm.exact_dedup import exact_dedup, lower_ascii
from opslens.llm.line_dedup import line_dedup
from opslens.llm.minhash_dedup import near_duplicates
from opslens.llm.substring_dedup import longest_repeats, substring_dedup
from opslens.llm.suffix_dedup import suffix_dedup

from . import brute
from .conftest import EDGES, corpus


@pytest.mark.parametrize("seed,window", [(1, 13), (2, 5)])
def test_substring_dedup(frame, seed, window):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame(rows), window).collect()}
    assert got == brute.substring(rows, window)


@pytest.mark.parametrize("seed,window", [(3, 100), (4, 30)])
def test_suffix_dedup(frame, seed, window):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in suffix_dedup(frame(rows), window).collect()}
    assert got == brute.suffix(rows, window)


def test_suffix_spans_are_the_removed_runs(frame):
    rows = corpus(5, 30)
    text = dict(rows)
    for r in suffix_dedup(frame(rows), 40).collect():
        b = (text[r.doc_id] or "").encode()
        kept = b"".join(b[a:z] for a, z in zip([0, *[s.end for s in r.removed]], [*[s.start for s in r.removed], len(b)]))
        assert kept == bytes(r.kept)


@pytest.mark.parametrize("seed,size", [(6, 4), (7, 5), (8, 2)])
def test_near_duplicates(frame, seed, size):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(rows), size).collect()}
    assert got == brute.components(rows, size, 80)


def test_near_duplicates_in_one_large_bucket(frame):
    """Many different texts around one base: only some pairs reach the threshold, chains connect others."""
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(120):
        w = list(base)
        for k in range(1 + d % 5):
            w[(7 * d + 11 * k) % 60] = f"x{d % 40}_{k}"
        rows.append((d, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(rows), 3).collect()}
    assert got == brute.components(rows, 3, 80)


@pytest.mark.parametrize("seed", [9, 10])
def test_line_dedup(frame, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup(frame(rows), 6).collect()}
    assert got == brute.lines(rows, 6)


def test_line_neighbours(frame):
    line = "alpha beta gamma delta epsilon zeta eta".split()
    inserted, deleted, replaced = line[:3] + ["x"] + line[3:], line[1:], line[:6] + ["y"]
    two = ["p", "q"] + line[2:]
    rows = [(k, " ".join(w) + "\nown line of document " + str(k) * (k + 1) + " alone here") for k, w in
            enumerate([line, inserted, deleted, replaced, two, line])]
    got = {r.doc_id: list(r.removed) for r in line_dedup(frame(rows), 6).collect()}
    # "own line" differs by one word from document to document: a neighbour of the first
    assert got == {0: [], 1: [0, 1], 2: [0, 1], 3: [0, 1], 4: [1], 5: [0, 1]}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(frame, keep):
    rows = corpus(11)
    best = min if keep == "smallest" else max
    groups = {}
    for d, t in rows:
        groups.setdefault(brute.lower(t), []).append(d)
    want = {d: (best(g), len(g), best(g) == d, hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256)
           for r in exact_dedup(frame(rows), keep=keep, normalise=lower_ascii).collect()}
    assert got == want


def test_lower_ascii_leaves_other_letters(spark):
    text = "ÀÉÎ ABC İI ẞ"
    assert spark.createDataFrame([(text,)], "t string").select(lower_ascii(__import__("pyspark.sql.functions").sql.functions.col("t"))).first()[0] == brute.lower(text)


def test_longest_repeats(frame):
    a = [f"a{i}" for i in range(64)]
    rows = [(0, " ".join(a)), (1, " ".join(a[:33] + ["z"])), (2, " ".join(a[:9])), (3, "nothing in common with any other text at all")]
    got = {r.doc_id: r.longest for r in longest_repeats(frame(rows), 8).collect()}
    assert got == {0: 32, 1: 32, 2: 8}


OPERATORS = {"substring": substring_dedup, "suffix": suffix_dedup, "near": near_duplicates, "lines": line_dedup, "exact": exact_dedup}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(frame, name):
    """Null ids and texts, repeated rows, empty tables: no crash, one row per
    input row, and rows without an id are never cut or dropped for a repeat."""
    op = OPERATORS[name]
    assert op(frame(EDGES[:0])).collect() == []
    got = op(frame(EDGES)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in EDGES)
    if name in ("substring", "suffix", "lines"):
        assert all(r.n_removed == 0 for r in got if r.doc_id is None or r.doc_id == 5)
    if name == "near":
        assert all(r.kept for r in got)
        assert {r.component_id for r in got if r.doc_id is None} == {None}
    if name == "exact":
        full = [r for r in got if r.text_sha256 == hashlib.sha256(EDGES[0][1].encode()).hexdigest()]
        assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in full) == [(False, 5, 3, True)] * 2 + [(True, 5, 3, False)]


def test_same_id_other_text_is_not_cut(frame):
    """A verdict for one text of an id does not fall on another text of that id."""
    long = " ".join(f"k{i}" for i in range(40))
    rows = [(1, long), (2, long), (2, " ".join(f"m{i}" for i in range(40)))]
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup(frame(rows), 13).collect())
    assert got == [(1, 0), (2, 0), (2, 40)]
    got = sorted((r.doc_id, r.n_removed > 0) for r in suffix_dedup(frame(rows), 50).collect())
    assert got == [(1, False), (2, False), (2, True)]
