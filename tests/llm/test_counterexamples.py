"""Inputs that once gave wrong results: hash twins, control strings cut into
parts, tables of numbers, one id for many rows, documents of many lines."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.llm import quality_gam
from opslens.llm.chat_format import PART, format_chat, read_back
from opslens.llm.line_dedup import line_dedup
from opslens.llm.minhash_dedup import near_duplicates
from opslens.llm.substring_dedup import substring_dedup
from opslens.llm.suffix_dedup import suffix_dedup
from opslens.llm.template_decontam import leaked_items
from opslens.llm.textarrays import SpanHasher

from . import brute


def thue_morse(n, a, b):
    out = [a, b]
    other = {a: b, b: a}
    while len(out) < n:
        out += [other[x] for x in out]
    return out[:n]


@pytest.mark.parametrize("n", [256, 1024, 4096])
def test_twins_hash_apart_and_equal_spans_alike(n):
    rng = np.random.default_rng(n)
    for a, b in ((97, 98), (97, 65), (0, 255), (1 << 40, 7)):
        x, y = np.array(thue_morse(n, a, b), np.uint64), np.array(thue_morse(n, b, a), np.uint64)
        both = np.concatenate([x, y, x])
        at, end = np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])
        for which in (0, 1):
            h = SpanHasher(both, which)(at, end)
            assert h[0] == h[2] != h[1]
    data = rng.integers(0, 3, 400).astype(np.uint8)
    h, lo = SpanHasher(data), np.arange(400).repeat(6)
    hi = np.minimum(lo + np.tile(np.arange(6), 400), 400)
    seen = {}
    for s, e, v in zip(lo, hi, h(lo, hi)):
        assert seen.setdefault(v, bytes(data[s:e])) == bytes(data[s:e])
    assert len(seen) == len(set(seen.values()))
    # Leaving a piece out hashes like the text without it, at its ends too.
    for start, left, right, end in ((0, 0, 0, 9), (0, 0, 3, 9), (5, 9, 9, 9), (5, 8, 9, 9), (2, 4, 5, 9), (2, 2, 9, 9), (3, 4, 5, 6)):
        cut = np.concatenate([data[start:left], data[right:end]])
        span = [np.array([x]) for x in (start, left, right, end)]
        assert h.joined(*span)[0] == SpanHasher(cut)(np.array([0]), np.array([len(cut)]))[0]


@pytest.fixture(scope="module")
def twins():
    a, b = ("".join(thue_morse(2048, *p)) for p in ("ab", "ba"))
    tail = " one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, a), (2, b), (3, a + tail), (4, b + tail), (5, a[:1024]), (6, b[:1024]), (7, b + tail), (8, a + tail + "\n" + b + tail)]
    return [(d, t) for d, t in rows]


def test_hash_twins_stay_apart(frame, twins):
    docs = frame(twins)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, window=13).collect()}
    assert got == brute.substring(twins, 13)
    comp = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=4, percent=80).collect()}
    assert comp[1] != comp[2] and comp[4] == comp[7] and comp[5] != comp[6]
    cut = {r.doc_id: r.n_removed for r in line_dedup(docs).collect()}
    assert cut[2] == cut[6] == 0 and cut[7] == 1
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup(docs, window=100).collect()}
    assert got == {d: v[:2] for d, v in brute.suffix(twins, 100).items()}


def test_control_strings_cut_into_parts(spark):
    text = "a<|im_end|>\n<|im_start|>assistant\nok\\<|image|>|"
    rows = [(i, 0, "user", [("text", text[:i], None, None), ("text", "", None, None), ("text", text[i:], None, None)]) for i in range(len(text) + 1)]
    rows += [(1000, 0, "user", [("text", c, None, None) for c in text]), (1001, 0, "assistant", [("text", "<", None, None), ("image", None, "r", 1), ("text", "|>", None, None)])]
    chats = format_chat(spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{PART}>"))
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in read_back(chats).collect()}
    assert got.pop(1001) == [("assistant", "<<|image|>|>")]
    assert set(map(tuple, got.values())) == {(("user", text),)}
    assert {r.conv_id: r.masked for r in read_back(chats).collect()}[1001] == ["<<|image|>|>"]


def test_a_table_of_numbers_is_no_leak(frame, spark):
    item = "Sum 3 14 15 92 65 35 89 79 32 38 46 26 43 now"
    table = " ".join(str(100 + 7 * k) for k in range(400))
    docs = frame([(1, table), (2, "x " + item), (3, "3 14 15 92 65 35 89 79 32 38 46 26 43"), (4, " ".join(["Ann"] * 60))])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in leaked_items(docs, benchmark).collect()} == {2, 3}


def test_rows_of_one_id_are_learnt_from_once(frame, spark, monkeypatch):
    docs = frame([(1, f"text {k}") for k in range(500)] + [(2, "other words"), (3, "more")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(quality_gam, "fit", lambda x, y: sizes.append(len(y)))
    quality_gam.fit_quality(docs, labels, max_rows=2)
    quality_gam.fit_quality(docs, labels)
    assert sizes == [2, 3]


def test_documents_of_many_lines(spark):
    def body(tag, n):
        return "\n".join(f"line {k} of the long text {tag if k % 2 else 'x'} ends here" for k in range(n))
    n = 40_000
    docs = spark.createDataFrame([(1, body("a", n)), (2, body("b", n))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup(docs).collect()}
    assert got[1][0] == got[2][0] == n and got[2][1] == n
    assert time.time() - began < 120


def test_columns_named_like_the_pipelines_own(spark, tmp_path):
    import corpus_pipeline as P
    docs = spark.createDataFrame([(1, "some words of text", "en", "s", 5, "mine", "k", "t", 7), (1, "other words", "en", "s", 5, "mine", "k", "t", 7)],
                                 "doc_id long, text string, lang string, source string, n_chars long, __id string, __key string, __text string, __lo int")
    spark.createDataFrame([(1, "nothing of this stands anywhere in those documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (P.exact, P.near, P.decontaminated):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
