"""The registered queries: oracles on the small tables, contract digests, the pipeline."""

import hashlib
import re

import pytest

import __spark_entry__ as E
import corpus_pipeline
from opslens.llm.queries import ORACLES, QUERIES
from tools.oracle_check import rows_of

from ..conftest import SF_SMALL
from . import brute


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]


def test_all_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_substring_digest(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, SF_SMALL).collect()}
    assert got == {d: (n, k, brute.sha(t.encode())) for d, (n, k, t) in brute.substring(documents, 13).items()}


def test_suffix_digest(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op5_suffix_dedup"](spark, SF_SMALL).collect()}
    assert got == {d: (n, k, s, brute.sha(b)) for d, (n, k, s, b) in brute.suffix(documents, 100).items()}


def test_near_duplicates(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op2_minhash_dedup"](spark, SF_SMALL).collect()}
    assert got == brute.components(documents, 4, 80)


def test_line_digest(spark, documents):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in QUERIES["op6_line_dedup"](spark, SF_SMALL).collect()}
    assert got == {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in brute.lines(documents, 6).items()}


def test_leaks_hold_whole_items(spark, duck):
    """Every document that holds an item word for word is found, and no document without half of one."""
    tokens = lambda t: re.findall(r"\w+", t.lower())
    items = dict(duck.execute("select item_id, text from benchmark").fetchall())
    docs = dict(duck.execute("select doc_id, text from documents").fetchall())
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_template_decontam"](spark, SF_SMALL).collect()}
    assert {(d, i) for d, t in docs.items() for i, u in items.items() if u in t} <= got
    for d, i in got:
        w, v = tokens(docs[d]), tokens(items[i])
        grams = {tuple(w[k:k + 8]) for k in range(len(w) - 7)}
        assert sum(tuple(v[k:k + 8]) in grams for k in range(len(v) - 7)) * 2 >= min(12, len(v) - 7)


def test_pipeline_stages(spark, duck, documents):
    """Each stage against a brute-force version on its own input."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    labels = dict(duck.execute("select doc_id, quality from labels").fetchall())
    kept = dict(documents)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "exact", "near", "decontaminated", "mixed"]

    def step(name, df):
        out = steps[name](spark, df, SF_SMALL).cache()
        assert name == "mixed" or out.columns == columns
        return out, [r.doc_id for r in out.select("doc_id").collect()]

    docs, ids = step("quality", docs)
    assert sum(labels.get(d) == 1 for d in kept) - sum(labels.get(d) == 1 for d in ids) <= 1
    assert sum(labels.get(d) == 0 for d in ids) <= 1
    kept = {d: kept[d] for d in ids}
    docs, ids = step("exact", docs)
    groups = {}
    for d, t in kept.items():
        groups.setdefault(brute.lower(t), []).append(d)
    assert sorted(ids) == sorted(max(g) for g in groups.values())
    kept = {d: kept[d] for d in ids}
    docs, ids = step("near", docs)
    assert sorted(ids) == sorted(d for d, c in brute.components(list(kept.items()), 5, 80).items() if c[2])
    kept = {d: kept[d] for d in ids}
    docs, ids = step("decontaminated", docs)
    items = [t for _, t in duck.execute("select item_id, text from benchmark").fetchall()]
    leaked = {d for d, t in kept.items() if any(i in t for i in items)}
    assert leaked.isdisjoint(ids) and len(kept) - len(ids) <= len(leaked) + 2
    mixed, ids = step("mixed", docs)
    size = {d: len(re.findall(brute.WORD, kept[d])) for d in ids}
    assert {r.doc_id: r["size"] for r in mixed.collect()} == size
    per_source = mixed.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in per_source)


def test_pipeline_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string"
    text = " ".join(f"word{i} is here" for i in range(40))
    rows = [(None, None, None, None, None, "x", "y"), (1, "", None, None, 0, "x", "y"), (2, text, "en", "s", 5, "x", "y"), (2, text, "en", "s", 5, "x", "y"),
            (3, text.upper(), "en", "t", 5, "x", "y"), (None, text + " more", None, None, 1, "x", "y")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), SF_SMALL).collect() == []
        out = stage(spark, spark.createDataFrame(rows, schema), SF_SMALL).collect()
        assert len(out) <= len(rows)


def test_pipeline_near_judges_each_text_of_an_id(spark):
    """A near copy goes; another text under its id stays."""
    words = [f"word{i}" for i in range(80)]
    copy, other = " ".join([*words[:-1], "else"]), " ".join(f"other{i}" for i in range(80))
    rows = [(1, " ".join(words)), (2, copy), (2, other), (3, other + " more"), (None, copy)]
    out = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_SMALL).collect()
    assert len(out) == 3 and (None, copy) in out
    assert sum(r.text in (rows[0][1], copy) for r in out if r.doc_id) == sum(r.text.startswith("other") for r in out) == 1


def test_pipeline_runs(spark):
    out = E.queries()["pipeline"](spark, SF_SMALL)
    assert out.count() > 50 and out.where("taken > 3 * size or taken <= 0").count() == 0
