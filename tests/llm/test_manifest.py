"""Operator 11 against a plain Merkle tree."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opslens.llm.merkle_manifest import fold, leaf_hash, merkle_manifest, siblings_hash

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, id string, grp string, node int, pos int, carry string"
NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in NAMES])


def tree(nodes):
    """(root, path of each node)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // 3 * 3: place // 3 * 3 + 3]
            paths[k].append((run[:place % 3], run[place % 3 + 1:]))
            at[k] = place // 3
        nodes = [sha(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def manifest(rows):
    """Counter of (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    return Counter((row["doc_id"], leaf(row), trees[s][0], root, sha(*[h for a, b in trees[s][1][k] + above[i] for h in a + b]))
                   for i, s in enumerate(order) for k, row in enumerate(groups[s]))


def found(spark, rows, tier):
    docs = spark.createDataFrame([tuple(r.get(c) for c in [x.split()[0] for x in SCHEMA.split(", ")]) for r in rows], SCHEMA)
    out = merkle_manifest(docs, tier=tier, carry={"again": leaf_hash(*[F.col(c) for c in NAMES])})
    got = out.select("doc_id", "leaf", "subroot", "root", siblings_hash(F.col("path")).alias("proof"), fold(F.col("again"), F.col("path")).alias("folded"),
                     fold(F.lit("0" * 64), F.col("path")).alias("other")).collect()
    assert all(r["folded"] == r["root"] and r["other"] != r["root"] for r in got)
    return Counter(tuple(r)[:5] for r in got)


def row(doc_id, source, text="t", **more):
    return {"doc_id": doc_id, "source": source, "lang": "en", "n_chars": 1, "text": text, "id": "x", "grp": "y", "node": 7, "pos": 9, "carry": "z"} | more


@pytest.mark.parametrize("tier", [1, 2, 7])
def test_matches_a_plain_tree(spark, tier):
    rows = [row(i, "hot", f"text {i}") for i in range(40)] + [row(i, f"s{i % 5}", "ä\n" * (i % 3)) for i in range(40, 61)]
    rows += [row(100, None), row(101, "one"), row(102, ""), row(103, "Ä"), row(104, "\U0001F600"), row(105, "�")]
    assert found(spark, rows, tier) == manifest(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [row(None, "a", None)] * 3 + [row(None, "a", "x"), row(5, "a", None, lang=None, n_chars=None), row(5, "a", ""), row(5, "a", "")]
    rows += [row(None, None, None, lang=None, n_chars=None)] * 2
    assert found(spark, rows, 1) == manifest(rows)


def test_one_row_is_its_own_root(spark):
    only = row(1, "a", "x" * 200_000)
    assert found(spark, [only], 2) == Counter([(1, leaf(only), leaf(only), leaf(only), sha())])


def test_empty_table(spark):
    assert found(spark, [], 2) == Counter()
