"""Operator 13 against a plain ranking."""

import math
import random
import re
from collections import Counter

import pytest

from opslens.llm import lexical_search as S

TERM = re.compile(S.TERM)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(UPPER)))


def ranking(docs, items, top):
    """Counter of (item_id, rank, doc_id, score)."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c in held:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in terms(text).items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d, score))
        out.update((item, rank, d, score) for rank, (_, _, d, score) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1))
    return out


def found(spark, docs, items, **how):
    schema = "doc_id long, text string, id string, item string, block int, score string, term string"
    d = spark.createDataFrame([(a, b, "x", "x", 1, "x", "x") for a, b in docs], schema).repartition(3)
    q = spark.createDataFrame([(a, b, "y", "y") for a, b in items], "item_id long, text string, at string, key string")
    return Counter(tuple(r) for r in S.ranked_search(d, q, **how).select("item_id", "rank", "doc_id", "score").collect())


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["w", "W", "é"]) + str(int(rng.paretovariate(0.5)) % 300) + rng.choice(["", ",", "-", "\n"])
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 40, 90])))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(n // 3)]  # copies: equal scores
    return docs, [(i, " ".join(word() for _ in range(rng.choice([1, 4, 25])))) for i in range(12)]


@pytest.mark.parametrize("how", [{"top": 20}, {"top": 3, "block_docs": 8, "bundle_items": 5, "shares": (0.02, 0.1, 0.4)},
                                 {"top": 5, "block_docs": 16, "pairs_per_pass": 30, "shares": ()}])
def test_matches_a_plain_ranking(spark, how):
    docs, items = corpus(len(how), 80)
    assert found(spark, docs, items, **how) == ranking(docs, items, how["top"])


def test_nulls_ties_repeated_rows_and_long_terms(spark):
    long = "x" * 300
    docs = [(None, "alpha beta"), (None, None), (None, "alpha beta"), (4, ""), (4, "ALPHA"), (4, "alpha"), (5, " -- "), (6, f"{long} y"), (7, long + "z")]
    docs += [(8, "beta " * 400_000 + "alpha")]
    items = [(None, "Alpha"), (None, None), (1, "alpha alpha BETA"), (1, "beta"), (2, "absent"), (3, ""), (4, f"{long.upper()} {long}")]
    assert found(spark, docs, items, top=4) == ranking(docs, items, 4)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, "a")]) == Counter()
