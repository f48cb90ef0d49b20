"""Operator 12 against plain regular expressions and a recursive evaluator."""

import random
import re

import pytest

from opslens.llm import license_scan as L
from opslens.llm.queries import QUERIES

from ..conftest import SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_places(text):
    """(n_words, sorted (word, label)) by comparing words one by one."""
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), sorted((i, label) for phrase, label in L.BASE.items() for i in range(len(w)) if w[i:i + phrase.count(" ") + 1] == phrase.split(" "))


@pytest.fixture(scope="module")
def scanner():
    return L.Scanner(L.BASE, L.NOTICES)


def scan(scanner, text):
    n, places, labels, expressions, score = scanner.scan(text.encode())
    return n, sorted((w, label) for label, w, _ in places), ",".join(sorted(labels)), expressions, score


def test_query_matches_plain_search(spark):
    rows = QUERIES["op12_license_scan"](spark, SF_SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, places = base_places(texts[r.doc_id])
        base = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(base))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        labels = r.labels.split(",") if r.labels else []
        assert set(base) <= set(labels) and labels == sorted(set(labels)) and 0 <= r.score <= 1
        if not re.search("(?i)licen|cc.by|cc0|bsd|unencumbered|public domain|rights reserved|permission|redistribution|creative", texts[r.doc_id] or ""):
            assert r.labels == "" and r.score == 0


@pytest.mark.parametrize("pieces", [1, 50, L.PIECE_BYTES])
def test_random_words_in_pieces(scanner, monkeypatch, pieces):
    monkeypatch.setattr(L, "PIECE_BYTES", pieces)
    rng = random.Random(pieces)
    words = "under the mit license apache version 2 cc by nc é LICENSE Ünder x\x85y Apache".split(" ") + ["License,", "cc-by-nc.", "under\n"]
    for _ in range(60):
        text = rng.choice(["", " ", "--"]) + "".join(rng.choice(words) + rng.choice([" ", "\n", "-", "; ", "\x00"]) for _ in range(rng.randrange(120)))
        assert scan(scanner, text)[:2] == base_places(text)


@pytest.mark.parametrize("text, labels, expressions, score", [
    ("", "", [], 0.0),
    ("Released under the MIT License.", "mit", ["MIT"], 0.1),
    ("Licensed under the Apache License, Version 2.0.", "apache-2", [], 0.1),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", [], 0.6),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", [], 0.8),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "apache-2,gpl-2,mit",
     ["( MIT or Apache-2.0 ) and GPL-2.0-only with Classpath-exception-2.0"], 0.4),
    ("SPDX-License-Identifier: MIT OR GPL-3.0-or-later AND CC-BY-NC-4.0\nnext line", "cc-by-nc,gpl-3,mit", ["MIT or GPL-3.0-or-later and CC-BY-NC-4.0"], 0.1),
    ("spdx-license-identifier: LicenseRef-Mine", "licenseref-mine", ["LicenseRef-Mine"], 0.5),
    ("SPDX-License-Identifier: MIT and and", "mit", ["MIT"], 0.1),
    ("SPDX-License-Identifier: ((MIT or", "mit", ["( ( MIT"], 0.1),
    ("SPDX-License-Identifier:", "", [], 0.0),
    ("Distributed under either MIT or Apache-2.0 license, and more", "apache-2,mit", ["MIT or Apache-2.0"], 0.1),
    ("License: GPLv3", "gpl-3", ["GPLv3"], 0.6),
    ("You need a license or a permit. Licensed under my own terms.", "", [], 0.0),
    ("CC BY-NC-SA 4.0, all rights reserved", "all-rights-reserved,cc-by-nc,cc-by-nc-sa", [], 1.0),
])
def test_statements(scanner, text, labels, expressions, score):
    got = scan(scanner, text)
    assert got[2:4] == (labels, expressions) and got[4] == pytest.approx(score)


def test_expressions_match_a_recursive_evaluator():
    rng = random.Random(3)
    ids = ["MIT", "GPL-3.0-only", "CC-BY-NC-4.0", "MPL-2.0", "Foo", "CC0-1.0"]

    def make(depth):  # (tokens, value, precedence)
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(ids)
            value = L.restriction(L.label_of(name))
            return ([name, "with", "Some-exception"], max(0.0, value - L.EXCEPTION_EASES), 3) if rng.random() < 0.3 else ([name], value, 3)
        op, rank, pick = rng.choice([("or", 1, min), ("and", 2, max)])
        sides = [make(depth - 1) for _ in range(2)]
        tokens = [["(", *t, ")"] if r < rank or rng.random() < 0.2 else t for t, _, r in sides]
        return [*tokens[0], op, *tokens[1]], pick(sides[0][1], sides[1][1]), rank

    for _ in range(300):
        tokens, value, _ = make(5)
        assert L.read_expression((": " + " ".join(tokens)).encode(), 1, False)[0] == tokens
        assert L.evaluate(tokens)[1] == pytest.approx(value)


def test_long_expressions_and_texts(scanner):
    many = "SPDX-License-Identifier: " + "(" * 20000 + "MIT" + " OR MIT" * 20000
    assert scan(scanner, many)[2] == "mit"
    text = "word " * 300_000 + "cc by nc"
    assert scan(scanner, text)[:3] == (300_003, [(300_000, "cc-by-nc")], "cc-by-nc")


def test_edges(frame):
    rows = [(None, None), (None, "cc by nc"), (1, ""), (1, " -- "), (2, "cc by nc"), (2, "cc by nc")]
    got = L.license_scan(frame(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, len(r.places), list(r.labels), r.score) for r in got) == [
        (False, 1, 0, 0, [], 0.0), (False, 1, 0, 0, [], 0.0), *[(False, 2, 3, 1, ["cc-by-nc"], 0.8)] * 2,
        (True, 0, 0, 0, [], 0.0), (True, 0, 3, 1, ["cc-by-nc"], 0.8)]
    assert L.license_scan(frame([])).collect() == []
