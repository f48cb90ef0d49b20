"""Operator 12: licence scan by an Aho-Corasick automaton and an expression
parser.

A document is read as words: maximal runs of digits, letters and bytes beyond
ASCII, A-Z in lower case. One automaton, over the words joined by single
blanks, finds three kinds of phrases in one pass:

* base phrases: every place counts;
* notices: phrases that name a licence; of places inside one another only the
  longest counts;
* tags, after which a licence expression stands in the text itself:
  ``SPDX-License-Identifier:`` takes any identifier, the wordings of
  ``OPEN_TAGS`` (a colon must follow those of ``COLON_TAGS``) only known ones.

An expression is read as far as it goes on (operand, operator, operand ...)
and brought to postfix order by a shunting yard: ``with`` binds tighter than
``and``, ``and`` tighter than ``or``; ``+`` belongs to its identifier. Its
value is a restriction from 0 (public domain) to 1 (proprietary): of licences
joined by ``or`` the reader may choose the least restrictive, joined by
``and`` the most restrictive holds, ``with`` an exception takes
``EXCEPTION_EASES`` off. A document's score is the restriction of all that it
says, taken together (the most restrictive); 0 if it says nothing. A phrase
inside an expression keeps its label and has no say of its own.

Edge cases: null text counts as empty; without words there is no place, no
label, score 0; an unfinished expression counts as far as it is complete
(operators without a second operand and open parentheses are dropped); texts
of any length are searched whole, in pieces that overlap by the longest
phrase; rows are judged one by one, so null or equal ids, ties and repeated
rows give one result each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases, their labels; tags; restrictions by the beginning of a label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2": "apache-2",
    "apache license 2 0": "apache-2",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "all rights reserved": "all-rights-reserved",
}
IDENTIFIER_TAG = "spdx license identifier"
OPEN_TAGS = ("licensed under", "released under", "distributed under", "available under")
COLON_TAGS = ("license", "licence", "licenses", "license expression")
RESTRICTIONS = {
    "public-domain": 0.0, "unlicense": 0.0, "cc0": 0.0, "0bsd": 0.0, "mit": 0.1, "isc": 0.1, "zlib": 0.1, "bsd": 0.1, "bsl": 0.1,
    "apache": 0.1, "cc-by": 0.2, "cc-by-sa": 0.5, "cc-by-nd": 0.8, "cc-by-nc": 0.8, "cc-by-nc-sa": 0.8, "cc-by-nc-nd": 0.9,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "gpl": 0.6, "agpl": 0.7, "all-rights-reserved": 1.0,
}
UNKNOWN, EXCEPTION_EASES = 0.5, 0.2
PRECEDENCE = {"with": 3, "and": 2, "or": 1}
FILLERS = {"the", "terms", "of", "either", "a", "license", "licence"}

PIECE_BYTES = 4 << 20
ROWS_OUT = 1024

_KNOWN = re.compile(r"(?:mit|isc|zlib|unlicense|0bsd|cc0(?:-1\.0)?|apache-?2(?:\.0)?|bsd-[234]-clause|(?:bsl|epl)-[12]\.0|mpl-[12]\.[01]"
                    r"|(?:a|l)?gpl-?v?[123](?:\.[01])?(?:-only|-or-later)?|cc-by(?:-nc|-nd|-sa)*(?:-[1-4]\.[05])?)\+?")
_TOKEN = re.compile(rb"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+-]*))")
_COLON = re.compile(rb"[ \t]*[:=]")


def label_of(identifier: str) -> str:
    """An identifier's label: without -only, -or-later, + and a final .0; for
    Creative Commons without the version, for BSD without -clause."""
    name = re.sub(r"(-only|-or-later|-clause|\+)+$", "", identifier.lower().rstrip("."))
    name = re.sub(r"^(cc0|cc-by(?:-[a-z]+)*)-[0-9.]+$", r"\1", name)
    name = re.sub(r"^(apache|(?:a|l)?gpl)-?v?(?=[0-9])", r"\1-", name)
    return re.sub(r"(?<=[0-9])\.0$", "", name)


def restriction(label: str) -> float:
    """By the longest beginning of the label that is listed."""
    while label not in RESTRICTIONS:
        label, dash, _ = label.rpartition("-")
        if not dash:
            return UNKNOWN
    return RESTRICTIONS[label]


def read_expression(text: bytes, at: int, known_only: bool) -> tuple[list[str], int]:
    """Tokens of the licence expression that begins at ``text[at]``, as far
    as it goes on, and where it ends; a last operator without operand is
    dropped."""
    tokens: list[str] = []
    depth, operand, complete = 0, True, 0
    end = at
    while m := _TOKEN.match(text, at):
        token = m[m.lastindex].decode()
        word = token.lower()
        if operand:
            if token == "(" and tokens[-1:] != ["with"]:
                depth += 1
            elif token in "()" or word in PRECEDENCE:
                break
            elif known_only and (word in FILLERS or (word in ("any", "all") and not tokens)):
                at = m.end()
                continue
            else:
                token = token.rstrip(".-") if token[-1] in ".-" else token
                if known_only and tokens[-1:] != ["with"] and not _KNOWN.fullmatch(token.lower()):
                    break
                operand = False
        elif token == ")" and depth:
            depth -= 1
        elif word in PRECEDENCE and not (word == "with" and (tokens[-1] == ")" or tokens[-2:-1] == ["with"])):
            token, operand = word, True
        elif known_only and word in ("license", "licence"):
            at = m.end()
            continue
        else:
            break
        tokens.append(token)
        at = m.end()
        if not operand:
            complete, end = len(tokens), at
    return tokens[:complete], end


def postfix(tokens: list[str]) -> list[str]:
    """Shunting yard. Parentheses that are never closed have no effect."""
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + [t for t in reversed(waiting) if t != "("]


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """Labels of an expression's licences, and its restriction."""
    labels: set[str] = set()
    values: list[tuple[float, str]] = []
    for token in postfix(tokens):
        if token not in PRECEDENCE:
            values.append((restriction(label_of(token)), token))
            continue
        (right, _), (left, name) = values.pop(), values.pop()
        if token == "with":
            values.append((max(0.0, left - EXCEPTION_EASES), name))
        else:
            values.append((min(left, right) if token == "or" else max(left, right), name))
    after_with = False
    for token in tokens:
        if token not in PRECEDENCE and token not in "()" and not after_with:
            labels.add(label_of(token))
        after_with = token == "with"
    return labels, values[0][0]


# A-Z in lower case; word bytes as they are; all others blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Scanner:
    """The automaton over all phrases, and what to do with what it finds."""

    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        import ahocorasick

        kinds: dict[str, list[tuple[str, str]]] = {}
        for phrase, label in base.items():
            kinds.setdefault(phrase, []).append(("base", label))
        for phrase, label in notices.items():
            kinds.setdefault(phrase, []).append(("notice", label))
        for phrase in (IDENTIFIER_TAG, *OPEN_TAGS, *COLON_TAGS):
            kinds.setdefault(phrase, []).append(("tag", phrase))
        self.automaton = ahocorasick.Automaton()
        for phrase, what in kinds.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, what))
        self.automaton.make_automaton()
        self.longest = max(len(p.encode()) for p in kinds) + 2

    def places(self, joined: bytes):
        """(word, words, kind, label) of every phrase in `` w w ... w ``."""
        at, before = 0, 0
        while at < len(joined) - 1:
            cut = joined.find(b" ", at + PIECE_BYTES)
            cut = len(joined) if cut < 0 else cut
            end = joined.find(b" ", cut + self.longest)
            piece = joined[at:len(joined) if end < 0 else end + 1]
            text = piece.decode("utf-8", "replace")
            found = list(self.automaton.iter(text))
            if found:
                blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
                own = piece[:cut - at].count(b" ")  # the words that begin before the cut
                for last, (length, n, what) in found:
                    word = int(np.searchsorted(blanks, last - length + 1))
                    if word < own:
                        for kind, label in what:
                            yield before + word, n, kind, label
            if cut == len(joined):
                return
            before += piece[:cut - at].count(b" ")
            at = cut

    def scan(self, data: bytes):
        """(words, base places, labels, expressions, score) of one text."""
        plain = np.frombuffer(data.translate(WORD_BYTES), np.uint8)
        ink = plain != 32
        if not ink.any():
            return 0, [], set(), [], 0.0
        follows = np.concatenate([[False], ink[:-1]])
        n_words = int(np.count_nonzero(ink & ~follows))
        joined = b" " + plain[ink | follows].tobytes() + (b" " if ink[-1] else b"")
        base, notices, tags = [], [], []
        for word, n, kind, label in self.places(joined):
            if kind == "base":
                base.append((label, word, n))
            elif kind == "notice":
                notices.append((word, -n, label))
            else:
                tags.append((word + n - 1, label))
        said, labels, score = [], set(), 0.0  # said: words inside expressions (from, to)
        expressions = []
        if tags:
            ends = np.flatnonzero(ink & ~np.concatenate([ink[1:], [False]])) + 1
            for word, tag in sorted(tags):
                colon = _COLON.match(data, int(ends[word]))
                if tag in OPEN_TAGS or colon:
                    tokens, end = read_expression(data, colon.end() if colon else int(ends[word]), tag != IDENTIFIER_TAG)
                    if tokens:
                        named, value = evaluate(tokens)
                        labels |= named
                        score = max(score, value)
                        expressions.append(" ".join(tokens))
                        said.append((word + 1, int(np.searchsorted(ends, end, "right"))))
        starts = [lo for lo, _ in said]
        inside = lambda word: (k := bisect_right(starts, word)) and word < said[k - 1][1]
        reached = -1
        places = [(word, -n, label) for label, word, n in base]
        for word, n, label in sorted(notices):
            if word - n > reached:  # not inside a place that begins no later
                reached = word - n
                places.append((word, n, label))
        labels |= {label for _, _, label in places}
        # What stands inside an expression has had its say there.
        score = max([score, *(restriction(label) for word, _, label in places if not inside(word))])
        return n_words, sorted(base, key=lambda p: (p[1], p[2], p[0])), labels, expressions, score


_PLACE = pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64())])
_RESULT = ("id {id}, n_words long, places array<struct<label:string,word:long,words:long>>, labels array<string>, "
           "expressions array<string>, score double")


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, places (of base phrases), labels
    (distinct, sorted), expressions (as read), score."""
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        scanner = Scanner(base, notices)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(lo, ROWS_OUT)
                found = [scanner.scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column("text")]
                places = [[{"label": la, "word": w, "words": n} for la, w, n in f[1]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([f[0] for f in found], pa.int64()), pa.array(places, pa.list_(_PLACE)),
                     pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())),
                     pa.array([f[3] for f in found], pa.list_(pa.string())), pa.array([f[4] for f in found], pa.float64())],
                    names=["id", "n_words", "places", "labels", "expressions", "score"])

    return rows.mapInArrow(run, _RESULT.format(id=kind)).withColumnRenamed("id", id_col)
