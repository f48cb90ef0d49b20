"""Brute-force versions of the operators, for small inputs. Rows are
(doc_id, text) with distinct ids."""

from __future__ import annotations

import hashlib
import re

WORD = r"[^\x20\x09-\x0D]+"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def substring(rows, window):
    docs = sorted((d, re.findall(WORD, t or "")) for d, t in rows)
    first = {}
    for d, w in docs:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), d)
    out = {}
    for d, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < d:
                gone[k:k + window] = [True] * window
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def suffix(rows, window):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            x = b[k:k + window]
            if x in seen:
                gone[k:k + window] = b"\1" * window
            seen.add(x)
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(c for c, g in zip(b, gone) if not g))
    return out


def shingles(text, size):
    w = re.findall(WORD, lower(text))
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def components(rows, size, percent):
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    p = next((i for i in range(n) if a[i] != b[i]), n)
    s = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    return p + s >= max(len(a), len(b)) - 1


def lines(rows, min_words):
    occurrences = []
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            w = re.findall(WORD, line)
            if w:
                occurrences.append((d, i, w))
    gone = set()
    for d, i, w in occurrences:
        for e, j, v in occurrences:
            if (e, j) < (d, i) and (v == w or (min(len(v), len(w)) >= min_words and one_edit(v, w))):
                gone.add((d, i))
                break
    out = {}
    for d, t in rows:
        parts = (t or "").split("\n")
        ends = [p + "\n" for p in parts[:-1]] + parts[-1:]
        out[d] = (len(parts) if t else 0, sum((d, i) in gone for i in range(len(ends))),
                  "".join(p for i, p in enumerate(ends) if (d, i) not in gone))
    return out
