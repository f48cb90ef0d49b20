"""Operator 3: exact token counts at every prefix.

The vocabulary's pre-tokenizer never joins text across ASCII white space, so
the tokens of a text are those of its words, one after another. Per task,
every distinct word is given to the tokenizer library once; a document's
prefix table is the running sum of its words' counts:

    count(prefix that ends at word k) = count(prefix that ends at word k - 1) + tokens(word k)

The table answers budget and truncation questions without encoding anything
again: the whole text's count is its last entry, the longest prefix within a
budget a binary search (``truncate``). Inside a word the same recurrence runs
over its characters (``word_prefix_counts``).

Special strings inside texts are what the library makes of them by default;
no token is added at either end; nothing is truncated or padded.

Edge cases: null text counts as empty and has 0 tokens; a text of white
space alone too; rows repeat as they come; ids are passed through, null or
not; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import SpanHasher, blocks, lower_ascii, words

SCHEMA = "id string, n_bytes long, n_tokens long, ends array<int>, counts array<long>"
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())


_LETTER = np.zeros(256, bool)  # ASCII letters and digits
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not _LETTER[c] and c not in b"<>"]] = True
_PLAIN = _LETTER.copy()  # ASCII letters: one run of tokens a word is certain
_PLAIN[48:58] = False
MARKS = 4


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]


class WordCounter:
    """Token counts of words, each distinct word encoded once. Words are
    looked up by a 64-bit hash; the table grows with a task's distinct words
    and is emptied when it holds ``LIMIT`` of them."""

    LIMIT = 2_000_000
    PACK = 128

    def __init__(self, tokenizer_path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._known = np.zeros(0, np.uint64)
        self._count = np.zeros(0, np.int64)

    def encode_plain(self, texts: list[str]) -> np.ndarray:
        """Counts of words made of ASCII letters alone: many are encoded as
        one text, whose tokens fall into words at the word-end tokens. Other
        words may have no word end (blanks beyond ASCII) or several, which
        could cancel out in a pack. A pack without one run per word is
        encoded word by word."""
        packs = [texts[a:a + self.PACK] for a in range(0, len(texts), self.PACK)]
        out = []
        for a in range(0, len(packs), 64):
            got = self._tokenizer.encode_batch_fast([" ".join(p) for p in packs[a:a + 64]], add_special_tokens=False)
            for pack, encoding in zip(packs[a:a + 64], got):
                ids = np.array(encoding.ids, np.int64)
                last = np.flatnonzero(self._ends_word[ids])
                whole = len(last) == len(pack) and len(ids) and last[-1] == len(ids) - 1
                out.append(np.diff(last, prepend=-1) if whole else self.encode(pack))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts), np.int64)
        for a in range(0, len(texts), 4096):  # encodings are large objects: a few at a time
            part = self._tokenizer.encode_batch_fast(texts[a:a + 4096], add_special_tokens=False)
            out[a:a + len(part)] = [len(e) for e in part]
        return out

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of every word data[start:end]."""
        distinct, first, back = np.unique(SpanHasher(data)(start, end), return_index=True, return_inverse=True)
        if len(self._known) > self.LIMIT:
            self._known, self._count = self._known[:0], self._count[:0]
        at = np.searchsorted(self._known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self._known)
        new[inside] = self._known[at[inside]] != distinct[inside]
        if new.any():
            fresh = first[new]
            odd = np.concatenate([[0], np.cumsum(~_PLAIN[data])])
            plain = odd[end[fresh]] == odd[start[fresh]]
            got = np.empty(len(fresh), np.int64)
            got[plain] = self.encode_plain(_texts(data, start[fresh[plain]], end[fresh[plain]]))
            got[~plain] = self.encode(_texts(data, start[fresh[~plain]], end[fresh[~plain]]))
            self._known = np.insert(self._known, at[new], distinct[new])
            self._count = np.insert(self._count, at[new], got)
            at = np.searchsorted(self._known, distinct)
        return self._count[at][back]


def cores(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """End of every word without its trailing ASCII marks. Marks after an
    ASCII letter or digit are pre-tokens of their own (a contraction needs
    letters behind its apostrophe), so both parts can be counted alone. Words
    with other endings, or more than ``MARKS`` marks, stay whole."""
    core = end.copy()
    for _ in range(MARKS):
        core -= _MARK[data[core - 1]] & (core - 1 > start)
    return np.where(_LETTER[data[core - 1]], core, end) if len(core) else core


def _prefix_rows(tokenizer_path: str | None, name: str, tables: bool):
    def run(batches):
        path = tokenizer_path
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(name)
        counter = WordCounter(path)
        for batch in batches:
            ids = batch.column("id")
            for block in blocks(batch.column("text")):
                w = words(block)
                # Lower-casing is the tokenizer's own first step, except that special strings count as written.
                data = block.data if b"<|" in block.data.tobytes() else lower_ascii(block.data)
                core = cores(data, w.start, w.end)
                tail = np.flatnonzero(core < w.end)
                per_word = counter.counts(data, w.start, core)
                per_word[tail] += counter.counts(data, core[tail], w.end[tail])
                prefix = np.concatenate([[0], np.cumsum(per_word)])
                before = prefix[w.first[:-1]]
                total = prefix[w.first[1:]] - before
                n = len(total)
                if tables:
                    owner = np.repeat(np.arange(n), np.diff(w.first))
                    first = pa.array(w.first.astype(np.int32))
                    ends = pa.ListArray.from_arrays(first, pa.array((w.end - block.offsets[owner]).astype(np.int32))).cast(_INTS)
                    counts = pa.ListArray.from_arrays(first, pa.array(prefix[1:] - before[owner])).cast(_LONGS)
                else:
                    ends, counts = pa.nulls(n, _INTS), pa.nulls(n, _LONGS)
                yield pa.RecordBatch.from_arrays([ids[block.rows], pa.array(np.diff(block.offsets)), pa.array(total), ends, counts],
                                                 names=["id", "n_bytes", "n_tokens", "ends", "counts"])

    return run


def prefix_token_counts(docs: DataFrame, tokenizer_path: str | None = None, tokenizer: str = "word_bpe_49k.json",
                        id_col: str = "doc_id", text_col: str = "text", tables: bool = True) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, and the prefix
    table: ``ends`` (byte offset after each word) and ``counts`` (tokens up
    to there). ``tables=False`` leaves the two lists null where only the
    answers are wanted. ``tokenizer_path`` names the vocabulary file; by
    default the installed public file ``tokenizer``. It must drop white
    space and keep words apart, as word_bpe_49k.json does."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_prefix_rows(tokenizer_path, tokenizer, tables), SCHEMA)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def truncate(tables: DataFrame, budget: int) -> DataFrame:
    """Adds ``cut_bytes`` and ``cut_tokens``: the longest prefix ending at a
    word with at most ``budget`` tokens, read off the prefix tables."""
    fits = F.size(F.filter("counts", lambda c: c <= budget))
    return tables.withColumn("cut_bytes", F.when(fits > 0, F.element_at("ends", fits)).otherwise(F.lit(0))) \
        .withColumn("cut_tokens", F.when(fits > 0, F.element_at("counts", fits)).otherwise(F.lit(0)).cast("long"))


def word_prefix_counts(counter: WordCounter, word: str) -> np.ndarray:
    """Tokens of every character prefix of one word (entry k: first k)."""
    return np.concatenate([[0], counter.encode([word[:k] for k in range(1, len(word) + 1)])])
