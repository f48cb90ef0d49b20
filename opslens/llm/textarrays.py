"""Array helpers for the Arrow-batched operators: texts as one byte array,
words as spans, and hashes of any span in constant time.

Everything works on *blocks*: consecutive documents of a batch, cut so that a
block holds about ``BLOCK_BYTES`` of text (a longer document forms a block of
its own). Memory per task is therefore bounded by the block size or the
longest single document, never by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U = np.uint64
# Odd multipliers (random, fixed) and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (bijective)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64, kept per worker and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, _U)
        filled = 1
        while filled < size:
            step = _U(pow(base, filled, 1 << 64))
            have[filled:2 * filled] = have[:filled] * step
            filled *= 2
        _POWERS[base] = have
    return have[:n]


_FIRST = _U(0xA0761D6478BD642F)
_TAIL = _U(0xE7037ED1A0B428DB)
_LENGTH = _U(0xD6E8FEB86659FD93)
_MIXED = _U(0xBF58476D1CE4E5B9)


def _pair(left: np.ndarray, right: np.ndarray, which: int) -> np.ndarray:
    x = left * _FIRST
    x += right * _U(_BASES[which])
    x ^= x >> _U(29)
    x *= _MIXED
    return x


_BYTE_PAIRS: dict[int, np.ndarray] = {}


def _byte_pairs(which: int) -> np.ndarray:
    """``_pair`` of every two bytes, kept per worker."""
    if which not in _BYTE_PAIRS:
        both = np.arange(1 << 16).astype(_U)
        _BYTE_PAIRS[which] = _pair(both >> _U(8), both & _U(255), which)
    return _BYTE_PAIRS[which]


class SpanHasher:
    """Hash of any span [start, end) of ``symbols`` by prefix sums of a
    polynomial modulo 2**64; equal spans hash alike wherever they stand.

    The polynomial's coefficients are not the symbols but mixed pairs of
    neighbours (and the last symbol by itself, for spans of one): with plain
    symbols, strings and their complements in the Thue-Morse order collide in
    every base."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols)
        self._symbols, self._which = symbols, which
        self._power = _powers(_BASES[which], n + 1)
        self._inverse = _powers(_INVERSES[which], n + 1)
        self._prefix = np.zeros(n + 1, _U)
        if n > 1:
            if symbols.dtype == np.uint8:
                pairs = _byte_pairs(which)[symbols[:-1].astype(np.uint16) << 8 | symbols[1:]]
            else:
                pairs = _pair(symbols[:-1].astype(_U), symbols[1:].astype(_U), which)
            pairs *= self._power[1:n]
            np.cumsum(pairs, out=self._prefix[1:n])
            self._prefix[n] = self._prefix[n - 1]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, _U)
        last = end - 1
        empty = last < start
        some_empty = empty.any()
        if some_empty:
            last = np.maximum(last, start)
        raw = self._prefix[last]
        raw -= self._prefix[start]
        raw *= self._inverse[start]
        if len(self._symbols):
            tail = self._symbols[np.minimum(last, len(self._symbols) - 1) if some_empty else last].astype(_U)
            tail *= _TAIL
            raw += np.where(empty, _U(0), tail) if some_empty else tail
        raw += (end - start).astype(_U) * _LENGTH
        return mix(raw)

    def joined(self, start: np.ndarray, left: np.ndarray, right: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of [start, left) followed by [right, end), as if contiguous."""
        before, after = left > start, right < end
        raw = (self._prefix[np.maximum(left - 1, start)] - self._prefix[start]) * self._inverse[start] \
            + (self._prefix[np.maximum(end - 1, right)] - self._prefix[right]) * self._inverse[start + right - left]
        if len(self._symbols):
            symbol = lambda at: self._symbols[np.clip(at, 0, len(self._symbols) - 1)].astype(_U)
            raw += np.where(before & after, _pair(symbol(left - 1), symbol(right), self._which) * self._power[left - start], _U(0))
            raw += np.where(before | after, symbol(np.where(after, end, left) - 1) * _TAIL, _U(0))
        length = end - start - (right - left)
        return mix(raw + length.astype(_U) * _LENGTH)


@dataclass
class Block:
    """Consecutive documents: ``data`` is their UTF-8, document i is
    ``data[offsets[i]:offsets[i+1]]``; ``rows`` slices the source batch."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray


def blocks(text: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string (or binary) column into blocks; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null(b"" if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else "")
    if len(text) == 0:
        return
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, off, data = text.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(text))
        yield Block(slice(lo, hi), whole[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block: byte spans, and
    ``first[i]:first[i+1]`` as the words of document i."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(block: Block) -> Words:
    n = len(block.data)
    ink = np.zeros(n + 2, bool)
    ink[1:-1] = ~_SPACE[block.data]
    edge = ink[1:] & ~ink[:-1]      # a word starts at byte i
    stop = ~ink[1:] & ink[:-1]      # a word ends before byte i
    inner = block.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    joined = inner[ink[inner] & ink[inner + 1]]  # two documents' words touch
    edge[joined] = True
    stop[joined] = True
    start = np.flatnonzero(edge[:n + 1])
    end = np.flatnonzero(stop[:n + 1])
    return Words(start, end, np.searchsorted(start, block.offsets))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def owners(first: np.ndarray) -> np.ndarray:
    """Document index of every symbol, from the documents' first positions."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all windows of ``length`` symbols that lie inside
    one document, and the document index of each."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.arange(len(doc)) - np.repeat(before - first[:-1], counts), doc


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (log2(width) passes)."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[:len(values) - width + 1], out[width - span:])
    return out


@dataclass
class Groups:
    """Windows of a block grouped by their anchor. Group g holds the windows
    starting at ``lo[g] .. hi[g]`` (document ``doc[g]``), all of which have
    their smallest seed at ``anchor[g]``."""

    doc: np.ndarray
    anchor: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


_POSITION_BITS = 28


def anchored(first: np.ndarray, seed_hash, window: int, seed: int) -> Groups:
    """Give every window of ``window`` symbols its anchor: the leftmost of
    its seeds (``seed`` symbols) with the smallest hash. The choice depends
    on the window's own symbols alone, so equal windows have equal anchors
    at the same offset, in whatever documents they stand."""
    total = int(first[-1])
    starts, doc = window_starts(first, window)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return Groups(z, z, z, z)
    if total >= 1 << _POSITION_BITS:
        raise ValueError(f"a document of {total} symbols exceeds 2**{_POSITION_BITS}")
    place = np.arange(total - seed + 1)
    key = (seed_hash >> _U(_POSITION_BITS) << _U(_POSITION_BITS)) | place.astype(_U)
    least = sliding_min(key, window - seed + 1)
    anchor = (least[starts] & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    return Groups(doc[at], anchor[at], starts[at], starts[last])


def covered_runs(start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [s, s + length) over sorted starts, as maximal runs."""
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z
    cut = np.flatnonzero(start[1:] > start[:-1] + length)
    lo = np.concatenate([start[:1], start[cut + 1]])
    hi = np.concatenate([start[cut], start[-1:]]) + length
    return lo, hi
