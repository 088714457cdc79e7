"""Words and lines of UTF-8 text as numpy arrays, straight from Arrow buffers.

A word is a maximal run of the bytes ``0-9``, ``a-z`` (after lower-casing A-Z)
and of any byte of a non-ASCII character, i.e. ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
Words and lines are hashed to 64 bits by differences of a running sum, so the
cost is a few array operations for each block of text, however many words it
has.  Every function works on blocks of bounded size; a document
longer than a block makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Places of a span whose values are looked up in a table; values of later ones are computed.
_PLACES = 256


def _place_values(key: np.ndarray, which: int) -> np.ndarray:
    """A scrambled value for each place and byte, ``key`` being 256 times the place plus the byte."""
    return mix(mix((key.astype(np.uint64) + _U(1)) * _BASE) + _U((which + 1) * 0x11B54A32D192ED03))


_TABLES = tuple(_place_values(np.arange(_PLACES * 256), which) for which in (0, 1))
_scratch = np.zeros((1 << 18) + (1 << 16), np.uint64)  # memory of the sums of a usual block, which nothing keeps


class SpanHash:
    """Hashes of spans of ``data`` (uint8) that are in order and do not overlap: sums of a scrambled value for each byte and its place in the span.

    Every place has values of its own, so what repeats within a span does not
    cancel out, and two hashes (``which``) have nothing in common.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        self.data, self.which = data, which

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        # what lies between spans is counted on from the span before, and plays no part
        low, high = int(start[0]), int(end[-1])
        size = np.diff(start, append=high)
        sums = _scratch[: high - low + 1] if high - low < len(_scratch) else np.empty(high - low + 1, np.uint64)
        place = np.arange(low, high)
        place -= np.repeat(start, size)
        far = int(size.max()) > _PLACES
        key = (np.minimum(place, _PLACES - 1) if far else place) << 8
        key |= self.data[low:high]
        sums[0] = 0
        np.take(_TABLES[self.which], key, out=sums[1:], mode="clip")
        if far:
            at = np.flatnonzero(place >= _PLACES)
            sums[at + 1] = _place_values(place[at] * 256 + self.data[at + low], self.which)
        np.cumsum(sums, out=sums)
        return mix(sums[end - low] - sums[start - low] + (end - start).astype(np.uint64) * _BASE)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    raw, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words of a block of texts: ``hash``, ``start``/``end`` bytes, and ``first``,
    where the words of text d are ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = IS_WORD):
        """``kind`` tells which bytes are inside of words."""
        self.data = LOWER[data]
        inside = kind[self.data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.hash = SpanHash(self.data)(self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the word each starts at."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _BASE + words.hash[j : j + n]
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    return mix(total[at] + _U(k)), at
