"""Words of whole Arrow batches as numpy arrays: one byte buffer, word borders, 64-bit word hashes.

A word is a run of bytes other than U+0020 and U+0009 to U+000D; in UTF-8 these never occur inside another
character, so the byte view equals the character view.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

# Text handled at once inside a task; a longer single text is one slice of its own.
SLICE_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
# Bytes hashed at once; tables of powers are no longer than this unless one word is.
_BLOCK = 1 << 18


def _powers(size: int) -> list[np.ndarray]:
    return [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64), dtype=np.uint64)])
            for x in (_BASE, _BASE_INVERSE)]


_usual_powers = cache(lambda: _powers(_BLOCK))


def _hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word, the same wherever the word stands; bytes are taken block by block."""
    out = np.empty(len(starts), np.uint64)
    power, inverse = _usual_powers()
    a = 0
    while a < len(starts):
        b = max(int(np.searchsorted(ends, starts[a] + _BLOCK, "right")), a + 1)
        low, size = starts[a], int(ends[b - 1] - starts[a])
        if len(power) <= size:
            power, inverse = _powers(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((buf[low: low + size].astype(np.uint64) + np.uint64(1)) * power[:size], out=sums[1:])
        out[a:b] = (sums[ends[a:b] - low] - sums[starts[a:b] - low]) * inverse[starts[a:b] - low]
        a = b
    return mix64(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; null texts are empty."""
    if pa.types.is_large_string(texts.type):
        wide = np.int64
    else:
        wide = np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, wide)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows whose texts hold about `size` bytes together."""
    if not batch.num_rows:
        return
    _, offs = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offs, offs[start] + size, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Borders and hashes of all words of some texts.

    `starts`, `ends` are byte positions in `buf`, `hashes` 64-bit word hashes, and the words of text i are
    those from `first[i]` to `first[i + 1]`.
    """

    def __init__(self, texts: pa.Array, lower: bool = True, blank: np.ndarray = _BLANK):
        raw, self.offsets = text_bytes(texts)
        self.buf = _LOWER[raw] if lower else raw
        inside = ~blank[self.buf]
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        borders = self.offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(raw))]  # texts lie side by side: a border also splits words
        head[borders] = inside[borders]
        tail[borders - 1] = inside[borders - 1]
        self.starts = np.flatnonzero(head)
        self.ends = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = _hash_words(self.buf, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of `width` words, in text order; a shorter text gives its whole sequence as one."""
    n, counts, h = len(words.hashes), words.counts, words.hashes
    doc = words.doc()
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total[: n - k] += h[k:] * _STEPS[k]
    left = words.first[doc + 1] - np.arange(n)  # words from here to the end of the text
    short = (counts[doc] < width) & (left == counts[doc])
    if short.any():
        for i in np.flatnonzero(short):
            total[i] = np.add.reduce(h[i: i + left[i]] * np.array(_STEPS[: left[i]], np.uint64)) + np.uint64(left[i])
    keep = (left >= width) | short
    return doc[keep], mix64(total[keep])


def distinct(doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every text, with the first index of each text (n_docs + 1 entries)."""
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    out = value.copy()
    for a, b in zip(first[:-1], first[1:]):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    total = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out[keep], total[first]
