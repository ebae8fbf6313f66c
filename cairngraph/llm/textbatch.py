"""Vectorised word and shingle hashing over Arrow string batches.

Words are maximal runs of anything but space and the five ASCII controls
``\\t \\n \\v \\f \\r``.  All of these are single bytes in UTF-8, so a batch is
tokenised by byte comparisons over the Arrow value buffer, without building a
Python object per word.  Hashes are polynomial sums modulo 2**64 read off one
running sum, then mixed; they depend on nothing but the bytes, so any executor
computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, base, U64)]), dtype=U64)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a slice of texts, in order.

    doc: index of the text of each word; start, end: byte offsets in ``data``;
    hash: a 64-bit hash of the word's bytes; first: index of each text's first
    word, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        n_docs = len(offsets) - 1
        if lower:
            data = _LOWER[data]
        self.data, self.n_docs = data, n_docs
        space = _IS_SPACE[data]
        breaks = np.zeros(len(data) + 1, bool)  # a text starts here
        breaks[offsets] = True
        opens, closes = ~space, ~space
        if len(data):
            opens[1:] &= space[:-1] | breaks[1:-1]
            closes[:-1] &= space[1:] | breaks[1:-1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n_docs), self.count)
        total = np.zeros(len(data) + 1, U64)
        if len(data):
            np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=total[1:])
        raw = (total[self.end] - total[self.start]) * powers(inverse(_BASE), len(data) + 1)[self.start]
        self.hash = mix(raw)

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each position on; meaningless where the text ends earlier."""
        n = len(self)
        if n == 0:
            return np.zeros(0, U64)
        hashed = self.hash if not seed else mix(self.hash + U64(seed & _MASK))
        total = np.zeros(n + 1, U64)
        np.cumsum(hashed * powers(_WORD_BASE, n), out=total[1:])
        to = np.minimum(np.arange(n) + k, n)
        return mix((total[to] - total[:n]) * powers(inverse(_WORD_BASE), n) + U64(k))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of every k-word shingle; a text of fewer words counts as one shingle."""
        n = len(self)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        hashes = self.windows(k)
        whole = np.arange(n) + k <= self.first[1:][self.doc]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if not len(short):
            return self.doc[whole], hashes[whole]
        alone = []
        for d in short:
            part = self.hash[self.first[d] : self.first[d + 1]]
            value = (part * powers(_WORD_BASE, len(part))).sum(dtype=U64) + U64(len(part))
            alone.append(value)
        doc = np.concatenate([self.doc[whole], short])
        value = np.concatenate([hashes[whole], mix(np.array(alone, U64))])
        order = np.argsort(doc, kind="stable")
        return doc[order], value[order]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(at[-1] - at[0])
    whole = np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    return whole, at - at[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_slices(texts: pa.Array, lower: bool = False, limit: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for ranges of the texts small enough to keep in memory."""
    data, offsets = buffers(texts)
    for i, j in slices(offsets, limit):
        at = offsets[i : j + 1]
        yield i, j, Words(data[at[0] : at[-1]], at - at[0], lower)
