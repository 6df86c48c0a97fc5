"""Vectorised word hashing over Arrow string batches.

Words are the runs of bytes other than U+0020 and U+0009..U+000D. All
separators are ASCII, so UTF-8 bytes are split without decoding. A word's hash
is a polynomial over its bytes with a random table, modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_COEF = _rng.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
#: White space and ASCII punctuation: what separates bare words.
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[[i for i in range(128) if not chr(i).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """A slice of a batch: first is the row it starts at, data its bytes, bounds the n+1 offsets into them."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Rows of a string or binary column in slices of about `most` bytes (a longer text is a slice of its own); nulls are empty."""
    if len(column) == 0:
        return
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    _, off, data = wide.buffers()
    bounds = np.frombuffer(off, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(wide)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        j = min(j, n)
        yield Texts(i, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j


@dataclass
class Words:
    """Words of a slice in order: doc (row in the slice), start and end bytes, hash; per row the first word's index (n+1 values)."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(t: Texts, lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    data = _LOWER[t.data] if lower else t.data
    solid = ~space[data]
    n = len(data)
    opens, closes = solid.copy(), solid.copy()
    edge = t.bounds[1:-1]
    if n:
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        inner = edge[(edge > 0) & (edge < n)]
        opens[inner] |= solid[inner]
        closes[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(t.bounds, start, "right") - 1
    if len(start):
        size = end - start
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        terms = _TABLE[data[solid]] * _power_table(int(size.max()))[place]
        hashed = mix(np.add.reduceat(terms, at))
    else:
        hashed = np.zeros(0, np.uint64)
    return Words(doc, start, end, hashed, np.searchsorted(doc, np.arange(len(t) + 1)))


def windows(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of k words within one text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total += w.hash[at + j] * _COEF[j]
    return at, mix(total)


def shingle_sets(t: Texts, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct hashes of its k-word shingles, A-Z lower-cased.

    Fewer words than k: the whole sequence is the one shingle. No words: none.
    """
    w = words(t, lower=True)
    at, hashed = windows(w, k)
    cut = np.searchsorted(at, w.first)
    for i in range(len(t)):
        if cut[i + 1] > cut[i]:
            yield np.unique(hashed[cut[i] : cut[i + 1]])
        elif w.first[i + 1] > w.first[i]:
            own = w.hash[w.first[i] : w.first[i + 1]]
            yield mix((own * _COEF[: len(own)]).sum(keepdims=True, dtype=np.uint64) + _COEF[k:] * np.uint64(len(own)))
        else:
            yield np.zeros(0, np.uint64)
