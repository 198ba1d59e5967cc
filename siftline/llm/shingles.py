"""Word shingles of UTF-8 texts as sorted 64-bit hashes, and their signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORDS_KEPT = 100_000  # a memo's size; it changes speed, not results
ROWS = 256  # rows of an Arrow column that are Python objects at a time


def values_of(column: pa.Array, change: Callable[[pa.Array], pa.Array] = lambda part: part) -> Iterator:
    """Values of a column as Python objects, a few at a time, so that a large batch is not copied whole."""
    for start in range(0, len(column), ROWS):
        yield from change(column.slice(start, ROWS)).to_pylist()
    pa.default_memory_pool().release_unused()


def texts_of(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a column of texts."""
    return values_of(column, lambda part: part.cast(pa.binary()))


class WordHashes(dict):
    """Hashes of words, worked out once per worker and word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space (20 and 09 to 0D)."""
    return text.lower().split()


def shingles(text: bytes | None, size: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words.

    A text of fewer words has its whole sequence as one; null, empty and blank
    texts have none.
    """
    words = words_of(text) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    run = min(size, len(ids))
    found = np.full(len(ids) - run + 1, run, np.uint64)
    for j in range(run):
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - run + 1 + j])
    return np.unique(found)


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class OnePermutation:
    """One-permutation signatures with optimal densification, cut into bands.

    The leading bits of a hash name its bin, the smallest hash of a bin is its
    value.  An empty bin takes the value of the first bin that is not empty in an
    order drawn for it, the same for all texts.
    """

    def __init__(self, bins: int, rows: int, seed: int = 7):
        if bins & (bins - 1) or bins % rows:
            raise ValueError("bins must be a power of two and a multiple of rows")
        self.bins, self.rows = bins, rows
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        random = np.random.default_rng(seed)
        self.orders = np.stack([random.permutation(bins) for _ in range(bins)])

    def values(self, hashes: np.ndarray) -> np.ndarray:
        bins = (hashes >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        out, filled = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[bins[first]], filled[bins[first]] = hashes[first], True
        empty = np.flatnonzero(~filled)
        if len(empty):
            orders = self.orders[empty]
            out[empty] = out[orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]]
        return out

    def bands(self, values: np.ndarray) -> np.ndarray:
        keys = np.arange(self.bins // self.rows, dtype=np.uint64)
        for column in values.reshape(-1, self.rows).T:
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
        return keys.view(np.int64)

    @staticmethod
    def short(values: np.ndarray) -> bytes:
        """Two bytes of each value, enough to estimate a similarity."""
        return (mix(values) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()
