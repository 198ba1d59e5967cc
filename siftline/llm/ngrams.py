"""Hashed word n-grams and skip-grams of UTF-8 texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftline.llm.shingles import WordHashes, mix

# letters, digits and all bytes beyond ASCII are part of words
_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def lowered(texts: pa.Array) -> pa.Array:
    """Texts in lower case as binary; null stays null."""
    return pc.utf8_lower(texts).cast(pa.binary())


def grams(text: bytes | None, bits: int, memo: WordHashes) -> np.ndarray:
    """Distinct numbers below 2^bits of the words, word pairs and pairs with one word between."""
    words = text.translate(_BREAKS).split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    parts = [mix(one)]
    for gap, seed in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        parts.append(mix(one[:-gap] * np.uint64(seed) + one[gap:]))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
