"""Counts of a text from one finite-state pass over its UTF-8 bytes.

The transducer has two states, between words and in a word, and a table that gives
for each state and byte what the byte emits: the start or end of a word, a capital,
a code point, a symbol.  The next state follows from the byte alone, so a block of
bytes is run as a few array look-ups; the state at its end goes on into the next
block, and texts longer than a block need no copy of themselves.

Word spans go into a hash table of their text's words.  A slot is found by a hash of
the span, and a span counts as known only if text, length and bytes are those of the
word in the slot, so collisions cost probes but never a wrong count.  Texts that fit
a block share a table, with the text as part of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.shingles import mix

BLOCK = 1 << 20  # bytes run at once; memory, not results
LONG = 1 << 16  # words from which spans are compared one by one
BLANK, WORD = 0, 1
STARTS, CAPITAL, POINT, SYMBOL, ENDS = 1, 2, 4, 8, 16
# Blanks are 20 and 09 to 0D, symbols those of the symbol filter
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#$%&*|"

COUNTED = "words long, distinct_words long, capitals long, points long, symbols long"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """NEXT[byte], and EMITS[state * 256 + byte]."""
    following = np.full(256, WORD, np.uint8)
    following[list(BLANKS)] = BLANK
    emits = np.zeros(512, np.uint8)
    for byte in range(256):
        flags = CAPITAL * (65 <= byte <= 90) | POINT * (byte & 0xC0 != 0x80) | SYMBOL * (byte in SYMBOLS)
        emits[byte] = flags | STARTS * (following[byte] == WORD)
        emits[256 + byte] = flags | ENDS * (following[byte] == BLANK)
    return following, emits


NEXT, EMITS = _tables()
NUMBERS = mix(np.arange(1, 257, dtype=np.uint64))  # what a byte adds to the hash of a span
POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full(BLOCK, _BASE)))
INVERSES = np.multiply.accumulate(np.append(np.uint64(1), np.full(BLOCK, _BACK)))


def raised(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


class WordTable:
    """Distinct (text, word) spans of ``data``, by open addressing with verification."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.entries = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))  # hash, text, start, end
        self.slots = np.full(1 << 10, -1, np.int64)

    def insert(self, hashes: np.ndarray, texts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """True for each span that was not in the table yet."""
        known = len(self.entries[0])
        self.entries = tuple(np.concatenate(x) for x in zip(self.entries, (hashes, texts, starts, ends), strict=True))
        if 2 * len(self.entries[0]) > len(self.slots):
            self.slots = np.full(1 << int(2 * len(self.entries[0])).bit_length(), -1, np.int64)
            self._place(np.arange(known))
        fresh = self._place(np.arange(known, len(self.entries[0])))
        kept = np.concatenate([np.ones(known, bool), fresh])
        moved = np.cumsum(kept) - 1
        held = self.slots >= 0
        self.slots[held] = moved[self.slots[held]]
        self.entries = tuple(x[kept] for x in self.entries)
        return fresh

    def _place(self, waiting: np.ndarray) -> np.ndarray:
        """Claims a slot for each entry that no equal one holds; True where it did."""
        first, mask = waiting[0] if len(waiting) else 0, len(self.slots) - 1
        fresh = np.zeros(len(waiting), bool)
        slots = (self.entries[0][waiting] & np.uint64(mask)).astype(np.int64)
        while len(waiting):
            free = self.slots[slots] < 0
            self.slots[slots[free]] = waiting[free]  # of those that want one slot the last gets it
            holder = self.slots[slots]
            own = holder == waiting
            fresh[waiting[own] - first] = True
            going = ~own
            going[going] = ~self._same(waiting[going], holder[going])
            waiting, slots = waiting[going], (slots[going] + 1) & mask
        return fresh

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two entries are the same word of the same text."""
        hashes, texts, starts, ends = self.entries
        sizes = ends - starts
        out = (hashes[a] == hashes[b]) & (texts[a] == texts[b]) & (sizes[a] == sizes[b])
        for i in np.flatnonzero(out & (sizes[a] >= LONG)):
            x, y = starts[a[i]], starts[b[i]]
            out[i] = np.array_equal(self.data[x : x + sizes[a[i]]], self.data[y : y + sizes[a[i]]])
        at = np.flatnonzero(out & (sizes[a] < LONG))
        upto = np.cumsum(sizes[a[at]])
        for part in np.split(at, np.searchsorted(upto, np.arange(BLOCK, upto[-1] if len(at) else 0, BLOCK))):
            if len(part):
                n = sizes[a[part]]
                begin = np.cumsum(n) - n
                inside = np.arange(n.sum()) - np.repeat(begin, n)
                left = self.data[np.repeat(starts[a[part]], n) + inside]
                right = self.data[np.repeat(starts[b[part]], n) + inside]
                out[part] &= ~np.logical_or.reduceat(left != right, begin)
        return out


def groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts (first, past the last) of at most ``BLOCK`` bytes, or of one text."""
    first = 0
    while first < len(offsets) - 1:
        past = int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1
        past = max(past, first + 1)
        yield first, past
        first = past


def count_group(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Five counts for each text of a group that shares a table, see ``COUNTED``."""
    n = len(offsets) - 1
    counts = np.zeros((5, n), np.int64)
    table = WordTable(data)
    state, open_at, open_sum, total = BLANK, -1, np.uint64(0), np.uint64(0)
    for a in range(int(offsets[0]), int(offsets[-1]), BLOCK):
        b = min(a + BLOCK, int(offsets[-1]))
        octets = data[a:b]
        after = NEXT[octets]
        before = np.append(np.uint8(state), after[:-1])
        fresh = offsets[(offsets >= a) & (offsets < b)] - a
        cut = fresh[before[fresh] == WORD] + a  # words that the end of a text ends
        before[fresh] = BLANK
        emits = EMITS[before.astype(np.uint16) * 256 + octets]

        low, high = np.clip(offsets[:-1], a, b) - a, np.clip(offsets[1:], a, b) - a
        for row, flag in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
            upto = np.append(0, np.cumsum((emits & flag) != 0))
            counts[row] += upto[high] - upto[low]

        # a span's hash is the sum of its bytes' numbers times powers of the base, moved back to its start
        sums = np.append(total, total + np.cumsum(NUMBERS[octets] * (POWERS[: b - a] * raised(_BASE, a)), dtype=np.uint64))
        starts = np.flatnonzero(emits & STARTS) + a
        ends = np.union1d(np.flatnonzero(emits & ENDS) + a, cut)
        if b == offsets[-1] and after[-1] == WORD:
            ends = np.append(ends, b)
        from_sum, back = sums[starts - a], INVERSES[starts - a] * raised(_BACK, a)
        if open_at >= 0:
            starts, from_sum = np.append(open_at, starts), np.append(open_sum, from_sum)
            back = np.append(raised(_BACK, open_at), back)
        state, open_at, total = int(after[-1]), -1, sums[-1]
        if len(starts) > len(ends):  # the last word goes on in the next block
            open_at, open_sum = int(starts[-1]), from_sum[-1]
            starts, from_sum, back = starts[:-1], from_sum[:-1], back[:-1]
        if len(starts):
            texts = np.searchsorted(offsets, starts, "right") - 1
            hashes = mix((sums[ends - a] - from_sum) * back + mix(texts.astype(np.uint64) + np.uint64(1)))
            counts[0] += np.bincount(texts, minlength=n)
            counts[1] += np.bincount(texts[table.insert(hashes, texts, starts, ends)], minlength=n)
    return counts


def count_texts(column: pa.Array) -> np.ndarray:
    """The counts of each text of an Arrow column; nulls count as empty."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    _, places, octets = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(octets, np.uint8) if octets is not None else np.zeros(0, np.uint8)
    counts = np.zeros((5, len(texts)), np.int64)
    for first, past in groups(offsets):
        counts[:, first:past] = count_group(data, offsets[first : past + 1])
    return counts


def with_counts(rows: DataFrame, text_col: str) -> DataFrame:
    """The other columns of ``rows`` with the counts of its texts in place of the text."""
    others = [c for c in rows.columns if c != text_col]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others] + [COUNTED])
    names = [*others, *(part.split()[0] for part in COUNTED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_texts(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *map(pa.array, counts)], names=names)

    return rows.mapInArrow(run, schema)
