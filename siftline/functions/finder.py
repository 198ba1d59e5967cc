"""Finding the few lines of a text that need a closer look."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.patterns import re2_groups


PART = 4 << 20  # bytes of texts that are searched at a time
PART_ROWS = 2_000  # texts at a time, where they are short


def parts_of(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in parts of at most ``PART`` bytes, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        stop = min(max(int(np.searchsorted(ends, done + PART, side="right")), start + 1), start + PART_ROWS, len(texts))
        yield texts.take(pa.array(np.arange(start, stop)))  # a copy: if_else of Arrow 23 misreads slices
        start, done = stop, int(ends[stop - 1])


def by_parts(search: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """``search`` on a few texts at a time: what it needs is a multiple of its texts, and a batch may hold 64 MB."""

    def run(texts: pa.Array) -> pa.Array:
        found = [search(part) for part in parts_of(texts)] or [search(texts)]
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(found)

    return run


Word = tuple[str, bool, bool]  # lower-case ASCII; must its start, its end be a boundary?  If so it is of word characters
# bytes in lower case, those of no word character as spaces
_SPACED = bytes(c if c < 128 and (chr(c).isalnum() or c == 95) else 32 for c in bytes(range(256)).lower())


class WordIndex:
    """Automata over lower-case ASCII words, each with the numbers of the patterns that need it.

    One walks the text as it is, for words anywhere.  The other finds words with boundaries:
    it walks the text with spaces for all but word characters, and has the words with a
    space at these ends, so that words inside longer ones are no hits.

    Built once per task, from the lists that travel with the query.
    """

    def __init__(self, words_of: dict[int, list[Word]]):
        self.numbers: dict[Word, list[int]] = {}
        for number, words in words_of.items():
            for word in words:
                self.numbers.setdefault(word, []).append(number)
        self.sizes = np.fromiter(map(len, self.numbers.values()), np.int64, len(self.numbers))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.flat = np.fromiter((n for ns in self.numbers.values() for n in ns), np.int64, int(self.sizes.sum()))
        self.after = np.array([after for _, _, after in self.numbers], np.int64)
        self.automata = None

    def __bool__(self) -> bool:
        return bool(self.numbers)

    def _build(self) -> dict:
        import ahocorasick  # needed for packs of many rules only

        automata = {}
        for place, (word, before, after) in enumerate(self.numbers):
            automaton = automata.setdefault(before or after, ahocorasick.Automaton())
            automaton.add_word(" " * before + word + " " * after, place)
        for automaton in automata.values():
            automaton.make_automaton()
        return automata

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the last byte, word) of all words in the texts, overlapping ones too."""
        self.automata = self.automata or self._build()
        whole = b"\n".join(t or b"" for t in texts.cast(pa.binary()).to_pylist())
        found = [np.zeros((0, 2), np.int64)]
        for spaced, automaton in self.automata.items():
            walked = b" " + whole.translate(_SPACED) + b" " if spaced else whole.lower()
            # bytes as characters: words are ASCII, whose bytes no other character has in UTF-8
            hits = automaton.iter(walked.decode("latin-1"))
            # numbers at once, as a list of pairs takes twelve times their space
            found.append(np.fromiter(chain.from_iterable(hits), np.int64).reshape(-1, 2))
            if spaced:
                found[-1][:, 0] -= 1 + self.after[found[-1][:, 1]]
        last, word = np.concatenate(found).T
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + 1)
        text_no = np.searchsorted(ends, last, side="right")
        return text_no, last - np.concatenate([[0], ends])[text_no], word

    def patterns(self, lines: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, number) of the patterns that need the words found on the lines."""
        lines, words = np.divmod(np.unique(lines * len(self.sizes) + words), len(self.sizes))
        sizes = self.sizes[words]
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(lines, sizes), self.flat[np.repeat(self.starts[words], sizes) + inside]


def _any(texts: pa.Array, regexes: list[str]) -> pa.Array:
    """Is one of the RE2 patterns found?  Null for a null text."""
    found = pc.match_substring_regex(texts, regexes[0], ignore_case=True)
    for regex in regexes[1:]:
        found = pc.or_(found, pc.match_substring_regex(texts, regex, ignore_case=True))
    return found


def found_in(text: Column, patterns: list[str]) -> Column:
    """True where one of the RE2 patterns is found, ignoring case."""
    groups = re2_groups(patterns)

    search = by_parts(lambda texts: _any(texts, groups))

    @F.arrow_udf("boolean")
    def find(texts: pa.Array) -> pa.Array:
        return search(texts)

    return find.asNondeterministic()(text)  # see find_lines


def _words(pattern: list[str] | Word) -> list[Word]:
    """Words of a pattern that a line may hold."""
    return [pattern] if isinstance(pattern, tuple) else [(word, False, False) for word in pattern if "\n" not in word]


def find_lines(content: Column, patterns: list[str | list[str] | Word], every: int = 0) -> Column:
    """Lines of a text on which one of the RE2 patterns is found, ignoring case.

    A pattern given as a list of lower-case ASCII words is found where one of the
    words is, one given as a :data:`Word` where the word is with such ends.  All of them
    are looked up by automata in one or two walks over the text, so the time does not grow
    with the number of patterns.

    Gives ``array<struct<line_no, line, found>>`` in line order, where ``found``
    lists the places of the patterns in the list.  With ``every`` each
    ``every``-th line comes too, starting with the first.  Whole Arrow batches are
    searched by native code: one pass for each group of patterns that RE2 takes
    together, then each pattern on the lines that are left.  An empty pattern is
    found on every line.
    """
    searched = {i: p for i, p in enumerate(patterns) if isinstance(p, str)}
    index = WordIndex({i: _words(p) for i, p in enumerate(patterns) if not isinstance(p, str)})
    groups = re2_groups(list(searched.values()))
    whole = [f"(?m)(?:{g})" for g in groups]

    def _search(texts: pa.Array) -> pa.Array:
        text_no, place, word = index.search(texts) if index else (np.zeros(0, np.int64),) * 3
        if not every:  # a text without a match on any line need not be split
            worth = np.zeros(len(texts), bool)
            worth[text_no] = True
            worth = pa.array(worth)
            texts = pc.if_else(pc.or_(_any(texts, whole), worth) if whole else worth, texts, None)
        lines = pc.split_pattern(texts, "\n")
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lines), 0).to_numpy())])
        flat = lines.flatten()
        hits = np.zeros(len(flat), bool)
        if groups:
            hits = pc.fill_null(_any(flat, groups), False).to_numpy(zero_copy_only=False)
        line_of_word = _line_of(flat, bounds, text_no, place)
        text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        line_no = np.arange(len(flat)) - bounds[text_of] + 1
        chosen = hits.copy()
        chosen[line_of_word] = True
        if every:
            chosen |= (line_no - 1) % every == 0
        at = np.flatnonzero(chosen)
        kept = flat.take(pa.array(at))
        found = _found(kept, np.searchsorted(at, line_of_word), word)
        rows = pa.StructArray.from_arrays([pa.array(line_no[at], pa.int32()), kept, found], names=["line_no", "line", "found"])
        return _lists(np.bincount(text_of[at], minlength=len(texts)), rows)

    def _line_of(flat: pa.Array, bounds: np.ndarray, text_no: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The place in ``flat`` of the line that holds a byte of a text."""
        if not len(place):
            return np.zeros(0, np.int64)
        ends = np.cumsum(pc.binary_length(flat).to_numpy().astype(np.int64) + 1)
        first = np.concatenate([[0], ends])[bounds[text_no]]
        return np.searchsorted(ends, first + place, side="right")

    def _found(kept: pa.Array, word_line: np.ndarray, word: np.ndarray) -> pa.Array:
        """For each line the numbers of the patterns found on it."""
        lines, numbers = [], []
        for number, pattern in searched.items():
            on = np.flatnonzero(pc.match_substring_regex(kept, pattern, ignore_case=True).to_numpy(zero_copy_only=False))
            lines.append(on)
            numbers.append(np.full(len(on), number))
        if len(word):
            by_word = index.patterns(word_line, word)
            lines.append(by_word[0])
            numbers.append(by_word[1])
        line = np.concatenate(lines) if lines else np.zeros(0, np.int64)
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        line, number = np.divmod(np.unique(line * len(patterns) + number), max(len(patterns), 1))
        return _lists(np.bincount(line, minlength=len(kept)), pa.array(number, pa.int32()))

    def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

    @F.arrow_udf("array<struct<line_no:int,line:string,found:array<int>>>")
    def find(texts: pa.Array) -> pa.Array:
        return by_parts(_search)(texts)

    # not deterministic to the optimizer, which would otherwise search twice:
    # once for a filter on the lines found and once for the lines
    return find.asNondeterministic()(content)
