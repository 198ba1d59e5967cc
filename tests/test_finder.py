"""Batches of texts are searched a few texts at a time."""

import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.functions import finder
from siftline.functions.finder import find_lines, found_in
from siftline.operators.match import regex_rules


class Plain:
    """A function for Arrow batches that runs here instead of in a worker."""

    def __init__(self, run):
        self.run = run

    def asNondeterministic(self):
        return self.run


@pytest.fixture
def here(monkeypatch):
    monkeypatch.setattr(F, "arrow_udf", lambda kind: Plain)


TEXTS = [None, "", "x", "one the two\nthe\n\nno", None, "é then eval(\n" * 40, "plain " * 60, "\n", "EVAL(the", ""] * 3
PATTERNS = [["the", "he"], r"eval\(", r"^x$"]


@pytest.mark.parametrize("every", [0, 2])
@pytest.mark.parametrize("size, rows", [(1, 100), (100, 100), (1 << 20, 4)])
def test_parts_give_what_a_whole_batch_gives(here, monkeypatch, every, size, rows):
    batch = pa.array([*TEXTS, None], pa.string())
    search, test = find_lines(batch, PATTERNS, every), found_in(batch, [PATTERNS[1]])
    monkeypatch.setattr(finder, "PART", size)
    monkeypatch.setattr(finder, "PART_ROWS", rows)
    assert find_lines(batch, PATTERNS, every).equals(search)
    assert found_in(batch, [PATTERNS[1]]).equals(test)


def test_a_batch_without_texts(here):
    assert len(find_lines(pa.array([], pa.string()), PATTERNS)) == 0
    assert len(found_in(pa.array([], pa.string()), [PATTERNS[1]])) == 0


def test_words_found_all_over_a_batch_take_little_memory(here, monkeypatch):
    monkeypatch.setattr(finder, "PART", 1 << 17, raising=False)
    batch = pa.array(["the " * 250 + "\n"] * 1000)  # 1 MB, 750,000 words
    tracemalloc.start()
    try:
        rows = find_lines(batch, [["the", "he", "th"]])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(rows) == 1000
    assert peak < 25 << 20


WORDS = [("the", True, True), ("the", False, True), ("the", True, False), ("the", False, False), ("e t", False, False), ["then", "\n", "e\n"], ("x", True, True)]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("size", [1, 1 << 20])
def test_words_with_boundaries(here, monkeypatch, kind, size):
    monkeypatch.setattr(finder, "PART", size)
    texts = ["the", "then", None, "\nbathe THE", "éthe the", "", "thethe_the the-the\n\nthe_", "x\n", "xx x", None, "e", "thé them\nx", "\n", None]
    forms = [r"\bthe\b", r"the\b", r"\bthe", "the", "e t", "then", r"\bx\b"]
    want = []
    for text in texts:
        lines = [] if text is None else text.split("\n")
        found = [[i for i, form in enumerate(forms) if re.search(f"(?ai){form}", line)] for line in lines]
        want.append([{"line_no": n, "line": line, "found": f} for n, (line, f) in enumerate(zip(lines, found), 1) if f])
    assert find_lines(pa.array(texts, kind), WORDS).to_pylist() == want


def test_words_inside_longer_ones_are_no_candidates(here):
    rules = regex_rules([{"id": w, "type": "regex", "pattern": rf"\b{w}\b"} for w in [*map(str, range(100, 400)), "the"]])
    rows = find_lines(pa.array(["then bathe 1234 2345_ the3\nno"]), [search for _, _, search in rules])
    assert rows.to_pylist() == [[]]
