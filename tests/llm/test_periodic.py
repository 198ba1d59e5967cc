"""Runs of periodic words against a search of all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import periodic
from siftline.llm.periodic import periodic_runs, run_columns, with_planted_loops

DOCS = "doc_id long, text string, row_id string, period string, runs string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_of(words, least=6, powers=4):
    """(start, period, length) of all runs, one period after the other."""
    found = {}
    for q in range(1, len(words) // powers + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, powers * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, q, n) for (start, n), q in found.items())


def tiled(words):
    """The same by tiles, without Spark."""
    numbers = periodic.numbers_of([w.encode() for w in words], periodic.WordNumbers())
    pieces = {}
    for size, b, periods in periodic.tile_places(numbers, 6, 4):
        start = max(b - 2 * size, 0)
        for q, first, past in periodic.solve_tile(numbers[start : b + 8 * size], b - start, size, periods):
            pieces.setdefault(q, []).append((b + first, b + past))
    found = {}
    for q in sorted(pieces):
        joined = []
        for first, past in sorted(pieces[q]):
            if joined and first <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], past)
            else:
                joined.append([first, past])
        for first, past in joined:
            if past - first + q >= max(6, 4 * q):
                found.setdefault((first, past - first + q), q)
    return sorted((start, q, n) for (start, n), q in found.items())


LOOP = st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 11))
WORDS = st.lists(LOOP, max_size=8).map(lambda loops: [w for unit, times, cut in loops for w in (unit * times)[cut:]])


@settings(max_examples=300, deadline=None)
@given(WORDS)
def test_tiles_find_all_runs(words):
    assert tiled(words) == runs_of(words)


def test_long_periods():
    unit = [f"w{i}" for i in range(700)]
    words = ["x"] * 5 + unit * 5 + unit[:100] + ["y"] * 3 + unit[:3] * 40
    assert tiled(words) == runs_of(words) == [(5, 700, 3600), (3608, 3, 120)]


def rows_of(docs):
    """What ``run_columns`` gives, by the definition."""
    out = []
    for doc_id, text in docs:
        words = words_of(text)
        runs = runs_of(words)
        dropped = {i for start, q, n in runs for i in range(start + q, start + n)}
        best = None
        for start, q, n in runs:
            if best is None or n * best[1] > best[2] * q:
                best = (start, q, n)
        lines = "".join(f"{start},{n},{q}\n" for start, q, n in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        first = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        out.append((doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(spark):
    loop = "a b c " * 9
    texts = [None, "", " \n ", "one", loop, loop, f"x {loop} y\tz {'k ' * 7}", "a a a a a", "é　é " * 8, "b " * 20_000, "p q " * 4 + "r s " * 4]
    docs = [(i, t, "clash", None, "clash") for i, t in enumerate(texts)] + [(None, loop, None, None, None), (4, loop, None, None, None)]
    df = spark.createDataFrame(docs, DOCS)
    got = sorted((tuple(r) for r in run_columns(periodic_runs(df)).collect()), key=str)
    assert got == rows_of([d[:2] for d in docs])
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, least_powers=3)


def test_one_text_in_many_tiles(spark):
    unit = [f"w{i}" for i in range(3000)]
    words = unit[:1000] + unit * 6 + ["z"] * 10_000 + unit
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = periodic_runs(df).first()
    # the head repeats the first words of the loop only, so it is no part of the run
    assert [(r.start, r.period, r.length) for r in row.runs] == [(1000, 3000, 18_000), (19_000, 1, 10_000)]


def test_planted_loops(spark):
    text = " ".join(f"w{i % 97}" for i in range(400))
    docs = [(i, text) for i in range(60)] + [(None, text), (61, None), (62, "")]
    for doc_id in range(60):  # the tail starts at a and has period p
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            words, g = words_of(text), h // 10
            a = g % 400
            p = 1 + (400 - a) // (3 + g % 8)
            docs[doc_id] = (doc_id, " ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, 400)]))
    df = spark.createDataFrame([(i, text if i is not None and i < 60 else t) for i, t in docs], "doc_id long, text string")
    got = {r.doc_id: r.text for r in with_planted_loops(df).collect()}
    assert got == dict(docs)
    assert any(t != text for i, t in docs[:60])
