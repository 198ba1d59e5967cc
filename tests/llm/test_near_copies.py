"""Near-duplicate classes against brute force over all pairs."""

import random

import numpy as np
import pytest

from siftline.llm.components import components
from siftline.llm.minhash import links_of, near_duplicates
from siftline.llm.shingles import OnePermutation, WordHashes, shingles

SCHEMA = "doc_id long, text string, component_id string, kept string, hub int, cluster int"


def word_sets(rows, size):
    out = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        out.append(runs)
    return out


def brute(rows, size, percent):
    """Per row: set size, smallest id reachable, kept."""
    sets = word_sets(rows, size)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[find(i)] = min(lowest.get(find(i), doc_id), doc_id)
    return [(d, len(s), lowest.get(find(i)), d == lowest.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def made_rows():
    dice = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    bases = [[dice.choice(words) for _ in range(n)] for n in (30, 60, 120, 400)]
    for base in bases:
        for changes in list(range(0, 14)) * 3:  # a family from near to far copies, unlike each other
            copy = list(base)
            for _ in range(changes):
                copy[dice.randrange(len(copy))] = dice.choice(words)
            rows.append(" ".join(copy))
    rows += [" ".join(dice.choice(words) for _ in range(40)) for _ in range(60)]
    rows += [rows[0]] * 70 + [rows[5].upper()] * 5  # copies, also in capitals
    rows += [None, "", "  \t\n", "one", "ONE", "two words", "two  words", "é É", "É é", "a b c", "a b c d " * 3000]
    numbered = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    dice.shuffle(numbered)
    return numbered + [numbered[0], numbered[1], (numbered[2][0], "another text of that id"), (None, "no id here"), (None, numbered[3][1])]


def test_agrees_with_all_pairs(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    key = str
    for size, percent in ((3, 85), (5, 80)):
        got = near_duplicates(docs, percent=percent, shingle_words=size)
        got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()]
        assert sorted(got, key=key) == sorted(brute(rows, size, percent), key=key)


def test_blocks_of_large_clusters(spark, monkeypatch):
    from siftline.llm import minhash

    rows = made_rows()
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, shingle_words=3)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 3, 85), key=str)


def test_thresholds_that_would_lose_links_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for percent in (79, 50, 0, 101):
        with pytest.raises(ValueError, match="80 to 100"):
            near_duplicates(docs, percent=percent)


def test_empty_and_lone(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    alone = near_duplicates(spark.createDataFrame([(None, None), (3, "a b")], schema)).collect()
    assert {(r.doc_id, r.component_id, r.n_shingles, r.kept) for r in alone} == {(None, None, 0, True), (3, 3, 1, True)}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (2, 1)], "x long, y long")
    got = {r.node: r.root for r in components(edges, "x", "y").collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 160), 100)}
    assert components(edges.limit(0), "x", "y").count() == 0


def test_components_of_a_long_path(spark, monkeypatch):
    from siftline.llm import components as module

    kept = []
    keep = module.keep
    monkeypatch.setattr(module, "keep", lambda df: kept.append(df) or keep(df))
    edges = spark.range(20_000).selectExpr("id as x", "id + 1 as y").union(spark.range(30_000, 30_400).selectExpr("id as x", "30400L as y"))
    got = components(edges, "x", "y").groupBy("root").count().collect()
    assert {(r.root, r["count"]) for r in got} == {(0, 20_001), (30_000, 401)}
    assert len(kept) <= 30  # two a round


def test_signatures_estimate_similarity():
    cut, random_ = OnePermutation(128, 4), np.random.default_rng(2)
    for n, shared in ((2000, 1700), (40, 35), (8, 7)):
        agree = []
        for _ in range(60):
            values = random_.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(values[:n]), np.sort(values[n - shared :])
            agree.append((cut.values(a) == cut.values(b)).mean())
        assert abs(np.mean(agree) - shared / (2 * n - shared)) < 0.05


def test_links_are_a_spanning_forest():
    sets = [np.arange(0, 100), np.arange(0, 99), np.arange(1, 100), np.arange(500, 600)]
    found = links_of([s.astype(np.uint64) for s in sets], [0, 0, 0, 0], 85)
    assert len(found) == 2 and {x for pair in found for x in pair} == {0, 1, 2}
    assert links_of([s.astype(np.uint64) for s in sets[:2]], [0, 1], 85) == [(0, 1)]


def test_shingles_of_short_texts():
    memo = WordHashes()
    assert len(shingles(None, 3, memo)) == len(shingles(b" \n", 3, memo)) == 0
    assert shingles(b"A b", 3, memo).tolist() == shingles(b"a\tB ", 3, memo).tolist() != shingles(b"ab", 3, memo).tolist()
    assert len(shingles(b"a b c d", 3, memo)) == 2
