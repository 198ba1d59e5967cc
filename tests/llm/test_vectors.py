"""Vector searches against brute force, with rows that take no part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm.pivot_topk import choose_pivots, top_by_inner_product
from siftline.llm.tile_search import nearest_by_tiles

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, row_id long, dim string, lane string"


def rows():
    random = np.random.default_rng(5)
    out = [(i, [float(x) for x in random.normal(size=6).astype(np.float32)]) for i in range(400)]
    out += [(i + 400, out[i][1]) for i in range(40)]  # ties
    out += [(7, out[7][1]), (10, out[3][1])]  # repeated ids
    odd = [(900, None), (905, []), (910, [1.0, None] + [0.0] * 4), (915, [math.nan] * 6), (920, [math.inf] + [0.0] * 5), (None, [1.0] * 6)]
    return out + odd + [(1000, [0.0] * 6), (1005, [1.0, 2.0]), (1010, [2.0, 1.0])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", "z") for r in rows()], SCHEMA)


def usable(zero: bool):
    kept = [(i, v) for i, v in rows() if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, v) for i, v in kept if zero or any(v)]


def brute(table, every, k, score, best_first):
    out = []
    for place, (i, v) in enumerate(table):
        if i % every:
            continue
        found = [(best_first * score(v, w), j) for at, (j, w) in enumerate(table) if at != place and len(v) == len(w)]
        out += [(i, rank, j, best_first * s) for rank, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_inner_products(vectors):
    def whole(v, w):
        return sum(math.floor(256.0 * a) * math.floor(256.0 * b) for a, b in zip(v, w, strict=True))

    for pivots in (1, 16):
        got = top_by_inner_product(vectors, F.col("vec_id") % 5 == 0, k=5, block_rows=64, query_rows=16, pivots=pivots, lanes=3)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(usable(zero=True), 5, 5, whole, -1)


def test_inner_products_beyond_doubles(spark):
    table = spark.createDataFrame([(0, [2.0**21, 1.0]), (1, [2.0**21, 2.0]), (2, [2.0**21, 1.0]), (3, [2.0**25, 1.0])], "vec_id long, embedding array<double>")
    got = top_by_inner_product(table, F.col("vec_id") == 0, k=5, lanes=2).collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 2**62 + 2**16), (1, 2**58 + 2 * 2**16), (2, 2**58 + 2**16)]


def test_vectors_of_any_size(spark):
    big = [(0, [1.0, 0.0]), (1, [2.0**30, 1.0]), (2, [-1e300, 0.0]), (3, [1e308, 1e308]), (4, [0.5, 0.25]), (5, [-(2.0**30), 2.0])]
    table = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = top_by_inner_product(table, F.col("vec_id").isin(0, 4), k=5, lanes=2, pivots=4).collect()

    def score(a, b):
        exact = sum(math.floor(256.0 * x) * math.floor(256.0 * y) if 256.0 * y < math.inf else 2**70 for x, y in zip(a, b, strict=True))
        return min(max(exact, -(2**63)), 2**63 - 1)

    for q in (0, 4):
        want = sorted((-score(big[q][1], v), i) for i, v in big if i != q)
        assert [(r.vec_id, r.score) for r in got if r.query_id == q] == [(i, -s) for s, i in want]


def test_nearest(vectors):
    def apart(v, w):
        total = 0.0
        for a, b in zip(v, w, strict=True):
            total += (a - b) * (a - b)
        return math.sqrt(total)

    got = nearest_by_tiles(vectors, F.col("vec_id") % 5 == 0, k=10, block_rows=64, query_rows=16, lanes=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(usable(zero=False), 5, 10, apart, 1)


def test_empty_tables(vectors):
    for search in (top_by_inner_product, nearest_by_tiles):
        assert search(vectors.limit(0), F.lit(True)).count() == 0


def test_pivots_are_apart():
    points = [[0.0, 0.0], [0.1, 0.0], [9.0, 0.0], [0.0, 9.0]]
    assert {tuple(p) for p in choose_pivots(points, 3)} == {(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)}
    assert choose_pivots([], 3).shape == (0, 0)
