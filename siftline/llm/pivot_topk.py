"""Exact top-k by inner product, with a table of distances to pivots.

Vectors are turned into integers, floor(scale * x).  Every vector's distance to
each pivot is worked out once.  For a query q and a candidate c the largest
|d(q,p) - d(c,p)| over the pivots is a lower bound of d(q,c), and
q.c = (|q|^2 + |c|^2 - d(q,c)^2) / 2 turns it into an upper bound of the score.
Candidates of a block are evaluated in the order of that bound until the next
bound is below the k-th score found, so the result is exact.

Cases: rows without an id, and null, empty or non-finite vectors take no part.
Finite vectors of any size do; where doubles are too short, bounds are taken as
infinite and products are worked out in whole numbers.  A score beyond a long is
the nearest long.  Vectors meet only vectors of their own dimension.  Repeated
rows count as rows of their own.  Ties go to the smaller id.  Extra columns are
not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.blocks import Block, beside, each_pair, pack, usable_vectors

LOWEST, HIGHEST = -(2**63), 2**63 - 1  # of a long
LARGEST = float(np.finfo(np.float64).max)
FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row_id", pa.int64()), ("score", pa.int64())])


def choose_pivots(sample: list[list[float]], pivots: int) -> np.ndarray:
    """Vectors far from each other: each next one is the farthest from those chosen."""
    if not sample:
        return np.zeros((0, 0))
    dims = [len(v) for v in sample]
    dim = max(set(dims), key=dims.count)
    points = np.array([v for v in sample if len(v) == dim])
    chosen = [0]
    nearest = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < pivots and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def search_block(queries: Block, found: Block, k: int) -> tuple:
    """The k best candidates of one block for each query of another."""
    norms, tables = found.extra[:, 0], np.ascontiguousarray(found.extra[:, 1:].T)
    exact = found.vectors
    large = not queries.extra[:, 0].max() * norms.max() < 2.0**105  # sums may pass 2^53
    if large:
        exact = np.array([[int(x) for x in row] for row in found.vectors], dtype=object)
    out: list[list] = [[], [], [], [], []]
    for q in range(len(queries.row_ids)):
        norm = queries.extra[q, 0]
        with np.errstate(over="ignore", invalid="ignore"):
            apart = np.abs(tables - queries.extra[q, 1:, None]).max(axis=0) if len(tables) else np.zeros(len(norms))
        with np.errstate(over="ignore", invalid="ignore"):
            bound = (norm + norms - apart**2) / 2 + 1e-9 * (norm + norms) + 1
        bound = np.where(np.isfinite(bound), bound, np.inf)
        order = np.argsort(-bound, kind="stable")
        order = order[found.row_ids[order] != queries.row_ids[q]]
        vector = queries.vectors[q] if exact is found.vectors else np.array([int(x) for x in queries.vectors[q]], dtype=object)
        at, scores = order[:0], np.zeros(0, np.int64)  # the best so far, with all that tie with the k-th
        done, step, least = 0, 8 * k, None
        while done < len(order) and (least is None or bound[order[done]] >= least):
            part = order[done : done + step]
            found_scores = exact[part] @ vector
            if large:
                found_scores = [min(max(x, LOWEST), HIGHEST) for x in found_scores]
            at, scores = np.append(at, part), np.append(scores, np.array(found_scores).astype(np.int64))
            if len(scores) >= k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                at, scores = at[scores >= least], scores[scores >= least]
            done, step = done + len(part), step * 2
        best = np.lexsort((found.row_ids[at], found.vec_ids[at], -scores))[:k]
        out[0] += [int(queries.row_ids[q])] * len(best)
        out[1] += [int(queries.vec_ids[q])] * len(best)
        out[2] += found.vec_ids[at[best]].tolist()
        out[3] += found.row_ids[at[best]].tolist()
        out[4] += scores[best].tolist()
    return tuple(out)


def _floor(x: Column) -> Column:
    """As a double; from 2^53 on all doubles are whole, and none is infinite here."""
    held = F.least(F.greatest(x, F.lit(-LARGEST)), F.lit(LARGEST))
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(held)


def top_by_inner_product(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    pivots: int = 32,
    pivot_sample: int = 512,
    block_rows: int = 2048,
    query_rows: int = 512,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    lanes: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query row.

    ``is_query`` is a condition on ``vec_id``.  Pivots are picked on the driver
    from ``pivot_sample`` vectors with the smallest hashes; any choice of pivots
    gives the same result.
    """
    rows = usable_vectors(vectors, id_col, vector_col)
    whole = F.transform("vector", lambda x: _floor(x * scale))
    rows = rows.withColumn("vector", whole)
    sample = rows.orderBy(F.xxhash64("vec_id", "row_id"), "row_id").limit(pivot_sample).select("vector").collect()
    points = choose_pivots([list(r.vector) for r in sample], pivots)

    def prepare(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        squares = (matrix**2).sum(axis=1, keepdims=True)
        if points.shape[1] != matrix.shape[1]:
            return matrix, squares
        return matrix, np.hstack([squares, *(np.linalg.norm(matrix - p, axis=1)[:, None] for p in points)])

    lanes = lanes or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = beside(pack(rows.where(is_query), query_rows, prepare), pack(rows, block_rows, prepare), lanes)
    found = pairs.mapInArrow(
        each_pair(lambda q, c: search_block(q, c, k), FOUND),
        "query_row long, query_id long, vec_id long, row_id long, score long",
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
