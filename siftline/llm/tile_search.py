"""Nearest neighbours by a block matrix join over int8 codes.

Each vector is stored next to its int8 code (one scale per vector) and the norm
of what the code leaves out.  The product of two code matrices gives all
distances between two blocks of codes at once; a true distance differs from it
by no more than the two left-out norms.  For each query the k-th smallest upper
bound is a limit, pairs whose lower bound is beyond it cannot be among the k
nearest, and the surviving pairs are worked out again on the original vectors in
double precision.  The k best of a block come out of a heap, the blocks are
merged by Spark.  No pair is lost, so recall is 1 by construction.

Cases: rows without an id, and null, empty, zero or non-finite vectors take no
part.  Vectors meet only vectors of their own dimension.  Repeated rows are rows
of their own.  Ties go to the smaller id.  Extra columns are not looked at.  An
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.blocks import Block, beside, each_pair, pack, usable_vectors

FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row_id", pa.int64()), ("score", pa.float64())])
PAIRS = 1 << 18  # pairs worked out at once, which bounds memory and not the result


def encode(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix, and for each row: scale, left-out norm, codes."""
    scale = np.abs(matrix).max(axis=1, keepdims=True) / 127
    codes = np.rint(matrix / scale)
    left_out = np.linalg.norm(matrix - codes * scale, axis=1, keepdims=True)
    return matrix, np.hstack([scale, left_out, codes])


def distances(queries: Block, found: Block, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs, squares added in the order of the components."""
    out = np.empty(len(q))
    for start in range(0, len(q), PAIRS):
        at = slice(start, start + PAIRS)
        total = np.zeros(len(q[at]))
        for d in range(queries.vectors.shape[1]):
            apart = queries.vectors[q[at], d] - found.vectors[c[at], d]
            total += apart * apart
        out[at] = np.sqrt(total)
    return out


def search_tile(queries: Block, found: Block, k: int) -> tuple:
    """The k nearest of one block for each query of another."""
    q_scale, q_left, q_codes = queries.extra[:, :1], queries.extra[:, 1:2], queries.extra[:, 2:].astype(np.int8)
    c_scale, c_left, c_codes = found.extra[:, :1], found.extra[:, 1:2], found.extra[:, 2:].astype(np.int8)
    # products of int8 codes are whole numbers, which these floats hold exactly
    kind = np.float32 if q_codes.shape[1] <= 1000 else np.float64
    product = q_codes.astype(kind) @ c_codes.astype(kind).T
    q_norm = (q_scale**2) * (q_codes.astype(np.float64) ** 2).sum(axis=1, keepdims=True)
    c_norm = (c_scale**2) * (c_codes.astype(np.float64) ** 2).sum(axis=1, keepdims=True)
    squares = np.maximum(q_norm + c_norm.T - 2 * q_scale * c_scale.T * product, 0)
    rough = np.sqrt(squares)
    # rounding of the squares, taken to the distance, is no larger than this
    off = q_left + c_left.T + 1e-7 * np.sqrt(q_norm + c_norm.T) + 1e-12
    own = queries.row_ids[:, None] == found.row_ids[None, :]
    upper = np.where(own, np.inf, rough + off)
    limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(upper), np.inf)
    q, c = np.nonzero((rough - off <= limit[:, None]) & ~own)
    exact = distances(queries, found, q, c)
    out: list[list] = [[], [], [], [], []]
    starts = np.searchsorted(q, np.arange(len(upper) + 1))
    for i in range(len(upper)):
        at = slice(starts[i], starts[i + 1])
        best = heapq.nsmallest(k, zip(exact[at].tolist(), found.vec_ids[c[at]].tolist(), found.row_ids[c[at]].tolist(), strict=True))
        out[0] += [int(queries.row_ids[i])] * len(best)
        out[1] += [int(queries.vec_ids[i])] * len(best)
        out[2] += [x[1] for x in best]
        out[3] += [x[2] for x in best]
        out[4] += [x[0] for x in best]
    return tuple(out)


def nearest_by_tiles(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    block_rows: int = 2048,
    query_rows: int = 512,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    lanes: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows to each query row.

    ``is_query`` is a condition on ``vec_id``; ``score`` is the Euclidean
    distance of the original vectors.
    """
    rows = usable_vectors(vectors, id_col, vector_col).where(F.exists("vector", lambda x: x != 0))
    lanes = lanes or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = beside(pack(rows.where(is_query), query_rows, encode), pack(rows, block_rows, encode), lanes)
    found = pairs.mapInArrow(
        each_pair(lambda q, c: search_tile(q, c, k), FOUND),
        "query_row long, query_id long, vec_id long, row_id long, score double",
    )
    best = Window.partitionBy("query_row").orderBy("score", "vec_id", "row_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
