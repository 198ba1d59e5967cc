"""Vectors in packed blocks, and query blocks next to candidate blocks.

A block is one row that holds up to ``size`` vectors of one dimension as a
matrix.  Query blocks are copied to every lane, candidate blocks lie in one
lane each, so a plain equi-join on the lane brings every query block to every
candidate block without a pair of single rows ever being a row of Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.plans.materialize import keep

BLOCK = "dim int, row_ids binary, vec_ids binary, vectors binary, extra binary"


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row_id, vec_id, vector double[]) of the rows that take part.

    Rows without an id, and vectors that are null, empty or hold a null or
    non-finite component take no part.  ``row_id`` tells repeated rows apart; the
    rows are kept once so that it stays the same for all later reads.
    """
    vector = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    taking_part = vectors.where(F.col(id_col).isNotNull() & (F.size(vector) > 0) & finite)
    return keep(
        taking_part.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(id_col).cast("long").alias("vec_id"),
            vector.alias("vector"),
        )
    )


def pack(rows: DataFrame, size: int, prepare: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Blocks of up to ``size`` vectors, built inside the partitions (no shuffle).

    ``prepare`` gets the matrix of a block and gives the matrix to store and a
    float64 matrix of what is worked out once per vector.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        for batch in batches:
            lists = batch.column("vector")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            row_ids, vec_ids = batch.column("row_id").to_numpy(), batch.column("vec_id").to_numpy()
            dims = lists.value_lengths().to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                matrix = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                waiting.setdefault(int(dim), []).append((row_ids[at], vec_ids[at], matrix))
                while sum(len(x[0]) for x in waiting[int(dim)]) >= size:
                    ids, names, vectors = (np.concatenate(x) for x in zip(*waiting[int(dim)], strict=True))
                    yield block(int(dim), ids[:size], names[:size], vectors[:size])
                    waiting[int(dim)] = [(ids[size:], names[size:], vectors[size:])]
        for dim, parts in waiting.items():
            ids, names, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(ids):
                yield block(dim, ids, names, vectors)

    def block(dim: int, ids: np.ndarray, names: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        stored, extra = prepare(vectors)
        cells = [[dim], [ids.astype(np.int64).tobytes()], [names.astype(np.int64).tobytes()], [stored.astype(np.float64).tobytes()], [extra.astype(np.float64).tobytes()]]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["dim", "row_ids", "vec_ids", "vectors", "extra"])

    return rows.mapInArrow(blocks, BLOCK)


def beside(queries: DataFrame, candidates: DataFrame, lanes: int) -> DataFrame:
    """Every query block next to every candidate block of its dimension."""
    own = [F.col(c).alias(f"q_{c}") for c in ("row_ids", "vec_ids", "vectors", "extra")]
    spread = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), *own)
    laid = candidates.withColumn("lane", (F.monotonically_increasing_id() + F.xxhash64("row_ids")) % lanes)
    laid = laid.withColumn("lane", F.pmod(F.col("lane"), F.lit(lanes)).cast("int"))
    return laid.join(spread, ["dim", "lane"])


class Block:
    """One side of a pair of blocks, as arrays."""

    def __init__(self, row: dict, prefix: str, dim: int):
        self.row_ids = np.frombuffer(row[f"{prefix}row_ids"], np.int64)
        self.vec_ids = np.frombuffer(row[f"{prefix}vec_ids"], np.int64)
        self.vectors = np.frombuffer(row[f"{prefix}vectors"], np.float64).reshape(-1, dim)
        self.extra = np.frombuffer(row[f"{prefix}extra"], np.float64).reshape(len(self.row_ids), -1)


def each_pair(compare: Callable[[Block, Block], tuple], schema: pa.Schema) -> Callable:
    """For mapInArrow: ``compare`` called on each query block and candidate block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                arrays = compare(Block(row, "q_", row["dim"]), Block(row, "", row["dim"]))
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return run
