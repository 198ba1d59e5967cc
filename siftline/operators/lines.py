"""Texts to lines and runs of lines.  Nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.functions.text import split_lines


def explode_lines(corpus: DataFrame, crlf: bool = False) -> DataFrame:
    """(path, line_no, line) with lines numbered from 1."""
    numbered = corpus.select("path", F.posexplode(split_lines(F.col("content"), crlf)).alias("pos", "line"))
    return numbered.select("path", (F.col("pos") + 1).alias("line_no"), "line")


def chunks(corpus: DataFrame, size: int = C.CHUNK_LINES) -> DataFrame:
    """(path, chunk_no, start_line, chunk_lines): runs of ``size`` lines, the last one shorter."""
    arrays = corpus.select("path", split_lines(F.col("content")).alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(size))
    placed = arrays.select("path", "lines", F.posexplode(starts).alias("chunk_no", "start_line"))
    return placed.select(
        "path", "chunk_no", "start_line", F.slice("lines", F.col("start_line"), F.lit(size)).alias("chunk_lines")
    )
