"""Blocks of lines around suspicious ones.  Everything stays inside the row of its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.functions.finder import find_lines
from siftline.functions.lines import has_marker, is_safe_line, is_sampled, is_suspicious
from siftline.functions.patterns import search_pattern
from siftline.functions.text import split_lines


def _searched() -> list[str]:
    return [search_pattern(p) for p in C.SUSPICIOUS_PATTERNS] + C.MANIFEST_WORDS


def wanted_line(line_no: Column, line: Column, path: Column, mode: str, marker: str) -> Column:
    """Lines a reviewer should see in the given mode."""
    wanted = is_suspicious(line, path)
    if mode != "targeted":
        wanted = wanted | is_sampled(line_no, line)
    if mode != "full":
        wanted = wanted & ~is_safe_line(line)
    return wanted & ~has_marker(line, marker)


def suspicious_lines(corpus: DataFrame, mode: str = "targeted", marker: str = C.IGNORE_MARKER) -> DataFrame:
    """(path, line_nos): the wanted lines of each file in order; files without any are left out."""
    return _with_wanted(corpus, mode, marker).select("path", "line_nos")


def _with_wanted(corpus: DataFrame, mode: str, marker: str) -> DataFrame:
    if mode not in C.MAX_BLOCKS:
        raise ValueError(f"unknown mode {mode!r}")
    every = 0 if mode == "targeted" else C.SAMPLE_EVERY
    near = corpus.select("path", "content", find_lines(F.col("content"), _searched(), every).alias("near"))
    # the finder lists lines in order and each once, so the numbers form a sorted set
    wanted = F.filter("near", lambda c: wanted_line(c["line_no"], c["line"], F.col("path"), mode, marker))
    return near.select("path", "content", F.transform(wanted, lambda c: c["line_no"]).alias("line_nos")).filter(
        F.size("line_nos") > 0
    )


def select_blocks(line_nos: Column, n_lines: Column, radius: int, max_blocks: int) -> Column:
    """Spans around the lines in order, skipping spans that overlap an earlier one.

    Lines ascend and all spans have the same radius, so it is enough to look at
    the end of the last span kept.
    """
    nothing = F.array().cast("array<struct<start_line:int,end_line:int>>")

    def add(kept: Column, line: Column) -> Column:
        start = F.greatest(F.lit(1), line - radius)
        span = F.struct(start.alias("start_line"), F.least(n_lines, line + radius).alias("end_line"))
        last_end = F.coalesce(F.get(kept, F.size(kept) - 1)["end_line"], F.lit(0))
        return F.when((F.size(kept) < max_blocks) & (start > last_end), F.concat(kept, F.array(span))).otherwise(kept)

    return F.aggregate(line_nos, nothing, add)


def file_blocks(
    corpus: DataFrame, mode: str = "targeted", radius: int = C.CONTEXT_RADIUS, marker: str = C.IGNORE_MARKER
) -> DataFrame:
    """(path, n_bytes, blocks) with one array of blocks per file; files without blocks are left out."""

    def cut(lines: Column) -> Column:
        spans = select_blocks(F.col("line_nos"), F.size(lines), radius, C.MAX_BLOCKS[mode])
        return F.transform(spans, lambda s: F.struct(s["start_line"], s["end_line"], text_of(lines, s).alias("text")))

    def text_of(lines: Column, span: Column) -> Column:
        return F.array_join(F.slice(lines, span["start_line"], span["end_line"] - span["start_line"] + 1), "\n")

    # the one-element array binds the split text to a name, so it is split once per file
    blocks = F.get(F.transform(F.array(split_lines(F.col("content"), crlf=True)), cut), F.lit(0))
    return _with_wanted(corpus, mode, marker).select(
        "path", F.octet_length("content").alias("n_bytes"), blocks.alias("blocks")
    )


def evidence_blocks(
    corpus: DataFrame, mode: str = "targeted", radius: int = C.CONTEXT_RADIUS, marker: str = C.IGNORE_MARKER
) -> DataFrame:
    """(path, block_no, start_line, end_line, text), one row per block, numbered from 1."""
    placed = file_blocks(corpus, mode, radius, marker).select("path", F.posexplode("blocks").alias("pos", "block"))
    return placed.select("path", (F.col("pos") + 1).alias("block_no"), "block.*")


def pick_evidence(blocks: Column, start: Column, end: Column) -> Column:
    """The first block a span of lines touches; the first of all without a span."""
    no_span = (F.coalesce(start, F.lit(0)) == 0) & (F.coalesce(end, F.lit(0)) == 0)
    low, high = F.coalesce(start, end), F.coalesce(end, start)
    touching = F.filter(blocks, lambda b: ~((high < b["start_line"]) | (low > b["end_line"])))
    return F.get(F.when(no_span, blocks).otherwise(touching), F.lit(0))
