"""Passages repeated across documents, by sparse suffix arrays over minimiser positions.

1. In every window of ``min_words`` words the run of ``anchor_words`` words with
   the smallest hash is the window's minimiser.  Suffixes are retained only where
   a minimiser starts, about one word in thirteen.  Equal windows have their
   minimiser at the same place, so no repeated window is missed.
2. Retained suffixes are sorted over all texts, by ranges: first by their first
   ``anchor_words`` words, read as one letter (a 64-bit hash), then by text.  Equal
   starts of different texts are neighbours then, so a suffix whose neighbour has the
   same start is a hit.  A start that very many texts share lies in several ranges,
   and where two ranges meet their edge rows, two a range, are compared once more.
3. Hits are extended left and right, to all windows that have the hit as their
   minimiser: first as far as they go together, as one stretch, which copies share as
   a whole, and where no other text has that stretch, window by window.  Overlapping
   windows that occur in another text as well are joined to spans, as long as the
   match goes on.

An extension is compared with those of all texts that share the start, by hash, not
with the neighbours in the sort alone: of three texts the left side may agree with
one and the right side with the other, and the neighbour of a suffix is the nearest
on its right side only, so neighbours alone would miss windows.

Words are those of the lower-cased (A-Z) text between ASCII white space.  A text
that occurs in several rows is looked at once, and is a repeat as a whole if it
has ``min_words`` words.  Repeats inside one document alone do not count.

Cases: null, empty and short texts have no spans; very long texts are searched
whole; rows that repeat are copies of each other; null ids are allowed.  Extra
columns are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.shingles import WordHashes, mix, texts_of, words_of
from siftline.plans.materialize import keep

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class RunHashes:
    """Hashes of all runs of some length in a sequence of word hashes, from one prefix sum."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * powers(BASE, n), dtype=np.uint64)])
        self.back = powers(_INVERSE, n + 1)

    def of(self, length: int) -> np.ndarray:
        n = max(len(self.sums) - length, 0)
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.back[:n] + np.uint64(length))

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes | None, memo: WordHashes) -> np.ndarray:
    words = words_of(text) if text else []
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def minimisers(runs: RunHashes, min_words: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``min_words`` words the place of its minimiser, and all run hashes."""
    hashes = runs.of(anchor_words)
    width = min_words - anchor_words + 1
    if len(hashes) < width:
        return np.zeros(0, np.int64), hashes
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    return np.arange(len(views)) + views.argmin(axis=1), hashes


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text): ``mark`` is the MD5 of the text, null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("mark"), text.alias("text"))


def retained_suffixes(texts: DataFrame, min_words: int, anchor_words: int) -> DataFrame:
    """(doc_id, mark, n_words, anchors): the starts of the retained suffixes of each row, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            counts, anchors = [], []
            for text in texts_of(batch.column("text")):
                words = word_hashes(text, memo)
                at, hashes = minimisers(RunHashes(words), min_words, anchor_words)
                counts.append(len(words))
                anchors.append(np.unique(hashes[np.unique(at)].view(np.int64)))
            made = [pa.array(counts, pa.int64()), pa.array(anchors, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *made], names=["doc_id", "mark", "n_words", "anchors"])

    return texts.mapInArrow(run, "doc_id long, mark binary, n_words long, anchors array<long>")


def shared_starts(suffixes: DataFrame) -> DataFrame:
    """The rows (text_id, anchor) whose anchor another text has too; each is there once.

    Sorted by ranges and compared with the rows before and after.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, anchors = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last row of the batch before
        met, begun = False, False
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.concatenate([ids, batch.column("text_id").to_numpy()])
            anchors = np.concatenate([anchors, batch.column("anchor").to_numpy()])
            same = anchors[1:] == anchors[:-1]
            matched = np.append(False, same) | np.append(same, False)
            matched[0] |= met
            edge = np.zeros(len(ids), bool)
            edge[0] = not begun
            if len(ids) > 1:
                yield _rows(ids[:-1], anchors[:-1], matched[:-1], edge[:-1])
                begun = True
            ids, anchors, met = ids[-1:], anchors[-1:], bool(matched[-1])
        if len(ids):
            yield _rows(ids, anchors, np.array([met]), np.array([True]))

    def _rows(ids: np.ndarray, anchors: np.ndarray, matched: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        kept = matched | edge
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (ids, anchors, matched)] + [pa.array(edge[kept])], names=["text_id", "anchor", "matched", "edge"])

    array = suffixes.repartitionByRange("anchor", "text_id").sortWithinPartitions("anchor", "text_id")
    met = keep(array.mapInArrow(run, "text_id long, anchor long, matched boolean, edge boolean"))
    edges = met.where("edge").groupBy("anchor").agg(F.min("text_id").alias("low"), F.max("text_id").alias("high")).where("low != high")
    late = met.where("edge AND NOT matched").join(edges.select("anchor"), "anchor", "left_semi")
    return met.where("matched").select("text_id", "anchor").unionByName(late.select("text_id", "anchor"))


def stretches_at(hits: DataFrame, min_words: int, anchor_words: int) -> DataFrame:
    """(text_id, start, anchor, stretch, windows): the windows whose minimiser is one of ``anchors``.

    A row holds all windows in a row that share a minimiser, and as ``stretch`` the
    hash of the words they cover together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            columns = batch.column("text_id").to_pylist(), texts_of(batch.column("text")), batch.column("anchors")
            for text_id, text, wanted in zip(*columns, strict=True):
                runs = RunHashes(word_hashes(text, memo))
                at, hashes = minimisers(runs, min_words, anchor_words)
                first = np.flatnonzero(np.diff(at, prepend=-1))  # windows that share a minimiser follow each other
                last = np.append(first[1:], len(at))
                kept = np.isin(hashes[at[first]].view(np.int64), wanted.values.to_numpy())
                first, last = first[kept], last[kept]
                covered = runs.between(first, last - 1 + min_words)
                windows = runs.of(min_words).view(np.int64)
                inside = np.concatenate([np.arange(x, y) for x, y in zip(first, last, strict=True)]) if len(first) else first
                lists = pa.ListArray.from_arrays(np.cumsum(np.append(0, last - first)).astype(np.int32), pa.array(windows[inside]))
                cells = [np.full(len(first), text_id, np.int64), first.astype(np.int32), hashes[at[first]].view(np.int64), covered.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cells), lists], names=["text_id", "start", "anchor", "stretch", "windows"])

    return hits.mapInArrow(run, "text_id long, start int, anchor long, stretch long, windows array<long>")


def repeated_stretches(stretches: DataFrame) -> DataFrame:
    """(text_id, first, last): runs of windows, by their first and last start, that other texts hold too.

    A stretch that another text has as a whole needs no look at its windows.  The
    windows of the others are compared one by one, with each other and with those
    of one of each of the stretches that repeat.
    """
    key = ["anchor", "stretch"]
    # summed up before the shuffle; the rows of a hot stretch are only joined to it, which Spark can split
    whole = stretches.groupBy(*key).agg(
        F.min("text_id").alias("low"), F.max("text_id").alias("high"), F.first("windows").alias("windows")
    )
    whole = keep(whole.where("low != high"))
    thin = stretches.select("text_id", *key, F.col("start").alias("first"), (F.col("start") + F.size("windows") - 1).alias("last"))
    full = thin.join(whole.select(*key).hint("merge"), key)
    parts = stretches.join(whole.select(*key).hint("merge"), key, "left_anti")
    known = whole.select("anchor", "windows", "low", "high")
    known = known.join(parts.select("anchor").distinct().hint("merge"), "anchor", "left_semi")
    known = known.select("anchor", F.explode("windows").alias("window"), "low", "high")
    windows = parts.select("text_id", "anchor", "start", F.posexplode("windows").alias("i", "window"))
    windows = keep(windows.select("text_id", "anchor", "window", (F.col("start") + F.col("i")).alias("at")))
    ends = known.unionByName(windows.select("anchor", "window", F.col("text_id").alias("low"), F.col("text_id").alias("high")))
    ends = keep(ends.groupBy("anchor", "window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high"))
    single = windows.join(ends.select("anchor", "window").hint("merge"), ["anchor", "window"])
    return full.select("text_id", "first", "last").unionByName(
        single.select("text_id", F.col("at").alias("first"), F.col("at").alias("last"))
    )


def join_runs(runs: Column, min_words: int) -> Column:
    """Spans (start, end) in words that sorted runs of windows (first, last) cover."""
    span = "array<struct<start:int,end:int>>"
    nothing = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.array().cast(span).alias("spans"))

    def closed(acc: Column) -> Column:
        last = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))).cast(span)
        return F.when(acc["start"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], last))

    def step(acc: Column, run: Column) -> Column:
        goes_on = run["first"] <= acc["end"]
        end = run["last"] + min_words
        return F.struct(
            F.when(goes_on, acc["start"]).otherwise(run["first"]).alias("start"),
            F.when(goes_on, F.greatest(acc["end"], end)).otherwise(end).alias("end"),
            F.when(goes_on, acc["spans"]).otherwise(closed(acc)).alias("spans"),
        )

    return F.aggregate(runs, nothing, step, closed)


def repeated_passages(
    docs: DataFrame, min_words: int = 50, anchor_words: int = 25, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, copies, spans): per document, spans in words that other documents hold too.

    ``copies`` counts the rows with the very same text.
    """
    texts = _texts(docs, id_col, text_col)
    known = retained_suffixes(texts, min_words, anchor_words).groupBy("mark").agg(
        F.min("doc_id").alias("_id"),
        F.first("n_words").alias("n_words"),
        F.count(F.lit(1)).alias("copies"),
        F.first("anchors").alias("anchors"),
    )
    known = keep(known.withColumn("text_id", F.monotonically_increasing_id()))
    hits = shared_starts(known.select("text_id", F.explode("anchors").alias("anchor")))
    hits = hits.groupBy("text_id").agg(F.collect_list("anchor").alias("anchors"))
    hits = keep(hits.join(known.select("text_id", "_id", F.col("mark").alias("_mark")), "text_id"))
    same = texts["doc_id"].eqNullSafe(hits["_id"]) & (texts["mark"] == hits["_mark"])
    stretches = stretches_at(texts.join(hits, same).select("text_id", "text", "anchors"), min_words, anchor_words)
    runs = repeated_stretches(keep(stretches)).groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    spans = runs.select("text_id", join_runs(F.col("runs"), min_words).alias("spans"))
    found = known.select("text_id", "mark", "n_words", "copies").join(spans, "text_id", "left")
    kind = "array<struct<start:int,end:int>>"
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).cast(kind)
    repeats = F.when((F.col("copies") > 1) & (F.col("n_words") >= min_words), whole)
    spans = repeats.otherwise(F.coalesce("spans", F.array().cast(kind))).alias("spans")
    found = keep(found.select("mark", "n_words", "copies", spans))
    return texts.select("doc_id", "mark").join(found, "mark").select("doc_id", "n_words", "copies", "spans")
