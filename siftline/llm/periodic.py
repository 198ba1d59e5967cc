"""Runs of periodic words in texts, solved in tiles per scale and stitched together.

A run is a stretch of words with smallest period q, of ``least_words`` words and
``least_powers`` periods at least, that no neighbouring word extends.  With w[i] = w[i+q]
called a match at i, a run of n words is a stretch of n - q matches.

1. Periods are handled by octaves, those from L to 2L - 1 (L a power of two) together.
   Boundaries lie 2L words apart.  A run of four periods has M = 3q matches or more in
   a row, so at some boundary b the M - 2L + 1 words from b on are found again q words
   later.  Equal window hashes say where that may be; texts without any such place are
   done.  Periods that are a smaller one several times over are left to the smaller one.
2. The other texts are exploded into tiles, one per octave and boundary found: the
   words from 2L before the boundary to 8L after it.  Tiles of a text overlap.
3. Each tile is solved on its own, where it was cut out.  The Z-function of the words
   after the boundary gives for each q how far the matches go on to the right, that of
   the reversed words before it how far to the left.
4. These fragments are shuffled by text and period and stitched: fragments of one period
   that meet or overlap are one stretch of matches.  Boundaries that a stretch covers lie
   2L apart, the first of them has less than 2L matches to its left, the last less than
   M + 1 to its right, so fragments leave out nothing between them and at the ends.
5. A stretch found with several periods has the smallest of them.

Words are compared by numbers given inside one text, never by hashes alone.

Cases: null, empty and blank texts have no words and no runs.  Rows that repeat are
texts of their own, and null ids are allowed.  Very long texts are cut into tiles like
others.  Ties between runs go as stated where they are ranked.  Extra columns are not
looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.shingles import texts_of
from siftline.llm.suffixes import RunHashes
from siftline.plans.materialize import keep

WORDS_KEPT = 300_000  # numbers given before a new text starts anew; changes speed, not results
MANY = 16  # places from which on the whole Z-function is worked out
GROUP = 1 << 18  # words looked at together when places of tiles are searched

SCREENED = "row_id long, doc_id long, n_words long, plain_sha256 string, text binary"
TILE = "row_id long, octave int, boundary int, before int, periods binary, words binary"
FRAGMENT = "row_id long, period int, first int, past int"
RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


class WordNumbers(dict):
    """Numbers for words, in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def numbers_of(words: list[bytes], memo: WordNumbers) -> np.ndarray:
    """Equal numbers for equal words."""
    if len(memo) > WORDS_KEPT:
        memo.clear()
    return np.fromiter(map(memo.__getitem__, words), np.int32, len(words))


def octaves(n_words: int, powers: int) -> Iterator[int]:
    """Smallest periods of the octaves that a text of so many words has room for."""
    size = 1
    while size * powers <= n_words:
        yield size
        size *= 2


def repeats_at(
    numbers: np.ndarray, begin: np.ndarray, end: np.ndarray, least_words: int, powers: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(octave, texts, boundaries, periods): where the words at a boundary seem to come again, octave by octave.

    ``begin`` and ``end`` are the places of texts laid end to end in ``numbers``;
    boundaries are counted from the start of their text.  In order of text and boundary.
    """
    runs = RunHashes(numbers.astype(np.uint64) + np.uint64(1))
    for size in octaves(int((end - begin).max()) if len(begin) else 0, powers):
        marks = runs.of(size)
        room = np.flatnonzero(end - begin >= size * powers)
        count = (end[room] - begin[room] - 2 * size) // (2 * size) + 1  # boundaries with a block at L after them
        text = np.repeat(room, count)
        boundary = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * 2 * size
        at = begin[text] + boundary
        last = np.minimum(at + 2 * size, end[text] - size + 1)  # blocks from here on are too far or not in the text
        where, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(at) < size:
            for i, (a, b) in enumerate(zip(at, last, strict=True)):
                found = np.flatnonzero(marks[a + size : b] == marks[a]) + size
                where.append(np.full(len(found), i))
                periods.append(found)
        else:
            for shift in range(size, 2 * size):
                fits = np.flatnonzero(at + shift < last)
                found = fits[marks[at[fits]] == marks[at[fits] + shift]]
                where.append(found)
                periods.append(np.full(len(found), shift))
        where, periods = np.concatenate(where), np.concatenate(periods)
        # a stretch of M matches that holds a boundary 2L apart holds M - 2L + 1 from one of them on
        block, from_ = np.maximum(least_words - periods, (powers - 1) * periods) - 2 * size + 1, at[where]
        fits = np.flatnonzero(from_ + periods + block <= end[text[where]])
        where, periods, block, from_ = where[fits], periods[fits], block[fits], from_[fits]
        fits = runs.between(from_, from_ + block) == runs.between(from_ + periods, from_ + periods + block)
        where, periods = where[fits], periods[fits]
        order = np.lexsort((periods, where))
        if len(order):
            yield size, text[where[order]], boundary[where[order]], periods[order]


def tile_places(numbers: np.ndarray, least_words: int, powers: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(octave, boundary, periods) of the tiles of a text that may hold a run."""
    whole = np.zeros(1, np.int64), np.array([len(numbers)])
    for size, _, boundaries, periods in repeats_at(numbers, *whole, least_words, powers):
        places, first = np.unique(boundaries, return_index=True)
        for at, found in zip(places.tolist(), np.split(periods, first[1:]), strict=True):
            found = own_periods(numbers[at : at + int(found[-1])], found)
            if len(found):
                yield size, at, found


def z_function(s: list[int], upto: int) -> list[int]:
    """How many items from each place on (below ``upto``) are those at the start."""
    n, z, left, right = len(s), [0] * upto, 0, 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def z_values(s: np.ndarray, places: np.ndarray) -> list[int]:
    """The Z-function of ``s`` at some places: all of it where they are many, else one comparison each."""
    if len(places) > MANY:
        z = z_function(s.tolist(), int(max(places)) + 1)
        return [z[i] for i in places]
    out = []
    for i in places:
        same = s[i:] == s[: len(s) - i]
        stop = int(same.argmin()) if len(same) else 0
        out.append(len(same) if len(same) and same[stop] else stop)
    return out


@lru_cache(maxsize=1 << 16)
def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def own_periods(after: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Those of ``periods`` q for which the first q words are not a smaller part said several times.

    A run with such a q has the smaller part as its period, which another octave finds.
    """
    parts = [[q // p for p in prime_factors(q)] for q in periods.tolist()]
    smaller = np.array(sorted({d for ds in parts for d in ds}), np.int64)
    z = dict(zip(smaller.tolist(), z_values(after, smaller), strict=True))
    return periods[[not any(z[d] >= q - d for d in ds) for q, ds in zip(periods.tolist(), parts, strict=True)]]


def solve_tile(words: np.ndarray, before: int, size: int, periods: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, first, past) of stretches of matches around a boundary, counted from it.

    ``words`` are those of the tile, ``before`` of them in front of the boundary.  The
    stretches hold ``size`` matches from the boundary on at least.
    """
    right = z_values(words[before:], periods)
    if not before:
        return [(q, 0, x) for q, x in zip(periods.tolist(), right, strict=True) if x >= size]
    # the words before the boundary, backwards, then all words to 2L after it, backwards
    behind = words[: before + 2 * size][::-1]
    left = z_values(np.concatenate([words[:before][::-1], [-1], behind]), 1 + len(behind) - periods)
    return [(q, -y, x) for q, x, y in zip(periods.tolist(), right, left, strict=True) if x >= size]


def screened(docs: DataFrame, least_words: int, powers: int, id_col: str, text_col: str) -> DataFrame:
    """``SCREENED`` rows: words are counted, and ``text`` is left only where a run is possible.

    ``plain_sha256`` is the digest of all words with one space between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordNumbers()
        for batch in batches:
            counts, digests, suspect = [], [], np.zeros(batch.num_rows, bool)
            group: list[np.ndarray] = []
            held = first = 0
            for i, text in enumerate(texts_of(batch.column("text"))):
                words = text.split() if text else []
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                group.append(numbers_of(words, memo))
                held += len(words)
                if held >= GROUP or i == batch.num_rows - 1:
                    ends = np.cumsum([len(x) for x in group])
                    for _, at, _, _ in repeats_at(np.concatenate(group), np.append(0, ends[:-1]), ends, least_words, powers):
                        suspect[first + at] = True
                    group, held, first = [], 0, i + 1
            kept = pc.if_else(pa.array(suspect), batch.column("text").cast(pa.binary()), pa.scalar(None, pa.binary()))
            cells = [batch.column("row_id"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), kept]
            yield pa.RecordBatch.from_arrays(cells, names=[c.split()[0] for c in SCREENED.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCREENED)


def tiles(rows: DataFrame, least_words: int, powers: int) -> DataFrame:
    """The tiles of texts (row_id, text) that may hold a run; words as 4-byte numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordNumbers()
        for batch in batches:
            for row_id, text in zip(batch.column("row_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                numbers = numbers_of(text.split(), memo)
                rows_: list[tuple] = []
                held = 0
                for size, at, periods in tile_places(numbers, least_words, powers):
                    start = max(at - 2 * size, 0)
                    words = numbers[start : at + 8 * size]
                    rows_.append((row_id, size, at, at - start, periods.astype(np.int32).tobytes(), words.tobytes()))
                    held += len(words) + len(periods)
                    if held >= GROUP:
                        yield batch_of(rows_)
                        rows_, held = [], 0
                if rows_:
                    yield batch_of(rows_)

    def batch_of(rows_: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        cells = [pa.array(c, t) for c, t in zip(zip(*rows_, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(cells, names=[c.split()[0] for c in TILE.split(", ")])

    return rows.mapInArrow(run, TILE)


def fragments(tiles_: DataFrame) -> DataFrame:
    """(row_id, period, first, past): stretches of matches that each tile shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                columns = (batch.column(c).slice(at, 256).to_pylist() for c in ("row_id", "octave", "boundary", "before", "periods", "words"))
                for row_id, size, boundary, before, periods, words in zip(*columns, strict=True):
                    found = solve_tile(np.frombuffer(words, np.int32), before, size, np.frombuffer(periods, np.int32))
                    out += [(row_id, q, boundary + a, boundary + b) for q, a, b in found]
                cells = zip(*out, strict=True) if out else [[]] * 4
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                arrays = [pa.array(c, t) for c, t in zip(cells, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in FRAGMENT.split(", ")])

    return tiles_.mapInArrow(run, FRAGMENT)


def stitched(found: DataFrame, least_words: int, powers: int) -> DataFrame:
    """(row_id, start, period, length): runs, from fragments of their stretches of matches."""
    inside = Window.partitionBy("row_id", "period").orderBy("first", "past")
    so_far = F.max("past").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("first") <= so_far, 0).otherwise(1)
    pieces = found.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(inside))
    whole = pieces.groupBy("row_id", "period", "stretch").agg(F.min("first").alias("start"), F.max("past").alias("past"))
    whole = whole.select("row_id", "period", "start", (F.col("past") - F.col("start") + F.col("period")).alias("length"))
    long = whole.where(F.col("length") >= F.greatest(F.lit(least_words), F.lit(powers) * F.col("period")))
    return long.groupBy("row_id", "start", "length").agg(F.min("period").alias("period"))


def _kept_words(text: Column, runs: Column) -> Column:
    """SHA-256 of the words of each text that no run repeats, with one space between them."""

    @F.arrow_udf("string")
    def digest(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for data, rows in zip(texts_of(texts), (x.as_py() for x in found), strict=True):
            words = data.split()
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, [r["start"] + r["period"] for r in rows], 1)
            np.add.at(edges, [r["start"] + r["length"] for r in rows], -1)
            kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
            out.append(hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest())
        return pa.array(out, pa.string())

    return digest(text, runs)


def periodic_runs(
    docs: DataFrame, least_words: int = 6, least_powers: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_sha256): one row per row of ``docs``.

    ``runs`` are structs of start, period and length in words, by start and period.
    ``collapsed_sha256`` is the digest of the words left, one space between them, if each
    run keeps its first period only.
    """
    if least_powers < 4:
        raise ValueError("tiles find runs of four periods or more")
    rows = keep(screened(docs, least_words, least_powers, id_col, text_col))
    suspects = rows.where("text is not null").select("row_id", "text")
    runs = stitched(fragments(tiles(suspects, least_words, least_powers)), least_words, least_powers)
    listed = runs.select("row_id", *(F.col(c).cast("long").alias(c) for c in ("start", "period", "length")))
    listed = listed.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    listed = suspects.join(listed, "row_id").select("row_id", "runs", _kept_words(F.col("text"), F.col("runs")).alias("kept_sha256"))
    out = rows.select("row_id", "doc_id", "n_words", "plain_sha256").join(listed, "row_id", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("runs", F.array().cast(RUNS)).alias("runs"),
        F.coalesce("kept_sha256", "plain_sha256").alias("collapsed_sha256"),
    )


def with_planted_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the tails of some texts put as loops of their words, by the checksum of their ids.

    With h = crc32 of the id in decimal and g = h div 10, a text of n > 0 words whose
    h mod 10 is 0 has word a + (i - a) mod p in place of each word i from a = g mod n on,
    p = 1 + (n - a) div (3 + g mod 8).  Its words stand one space apart.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    looped = F.expr(
        """array_join(transform(_words, (word, i) -> CASE WHEN i < _from THEN word
            ELSE element_at(_words, int(_from + (i - _from) % _period) + 1) END), ' ')"""
    )
    chosen = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words").cast("long"))
    chosen = chosen.withColumn("_from", F.when(F.col("_n") > 0, F.floor(h / 10) % F.col("_n")))
    chosen = chosen.withColumn("_period", 1 + F.floor((F.col("_n") - F.col("_from")) / (3 + F.floor(h / 10) % 8)))
    return chosen.select("doc_id", F.when(F.col("_n") > 0, looped).otherwise(F.col("text")).alias("text"))


def run_columns(found: DataFrame) -> DataFrame:
    """Counts and digests of ``periodic_runs``, and the run of the greatest length by period.

    Of runs with equal exponents it is the one with the smaller start, then period.
    """
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    greater = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    best = found.withColumn("best", greater)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
