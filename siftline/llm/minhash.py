"""Near-duplicate documents by one-permutation MinHash.

1. Each text gets its set of word shingles, a 128-bit digest of the set, and a
   one-permutation signature with optimal densification, cut into bands.  Texts
   with the same set are one class; only classes go on.
2. Classes that share a band key are in a bucket.  Candidate edges run from the
   smallest class of the bucket to the others (a star), never between all.
   Members that are not clearly close to that hub go on to another round, in
   buckets of a key longer by one band, until none is left; so a bucket that a
   passage common to very many texts has filled falls apart at once.
3. Edges of similar signatures join classes to clusters.  A cluster is compared
   exactly, on the full sets, in pairs of bounded blocks; a block pair gives at
   most one link per member (a spanning forest).
4. Links give the connected components.

Why stars lose no link: of two linked classes in a bucket, say one is close to the
hub: it agrees with it on ``LEAVE`` of the signature.  The other differs from it on
at most 1 - threshold of the signature plus sampling error (five deviations at 128
bins: 0.31 together at 0.85), so it agrees with the hub on ``JOIN`` at least, and
both are in the same cluster.  If both are far from the hub they meet again under
the longer key with probability 0.85^4.  A linked pair shares no bucket at all with
probability (1 - 0.85^4)^32, about 5e-11; if a third of its buckets had a hub far
from both it would be lost with probability (1 - 0.85^4 * 2/3 - 0.85^8 / 3)^32,
about 1e-8.  At 0.80 these are 5e-8 and 3e-6, and ``JOIN`` has 3.4 deviations.
Below that the bands and both constants lose links, at 0.60 one in 80 by the first
formula alone, so a threshold under ``LEAST_PERCENT`` is refused.

Cases: null, empty and blank texts have the empty set and are linked to nothing.
Rows that repeat are rows of the same class.  A null id counts for no minimum; a
group without any id has a null component, and its rows are kept.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.components import rooted
from siftline.llm.shingles import OnePermutation, WordHashes, digest, shingles, texts_of, values_of
from siftline.plans.materialize import keep

LEAVE, JOIN = 0.65, 0.33  # see above
LEAST_PERCENT = 80  # that bands of 4 rows, LEAVE and JOIN hold for
BLOCK_ROWS, BLOCK_SHINGLES = 256, 400_000
COLUMNS = 8192  # of a membership matrix at once

SKETCH = "doc_id long, text_key long, set_id binary, n_shingles long, signature binary, bands array<long>"


def sketches(docs: DataFrame, size: int, bins: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: digest of its set, signature and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, cut = WordHashes(), OnePermutation(bins, rows)
        for batch in batches:
            ids, counts, marks, bands = [], [], [], []
            for text in texts_of(batch.column("text")):
                found = shingles(text, size, memo)
                counts.append(len(found))
                values = cut.values(found) if len(found) else None
                ids.append(None if values is None else digest(found))
                marks.append(None if values is None else cut.short(values))
                bands.append(None if values is None else cut.bands(values))
            made = [pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *made], names=["doc_id", "text_key", "set_id", "n_shingles", "signature", "bands"])

    return _texts(docs, id_col, text_col).mapInArrow(run, SKETCH)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def agreement(left: Column, right: Column) -> Column:
    """Share of two signatures' values that are equal."""

    @F.arrow_udf("double")
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        # two bytes a value; all signatures of a call have one length
        x = np.frombuffer(b"".join(a.to_pylist()), np.uint16).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b.to_pylist()), np.uint16).reshape(len(b), -1)
        return pa.array((x == y).mean(axis=1) if len(a) else np.zeros(0), pa.float64())

    return agree(left, right)


def star_edges(classes: DataFrame) -> DataFrame:
    """(a, b): classes whose signatures agree well enough to be compared in full."""
    marks = classes.select("set_id", "signature", "bands").hint("merge")
    hub_marks = classes.select(F.col("set_id").alias("hub"), F.col("signature").alias("hub_signature")).hint("merge")
    pool = classes.select("set_id", "doc_id", F.posexplode("bands").alias("band", "key"))
    pool = pool.withColumn("key", F.xxhash64("band", "key"))
    edges: list[DataFrame] = []
    while True:
        hubs = pool.groupBy("key").agg(F.min(F.struct("doc_id", "set_id")).alias("hub"), F.count(F.lit(1)).alias("n"))
        hubs = hubs.where("n > 1").select("key", F.col("hub.set_id").alias("hub"))
        bucketed = keep(pool.join(hubs.hint("merge"), "key").where(F.col("set_id") != F.col("hub")))
        near = bucketed.select("set_id", "hub").distinct().join(marks, "set_id").join(hub_marks, "hub")
        agree = agreement(F.col("signature"), F.col("hub_signature")).alias("agree")
        near = keep(near.select("set_id", "hub", "bands", agree))
        edges.append(near.where(F.col("agree") >= JOIN).select(F.col("set_id").alias("a"), F.col("hub").alias("b")))
        far = near.where(F.col("agree") < LEAVE).select("set_id", "hub", "bands")
        if far.isEmpty():
            return reduce(DataFrame.unionByName, edges)
        turn = len(edges)
        other = F.element_at("bands", (F.col("band") + turn) % F.size("bands") + 1)
        pool = bucketed.join(far.hint("merge"), ["set_id", "hub"])
        pool = pool.select("set_id", "doc_id", "band", F.xxhash64("key", other).alias("key"))


def block_pairs(members: DataFrame, least: float) -> DataFrame:
    """(pair, side, set_id, doc_id, text_key): members of each pair of blocks to compare.

    Sizes of linked sets differ by the threshold at most, so a block holds sets of
    one size class and meets its own class and the next.  Large classes are cut by
    the digest into blocks of bounded rows and shingles.
    """
    sized = members.withColumn("class", F.floor(F.log("n_shingles") / F.lit(-float(np.log(least))) + 1e-9))
    totals = sized.groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    totals = totals.withColumn("parts", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int"))
    totals = keep(totals.select("cluster", "class", "parts"))  # a large class is split where it is joined
    laid = sized.join(totals.hint("merge"), ["cluster", "class"]).withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    blocks = totals.select("cluster", "class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    after = totals.select("cluster", (F.col("class") - 1).alias("class"), F.col("parts").alias("parts_after"))
    near = blocks.join(totals, ["cluster", "class"]).join(after, ["cluster", "class"], "left")
    own = F.transform(F.sequence("part", F.col("parts") - 1), lambda p: F.struct(F.col("class").alias("class"), p.alias("part")))
    empty = F.array().cast("array<struct<class:bigint,part:int>>")
    above = F.when(
        F.col("parts_after").isNotNull(),
        F.transform(F.sequence(F.lit(0), F.col("parts_after") - 1), lambda p: F.struct((F.col("class") + 1).alias("class"), p.alias("part"))),
    ).otherwise(empty)
    pairs = near.select("cluster", "class", "part", F.explode(F.concat(own.cast("array<struct<class:bigint,part:int>>"), above)).alias("other"))
    pairs = pairs.withColumn("pair", F.xxhash64("cluster", "class", "part", "other.class", "other.part"))
    left = pairs.select("pair", "cluster", "class", "part", F.lit(0).alias("side"))
    right = pairs.where("other.class != class or other.part != part").select(
        "pair", "cluster", F.col("other.class").alias("class"), F.col("other.part").alias("part"), F.lit(1).alias("side")
    )
    return laid.join(left.unionByName(right), ["cluster", "class", "part"]).select("pair", "side", "set_id")


def links_of(sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks, or within one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    held = shared[column]
    doc, column = doc[held], number[column[held]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(shared.sum()), COLUMNS):
        at = slice(*np.searchsorted(column, [start, start + COLUMNS]))
        matrix = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - start)), np.float32)
        matrix[doc[at], column[at] - start] = 1
        both += matrix @ matrix.T
    common = np.rint(both).astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    side = np.array(sides)
    if side.any():
        linked &= side[:, None] != side[None, :]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = find(int(x)), find(int(y))
        if a != b:
            root[a] = b
            out.append((int(x), int(y)))
    return out


def exact_links(docs: DataFrame, members: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links between classes, confirmed on their full sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = [shingles(t, size, memo).tobytes() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(found, pa.binary())], names=["set_id", "shingles"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found = links_of([np.frombuffer(r[2], np.uint64) for r in held], [r[1] for r in held], percent)
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in found], pa.binary()), pa.array([held[j][0] for _, j in found], pa.binary())], names=["a", "b"])

        pair, held = None, []
        for batch in batches:
            rows = zip(*(values_of(batch.column(c)) for c in ("pair", "set_id", "side", "shingles")), strict=True)
            for key, *row in rows:
                if key != pair and len(held) > 1:
                    yield flush()
                if key != pair:
                    pair, held = key, []
                held.append(row)
        if len(held) > 1:
            yield flush()

    wanted = members.select("doc_id", "text_key", "set_id")
    texts = _texts(docs, id_col, text_col)
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_key"] == wanted["text_key"])
    chosen = texts.join(wanted, same).select("set_id", "text")
    full = chosen.mapInArrow(sets, "set_id binary, shingles binary").groupBy("set_id").agg(F.first("shingles").alias("shingles"))
    pairs = block_pairs(members, percent / 100)
    laid = pairs.join(full, "set_id").select("pair", "set_id", "side", "shingles")
    laid = laid.repartition(F.col("pair")).sortWithinPartitions("pair", "side", "set_id")
    return laid.mapInArrow(links, "a binary, b binary")


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    shingle_words: int = 5,
    bins: int = 128,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept): one row per document.

    Texts are linked when 100 * shared >= percent * all of their distinct
    ``shingle_words``-word shingles; ``component_id`` is the smallest id that
    links reach.  ``text_key`` is xxhash64 of the text.  ``percent`` is
    ``LEAST_PERCENT`` at least, see above.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {percent}; links are found for {LEAST_PERCENT} to 100 only")
    rows_ = keep(sketches(docs, shingle_words, bins, rows, id_col, text_col))
    sets = rows_.where(F.col("set_id").isNotNull()).groupBy("set_id")
    classes = keep(
        sets.agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        ).select("set_id", "first.doc_id", "first.text_key", "n_shingles", "signature", "bands")
    )
    clusters = rooted(star_edges(classes), "a", "b")
    named = classes.select("set_id", "doc_id", "text_key", "n_shingles")
    members = keep(named.join(clusters.select(F.col("node").alias("set_id"), F.col("root").alias("cluster")), "set_id"))
    groups = rooted(exact_links(docs, members, shingle_words, percent, id_col, text_col), "a", "b")
    groups = keep(groups.join(named.select(F.col("set_id").alias("node"), "doc_id"), "node"))
    lowest = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = groups.join(lowest, "root").select(F.col("node").alias("set_id"), "component_id")
    ids = named.select("set_id", F.col("doc_id").alias("own")).join(linked, "set_id", "left")
    # kept, so that the join with the rows has a plain shuffle on either side and a hot class can be split
    ids = keep(ids.select("set_id", F.coalesce("component_id", "own").alias("component_id")))
    out = rows_.select("doc_id", "text_key", "n_shingles", "set_id").join(ids, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
