"""Toxicity scores by FTRL-proximal logistic regression.

Features are the distinct hashed words, word pairs and skip-grams of the whole
lower-cased text.  The fit runs in one task over a bounded sample of labelled
texts (``max_rows``, at most half of them of each label, and of these at most
``max_bytes`` in the order of their hashes; texts of the rarer label take as many
turns in sum as the others); its L1 term leaves a short list
of weights, at most ``2^bits``, which travels to the tasks that score.

Cases: null and empty texts have no features and get the score of the intercept;
labels that are null, other than 0 and 1 or without an id are not learned from;
texts that repeat are learned from once (labelled toxic if one of them is).
Repeated documents get a score each; very long texts are scored whole, and learned
from whole if ``max_bytes`` has room for them.  Without labels of both kinds all scores
are the share of toxic ones, or 0 without any.  Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.ngrams import grams, lowered
from siftline.llm.shingles import WordHashes, values_of
from siftline.plans.materialize import keep

INTERCEPT = -1


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates and binary features."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)  # the last one is the intercept

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        """``at`` ends in the intercept, which the L1 term spares."""
        z, n = self.z[at], self.n[at]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        least = np.append(np.full(len(z) - 1, self.l1), 0.0)
        return np.where(np.abs(z) <= least, 0.0, (np.sign(z) * least - z) / rate)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, float(x)))))


def training_rows(docs: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int, max_bytes: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(mark, text, label): at most ``max_rows`` texts, those whose ids have the smallest hashes, of ``max_bytes`` in sum."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & may_learn)
    ordered = [F.xxhash64("doc_id"), F.col("doc_id")]
    halves = [known.where(F.col("label") == y).distinct().orderBy(*ordered).limit(max_rows // 2) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1])  # at most max_rows short rows, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    once = found.groupBy(F.xxhash64("text").alias("mark")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    rows = keep(once.orderBy("mark").limit(max_rows).select("mark", "text", "label"))
    # at most max_rows thin rows
    sizes = rows.select("mark", F.sum(F.octet_length("text")).over(Window.orderBy("mark")).alias("bytes"))
    return rows.join(F.broadcast(sizes.where(F.col("bytes") <= max_bytes).select("mark")), "mark", "left_semi")


def fit(rows: DataFrame, bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> list[tuple[int, float]]:
    """The weights that are not zero; ``INTERCEPT`` numbers the intercept."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, examples = WordHashes(), []
        for batch in batches:
            marks, labels = batch.column("mark").to_pylist(), batch.column("label").to_pylist()
            texts = values_of(batch.column("text"), lowered)
            examples += [(m, grams(t, bits, memo).astype(np.int32), y) for m, t, y in zip(marks, texts, labels, strict=True)]
        examples.sort(key=lambda x: x[0])  # so the fit does not depend on how rows arrive
        model, toxic = Ftrl(bits, alpha, beta, l1, l2), sum(y for _, _, y in examples)
        if 0 < toxic < len(examples):
            kinds = np.array([y for _, _, y in examples])
            often = np.where(kinds == 1, max(1, round((len(kinds) - toxic) / toxic)), max(1, round(toxic / (len(kinds) - toxic))))
            turns, order = np.repeat(np.arange(len(kinds)), often), np.random.default_rng(0)
            for _ in range(epochs):
                for i in order.permutation(turns):
                    model.learn(examples[i][1], examples[i][2])
        weights = model.weights(slice(None))
        if not 0 < toxic < len(examples):
            weights[-1] = 35.0 if toxic else -35.0
        at = np.flatnonzero(weights)
        numbers = np.where(at == 2**bits, INTERCEPT, at)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(weights[at], pa.float64())], names=["feature", "weight"])

    found = rows.repartition(1).mapInArrow(train, "feature long, weight double")
    return [(r.feature, r.weight) for r in found.collect()] or [(INTERCEPT, -35.0)]


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column | None = None,
    max_rows: int = 16_000,
    max_bytes: int = 128 << 20,
    bits: int = 20,
    epochs: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 8.0,
    l2: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    ``may_learn`` is a condition on ``doc_id`` that labelled rows have to meet.
    """
    may_learn = F.lit(True) if may_learn is None else may_learn
    rows = training_rows(docs, labels, may_learn, max_rows, max_bytes, id_col, text_col, label_col)
    weights = fit(rows, bits, epochs, alpha, beta, l1, l2)
    numbers = np.array([f for f, _ in weights], np.int64)
    values = np.array([w for _, w in weights], np.float64)
    model = docs.sparkSession.sparkContext.broadcast((numbers, values))  # at most 2^bits + 1 pairs

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo, table = WordHashes(), np.zeros(2**bits)
        at, w = model.value
        table[at[at != INTERCEPT]] = w[at != INTERCEPT]
        base = float(w[at == INTERCEPT].sum())
        for texts in batches:
            yield pa.array([sigmoid(base + table[grams(t, bits, memo)].sum()) for t in values_of(texts, lowered)], pa.float64())

    scored = docs.withColumn("score", score.asNondeterministic()(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
