"""Corpus preparation: stages over ``documents``, each written as Parquet and read again.

Toxic documents go, one document of each group of near copies stays, personal data
is masked, sources are mixed to target weights, and the texts become token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.minhash import near_duplicates
from siftline.llm.mixing import mix_sources
from siftline.llm.pieces import decode, encode, load
from siftline.llm.pii import redact_pii
from siftline.llm.queries import MODEL, table
from siftline.llm.toxicity import held_out, toxicity_scores
from siftline.plans.materialize import keep, store


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def packed(docs: DataFrame) -> DataFrame:
    """The columns that stages work on, and all others in one struct, so that no name can clash."""
    others = [c for c in docs.columns if c not in COLUMNS]
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest")] if others else []
    return docs.select(*(c for c in COLUMNS if c in docs.columns), *rest)


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return rows.select(*(F.col(c) if c in COLUMNS else F.col("rest").getField(c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below one half; all their columns as they were.

    Null and empty texts have the score of a text without words, and very long texts are
    scored whole.  Repeated rows have one score and stay or go together.  Rows with null
    ids are scored too.  Without rows nothing comes out.
    """
    scored = toxicity_scores(packed(docs), table(spark, sf_dir, "labels"), may_learn=~held_out())
    return unpacked(scored.where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles agree on four fifths, the one with the smallest id.

    Null, empty and blank texts are like no other text, so each of these rows stays but
    for repeats.  Of rows that repeat id and text one stays, whatever their other columns.
    In a group without any id one row of each text stays.  Very long texts are compared
    whole.  Columns stay as they were; without rows nothing comes out.
    """
    rows = packed(docs)
    kept = near_duplicates(rows).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    marks = keep(kept.agg(F.count(F.lit(1)).alias("_rows")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_key"))
    once = rows.join(marks.where("_rows = 1"), same, "left_semi")
    repeated = marks.where("_rows > 1")  # rows with one id and text are copies of each other
    if not repeated.isEmpty():
        once = once.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return unpacked(once, docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data put as its kind, with ``n_chars`` of the new text where it changed.

    Null texts stay null and empty ones empty.  Repeated rows are masked alike, very long
    texts whole.  All other columns, of whatever name, stay as they were.
    """
    rows = packed(docs)
    kept = rows.select(F.struct(*(F.col(c) for c in rows.columns)).alias("row"), "text")
    masked = redact_pii(kept)
    changed = ~F.col("row.text").eqNullSafe(F.col("text"))
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return unpacked(masked.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in rows.columns)), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources evenly, about as many documents as before, in a shuffled order.

    Rows without a source are a source of their own.  Repeated rows are counted and drawn
    each, alike; rows with null ids are drawn by their text.  Texts, null, empty or long,
    are not looked at otherwise.  Columns stay as they were; without rows nothing comes out.
    """
    return unpacked(mix_sources(packed(docs)), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, token_ids, round_trip): ids of each text, and whether they decode to it.

    A null text has null ids and no count, and comes back as null; an empty text has none.
    Very long texts are encoded whole, repeated rows alike.  Extra columns go.
    """
    model = load(spark, MODEL)
    encoded = docs.select("doc_id", "source", "text", encode(F.col("text"), model).alias("token_ids"))
    same = decode(F.col("token_ids"), model).eqNullSafe(F.col("text"))
    return encoded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix),
    ("tokens", tokenize),
]

ORACLE_SQL = None  # the fits of the first and third stage are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
