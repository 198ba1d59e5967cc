"""Stored baselines: signatures of findings already known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import signature
from siftline.schemas import BASELINE
from siftline.sources.files import locate
from siftline.sources.local import table_of


def signatures(findings: DataFrame) -> DataFrame:
    """One signature per finding."""
    return findings.select(
        signature(F.col("rule_id"), F.col("path"), F.col("line"), F.col("snippet")).alias("signature")
    )


def write_baseline(findings: DataFrame, location: str) -> DataFrame:
    """Store the signatures of all findings as Parquet; what is left to report is nothing."""
    signatures(findings).write.mode("overwrite").parquet(location)
    return findings.limit(0)


def export_baseline_json(findings: DataFrame, location: str) -> None:
    """Store the signatures as JSON lines, one document ``{"items": [..]}`` per finding.

    :func:`read_baseline` reads the lines back; no task holds more than its rows.
    """
    rows = signatures(findings).select(F.array("signature").alias("items"))
    rows.select(F.to_json(F.struct("items")).alias("value")).write.mode("overwrite").text(location)


def read_baseline(spark: SparkSession, location: str) -> DataFrame:
    """Signatures of a stored baseline.

    Reads Parquet directories, and JSON as an array of signatures or as
    ``{"items": [..]}``: one document per file, indented or not, or one per line.
    A missing baseline is empty, and so is a file without any document.  Where some
    lines of a file are documents, each line stands for itself and those that do not
    parse (a write that was cut off) are left out.
    """
    place = locate(spark, location, names=True)
    if place is None:
        return table_of(spark, [], BASELINE)
    if any(name.endswith(".parquet") for name in [place.path, *place.names]):
        return spark.read.parquet(location).select("signature")
    lines = spark.read.text(location).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    parsed = parse_baseline(lines)
    # files without a line that is a document are one document: indented ones
    by_line = parsed.where(F.col("items").isNotNull()).select("file").distinct()
    in_order = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    whole = lines.join(by_line, "file", "left_anti").groupBy("file").agg(F.array_join(in_order["value"], "\n").alias("value"))
    found = parsed.select("items").unionByName(parse_baseline(whole).select("items"))
    return found.select(F.explode("items").alias("signature"))


def parse_baseline(texts: DataFrame) -> DataFrame:
    """Rows with the text ``value`` of a document, and its signatures as ``items`` (null if it is none)."""
    plain = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>"))
    wrapped = F.when(F.ltrim("value").startswith("{"), F.from_json("value", "items array<string>")["items"])
    return texts.withColumn("items", F.coalesce(plain, wrapped))
