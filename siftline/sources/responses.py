"""Stored model replies, keyed by prompt hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.schemas import RESPONSE
from siftline.sources.files import locate
from siftline.sources.local import table_of

_COLUMNS = ["prompt_hash", "raw_text", "provider", "model"]


def read_responses(spark: SparkSession, location: str) -> DataFrame:
    """The reply to each prompt; where a prompt was stored twice, the later reply."""
    if locate(spark, location) is None:
        return table_of(spark, [], RESPONSE)
    return latest_responses(spark.read.parquet(location))


def latest_responses(responses: DataFrame) -> DataFrame:
    order = ["stored_at", *_COLUMNS[1:]] if "stored_at" in responses.columns else _COLUMNS[1:]
    newest = responses.groupBy("prompt_hash").agg(F.max(F.struct(*order)).alias("r"))
    return newest.select("prompt_hash", *[F.col(f"r.{c}") for c in _COLUMNS[1:]])


def append_responses(responses: DataFrame, location: str) -> None:
    """Add replies to the store.  Requests without a reply are not stored."""
    answered = responses.filter(F.col("raw_text").isNotNull())
    rows = answered.select(*_COLUMNS).withColumn("stored_at", F.current_timestamp())
    rows.write.mode("append").parquet(location)
