"""Small tables from Python values."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_of(spark: SparkSession, rows: list[dict], schema: T.StructType | str) -> DataFrame:
    """Rows as a constant of the query, so that Spark knows how small the table is."""
    kind = f"array<struct<{schema}>>" if isinstance(schema, str) else T.ArrayType(schema)
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))
