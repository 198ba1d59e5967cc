"""Keeping an intermediate result that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder driver and executors share: what ``spark.checkpoint.dir`` names.

    Where none is named, as in tests, a folder of the warehouse is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, on storage that outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
