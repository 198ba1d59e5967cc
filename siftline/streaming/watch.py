"""Scanning files as they arrive.

The scan looks at each file on its own, so it runs unchanged on a stream and
keeps no state; the baseline is a fixed table.

Spark's file source passes over empty files and names that start with an
underscore or a dot.  Those are listed in the tasks when a stream starts and, where it
goes on, every ``relist_seconds``.  Names not listed before are appended to a
table below the checkpoint, which is a second source of the same query: each row
of it is read once, in the tasks.  A file is known by its path, as in the file
source; one listed while it was empty is read again when it no longer is, if its
name is one that Spark passes over.
"""

from __future__ import annotations

import logging
import threading
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline import catalogue as C
from siftline.operators.findings import diff_baseline, static_findings
from siftline.sources.corpus import MAX_BYTES, files_as_corpus, passed_over, path_filter, read_or_fail
from siftline.sources.files import locate

_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_PASSED_OVER = "uri string, path string, length bigint"


class FileStream(NamedTuple):
    listed: DataFrame
    """Stream of (path, content) of the files Spark lists."""
    root: str
    include: list[str] | None
    exclude: list[str] | None


def read_corpus_stream(
    spark: SparkSession,
    root: str,
    include: list[str] | None = C.DEFAULT_INCLUDE,
    exclude: list[str] | None = C.DEFAULT_EXCLUDE,
    max_files: int = 10_000,
) -> FileStream:
    """New files below a directory, for :func:`watch`; at most ``max_files`` that Spark lists per batch."""
    place = locate(spark, root)
    if place is None or not place.is_dir:
        raise FileNotFoundError(root)
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    corpus = files_as_corpus(files, place)
    return FileStream(corpus if include is None else path_filter(corpus, include, exclude), root, include, exclude)


def list_passed_over(spark: SparkSession, files: FileStream, location: str) -> None:
    """Append the files Spark does not list, and that the table does not have, to the table."""
    found = passed_over(spark, files.root, locate(spark, files.root), MAX_BYTES, files.include, files.exclude)
    if locate(spark, location) is not None:
        known = spark.read.schema(_PASSED_OVER).json(location).select("path", (F.col("length") == 0).alias("empty"))
        found = found.withColumn("empty", F.col("length") == 0).join(known, ["path", "empty"], "left_anti").drop("empty")
        if found.isEmpty():
            return
    found.write.mode("append").json(location)


def watch(
    corpus: DataFrame | FileStream,
    rules: list[dict],
    location: str,
    checkpoint: str,
    baseline: DataFrame | None = None,
    marker: str = C.IGNORE_MARKER,
    relist_seconds: float = 10.0,
    **trigger,
) -> StreamingQuery:
    """Append the findings of a corpus stream to a Parquet table.

    A file that cannot be read fails the query, whether Spark lists it or not.
    """
    trigger = trigger or {"availableNow": True}
    files, table = corpus, f"{checkpoint}/passed_over"
    if isinstance(files, FileStream):
        spark = files.listed.sparkSession
        list_passed_over(spark, files, table)
        other = spark.readStream.schema(_PASSED_OVER).json(table)
        corpus = files.listed.unionByName(read_or_fail(other))
    found = static_findings(corpus, rules, marker)
    if baseline is not None:
        found = diff_baseline(found, baseline)
    writer = found.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    query = writer.trigger(**trigger).start(location)
    if isinstance(files, FileStream) and not ("availableNow" in trigger or "once" in trigger):
        threading.Thread(target=_relist, args=(query, spark, files, table, relist_seconds), daemon=True).start()
    return query


def _relist(query: StreamingQuery, spark: SparkSession, files: FileStream, table: str, seconds: float) -> None:
    """Until the query ends; a listing that fails is tried again."""
    ended = threading.Event()
    while not ended.wait(seconds):
        try:
            if not query.isActive:
                ended.set()
            else:
                list_passed_over(spark, files, table)
        except Exception:  # noqa: BLE001 - whatever went wrong may be over next time
            if spark.sparkContext._jsc is None:
                return
            logging.getLogger(__name__).warning("files passed over by Spark were not listed", exc_info=True)
