"""Corpora: DataFrames of (path, content)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.functions.globs import glob_regex, name_glob
from siftline.sources.files import Place, all_files, locate
from siftline.sources.listing import can_list, files_below, store_of
from siftline.sources.local import table_of

MAX_BYTES = 2**31 - 1 - 1024
SCHEME_AND_HOST = "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def corpus_from_table(df: DataFrame, path: Column | str, text: Column | str) -> DataFrame:
    """Any table with a name and a text per row as a corpus."""
    path = F.col(path) if isinstance(path, str) else path
    text = F.col(text) if isinstance(text, str) else text
    return df.select(path.cast("string").alias("path"), text.alias("content"))


class Files(NamedTuple):
    corpus: DataFrame
    unread: DataFrame
    """(path, reason) of the files that were asked for and could not be read."""


def read_corpus(
    spark: SparkSession,
    root: str,
    include: list[str] | None = C.DEFAULT_INCLUDE,
    exclude: list[str] | None = C.DEFAULT_EXCLUDE,
) -> DataFrame:
    """Text files below a directory, or one file, all of them.

    The same rows as the corpus of :func:`read_files`, but a file that cannot be read
    fails the query, as there is no table to name it in.  That holds for files Spark
    lists whose path the globs leave out, too; ``read_files`` gets past them.
    """
    place, reader = _reader(spark, root, include)
    seen = files_as_corpus(reader.load(root), place)
    other = passed_over(spark, root, place, MAX_BYTES, include, exclude)
    if place.is_dir and include is not None:
        seen = path_filter(seen, include, exclude)
    return seen.unionByName(read_or_fail(other))


def read_files(
    spark: SparkSession,
    root: str,
    include: list[str] | None = C.DEFAULT_INCLUDE,
    exclude: list[str] | None = C.DEFAULT_EXCLUDE,
    max_bytes: int = MAX_BYTES,
) -> Files:
    """Text files below a directory, or one file, and those that cannot be read.

    Paths are relative to ``root``.  ``include=None`` reads everything, as does a
    ``root`` that is a single file.  Bytes that are not UTF-8 become U+FFFD.

    Spark's reader passes over empty files and names that start with an underscore
    or a dot.  Those are listed and read in the tasks by Arrow's file systems; where Arrow does not know the store they are among ``unread``, as are
    files of more than ``max_bytes``.  Asking for ``unread`` reads the files again.
    """
    place, reader = _reader(spark, root, include)
    listed = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    seen = files_as_corpus(listed.where(F.col("length") <= max_bytes), place)
    other = _read_passed_over(passed_over(spark, root, place, max_bytes, include, exclude))
    long = listed.where(F.col("length") > max_bytes).select("path", F.lit("too long").alias("reason"))
    skipped = listed.where(F.col("length") <= max_bytes).select("path")
    skipped = skipped.join(listed.where(F.col("content").isNotNull()).select("path"), "path", "left_anti")
    unread = long.unionByName(skipped.select("path", F.lit("unreadable").alias("reason")))
    unread = unread.select(_below(place).alias("path"), "reason")
    corpus = seen.unionByName(other.where("reason IS NULL").select("path", "content"))
    unread = unread.unionByName(other.where("reason IS NOT NULL").select("path", "reason"))
    if place.is_dir and include is not None:
        return Files(path_filter(corpus, include, exclude), path_filter(unread, include, exclude))
    return Files(corpus, unread)


def _reader(spark: SparkSession, root: str, include: list[str] | None) -> tuple[Place, DataFrameReader]:
    place = locate(spark, root)
    if place is None:
        raise FileNotFoundError(root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if place.is_dir and include and (names := name_glob(include)):
        reader = reader.option("pathGlobFilter", names)  # lists fewer files
    return place, reader


def passed_over(
    spark: SparkSession,
    root: str,
    place: Place,
    max_bytes: int,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """(uri, path, length) of the files Spark's reader does not list, that the globs select.

    Listed in the tasks; on the driver only where Arrow does not know the store, as its
    files cannot be read by the tasks either.
    """
    if place.is_dir and can_list(spark, root):
        files = files_below(spark, root, exclude if include is not None else None)
    else:
        rows = []
        for uri, full, length in all_files(spark, root):
            path = full[len(place.path) + 1 :] if place.is_dir else full
            rows.append({"uri": uri, "path": path, "length": length})
        files = table_of(spark, rows, "uri string, path string, length bigint")
    if place.is_dir and include is not None:
        files = path_filter(files, include, exclude)
    name = F.col("path") if place.is_dir else F.regexp_replace("path", "^.*/", "")
    hidden = name.rlike(r"(?:^|/)(?:\.|_[^=/]*(?:/|$))")
    length = F.when(F.col("length") <= max_bytes, F.col("length")).otherwise(F.lit(-1))
    return files.where((F.col("length") == 0) | hidden).withColumn("length", length)


def _read_passed_over(files: DataFrame) -> DataFrame:
    """(path, content, reason): either of the last two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, path, length in zip(*(batch.column(c).to_pylist() for c in ("uri", "path", "length")), strict=True):
                content, reason = "", None
                try:
                    if length < 0:
                        raise ValueError("too long")
                    if length:
                        store, place = store_of(uri)
                        with store.open_input_stream(place) as stream:
                            content = stream.read().decode("utf-8", "replace")
                except Exception as error:  # noqa: BLE001 - whatever went wrong is the reason
                    content, reason = None, str(error)[:500] or type(error).__name__
                yield pa.RecordBatch.from_pydict({"path": [path], "content": pa.array([content], pa.string()), "reason": pa.array([reason], pa.string())})

    return files.repartition("path").mapInArrow(run, "path string, content string, reason string")


def read_or_fail(files: DataFrame) -> DataFrame:
    """Rows of :func:`passed_over` as (path, content); one that cannot be read fails the query."""
    failed = F.raise_error(F.concat(F.lit("cannot read "), F.col("path"), F.lit(": "), F.col("reason")))
    content = F.when(F.col("reason").isNull(), F.col("content")).otherwise(failed.cast("string"))
    return _read_passed_over(files).select("path", content.alias("content"))


def _below(place: Place) -> Column:
    full = F.regexp_replace("path", SCHEME_AND_HOST, "")
    return F.substring(full, len(place.path) + 2, 2**31 - 1) if place.is_dir else full


def files_as_corpus(files: DataFrame, place: Place) -> DataFrame:
    """Rows of the ``binaryFile`` source as (path, content), paths relative to a directory."""
    return files.select(
        _below(place).alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def keep_path(path: Column, include: list[str], exclude: list[str] | None = None) -> Column:
    """True for a relative path that some include glob and no exclude glob matches."""
    keep = path.rlike("|".join(glob_regex(g) for g in include)) if include else F.lit(False)
    if exclude:
        keep = keep & ~path.rlike("|".join(glob_regex(g, dot=True) for g in exclude))
    return keep


def path_filter(
    corpus: DataFrame,
    include: list[str] = C.DEFAULT_INCLUDE,
    exclude: list[str] | None = C.DEFAULT_EXCLUDE,
) -> DataFrame:
    """Rows whose path the globs select.  A path counts once, however many globs match it."""
    return corpus.filter(keep_path(F.col("path"), include, exclude))


def dedupe_paths(corpus: DataFrame) -> DataFrame:
    """One row per path, for corpora put together from several reads."""
    return corpus.dropDuplicates(["path"])


def limit_files(corpus: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` files by path; all of them without a positive ``n``.

    Only paths are sorted: the last path kept becomes a filter on the corpus, so
    contents are neither shuffled nor gathered.  Paths have to be unique.
    """
    if not n or n <= 0:
        return corpus
    last = corpus.select("path").orderBy("path").limit(n).agg(F.max("path")).scalar()
    return corpus.filter(F.col("path") <= last)
