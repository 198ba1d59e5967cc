"""Zip archives as a corpus.

One pass cuts the archives into their packed entries, which are dealt out to all
tasks by name and unpacked there, so a large archive is not unpacked by one task.
What cannot be read has a row with the reason.
"""

from __future__ import annotations

import bz2
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.sources.corpus import MAX_BYTES, Files, _below, keep_path, passed_over
from siftline.sources.files import locate

_BATCH_BYTES = 8 << 20
_PACKED = pa.schema(
    [("archive", pa.string()), ("entry", pa.string()), ("method", pa.int32()), ("crc", pa.int64()), ("size", pa.int64()), ("data", pa.binary()), ("reason", pa.string())]
)
_UNPACKED = pa.schema([("path", pa.string()), ("content", pa.string()), ("reason", pa.string())])


def _reason(error: Exception) -> str:
    return str(error)[:500] or type(error).__name__


def _packed(blob: bytes, info: zipfile.ZipInfo) -> bytes:
    """The bytes of an entry as they stand in the archive."""
    if info.flag_bits & 1:
        raise ValueError("encrypted")
    if info.file_size > MAX_BYTES:
        raise ValueError("too long")
    head = blob[info.header_offset : info.header_offset + 30]
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no entry at its place")
    start = info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    data = blob[start : start + info.compress_size]
    if len(data) < info.compress_size:
        raise ValueError("cut off")
    return data


def _unpacked(method: int, crc: int, size: int, data: bytes) -> bytes:
    if method == zipfile.ZIP_STORED:
        raw = data
    elif method == zipfile.ZIP_DEFLATED:
        raw = zlib.decompressobj(-15).decompress(data, size + 1)
    elif method == zipfile.ZIP_BZIP2:
        raw = bz2.BZ2Decompressor().decompress(data, size + 1)
    elif method == zipfile.ZIP_LZMA:
        raw = zipfile.LZMADecompressor().decompress(data)
    else:
        raise ValueError(f"compression method {method}")
    if len(raw) != size or zlib.crc32(raw) != crc:
        raise ValueError("damaged")
    return raw


def _list_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for i in range(batch.num_rows):
            archive, blob = (batch.column(c)[i].as_py() for c in ("archive", "blob"))
            try:
                infos = zipfile.ZipFile(io.BytesIO(blob)).infolist()
            except Exception as error:  # noqa: BLE001 - whatever went wrong is the reason
                rows.append((archive, None, None, None, None, None, _reason(error)))
                continue
            for info in infos:
                if info.is_dir():
                    continue
                data, reason = None, None
                try:
                    data = _packed(blob, info)
                except ValueError as error:
                    reason = _reason(error)
                rows.append((archive, info.filename, info.compress_type, info.CRC, info.file_size, data, reason))
                size += len(data or b"")
                if size >= _BATCH_BYTES:
                    yield _batch(rows, _PACKED)
                    rows, size = [], 0
    if rows:
        yield _batch(rows, _PACKED)


def _unpack_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for i in range(batch.num_rows):
            archive, entry, method, crc, length, data, reason = (batch.column(c)[i].as_py() for c in _PACKED.names)
            content = None
            if reason is None:
                try:
                    content = _unpacked(method, crc, length, data).decode("utf-8", "replace")
                except Exception as error:  # noqa: BLE001 - whatever went wrong is the reason
                    reason = _reason(error)
            rows.append((archive if entry is None else f"{archive}!{entry}", content, reason))
            size += len(content or "")
            if size >= _BATCH_BYTES:
                yield _batch(rows, _UNPACKED)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _UNPACKED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archives(
    spark: SparkSession,
    location: str,
    include: list[str] | None = C.DEFAULT_INCLUDE,
    exclude: list[str] | None = C.DEFAULT_EXCLUDE,
) -> DataFrame:
    """Entries of zip files as (path, content): the corpus of :func:`read_archive_files`."""
    return read_archive_files(spark, location, include, exclude).corpus


def read_archive_files(
    spark: SparkSession,
    location: str,
    include: list[str] | None = C.DEFAULT_INCLUDE,
    exclude: list[str] | None = C.DEFAULT_EXCLUDE,
) -> Files:
    """Entries of zip files with path ``archive!entry``, and what could not be read.

    The archive is named relative to a directory, so archives of one name in two
    folders stay apart.  Globs apply to the entry name.  ``unread`` has the path of
    an entry that is encrypted or damaged, and of an archive that is none, is longer
    than ``MAX_BYTES``, is empty or has a name that Spark passes over.  Asking for
    ``unread`` reads the archives again.
    """
    place = locate(spark, location)
    if place is None:
        raise FileNotFoundError(location)
    below = _below(place) if place.is_dir else F.substring_index(_below(place), "/", -1)
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[zZ][iI][pP]").load(location)
    )
    blobs = listed.where(F.col("length") <= MAX_BYTES).select(below.alias("archive"), F.col("content").alias("blob"))
    entries = blobs.mapInArrow(_list_entries, "archive string, entry string, method int, crc long, size long, data binary, reason string")
    if include is not None:
        entries = entries.where(F.col("entry").isNull() | keep_path(F.col("entry"), include, exclude))
    entries = entries.repartition("archive", "entry").mapInArrow(_unpack_entries, "path string, content string, reason string")
    long = listed.where(F.col("length") > MAX_BYTES).select(below.alias("path"), F.lit("too long").alias("reason"))
    other = passed_over(spark, location, place, MAX_BYTES).where(F.lower("path").endswith(".zip"))
    why = F.when(F.col("length") == 0, "empty").otherwise("a name that Spark's reader passes over")
    other = other.select(F.col("path") if place.is_dir else F.substring_index("path", "/", -1).alias("path"), why.alias("reason"))
    unread = entries.where("reason IS NOT NULL").select("path", "reason").unionByName(long).unionByName(other)
    return Files(entries.where("reason IS NULL").select("path", "content"), unread)
