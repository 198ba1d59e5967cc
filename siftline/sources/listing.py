"""Files below a directory, listed in the tasks, one level of directories after the other.

Each row of a level is a directory; the next level is what the tasks find in it.  So
the driver sees no name but the root's, and a checkout with very many files is listed by
as many tasks as there are directories.  Directories that an ``exclude`` glob leaves out
with all that is in them are not gone into.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.globs import glob_regex
from siftline.plans.materialize import keep
from siftline.sources.files import uri_of
from siftline.sources.local import table_of

ENTRY = "uri string, path string, length long, is_dir boolean"


def store_of(uri: str) -> tuple[FileSystem, str]:
    """Arrow's file system for a URI of Hadoop, and the path in it."""
    if uri.startswith("file:/"):
        return LocalFileSystem(), "/" + unquote(uri.removeprefix("file:")).lstrip("/")
    return FileSystem.from_uri(uri)


def can_list(spark: SparkSession, root: str) -> bool:
    """Does Arrow know the store of ``root``?"""
    try:
        store_of(uri_of(spark, root))
    except Exception:  # noqa: BLE001 - the store is not known or not reached, whatever says so
        return False
    return True


def files_below(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(uri, path, length) of all files below a directory, empty and hidden ones too; paths relative to it.

    A directory that cannot be listed stands for its files, so that reading it tells why.
    """
    whole = [glob_regex(g, dot=True) for g in exclude or [] if g.endswith("/**")]
    level = table_of(spark, [{"uri": uri_of(spark, root), "path": "", "length": 0, "is_dir": True}], ENTRY)
    found: list[DataFrame] = []
    while True:
        below = keep(level.repartition("uri").mapInArrow(_list, ENTRY))
        found.append(below.where("not is_dir").select("uri", "path", "length"))
        level = below.where("is_dir")
        if whole:  # any name in the directory would be left out
            level = level.where(~F.concat("path", F.lit("/x")).rlike("|".join(whole)))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ENTRY.split(", ")]
    for batch in batches:
        for uri, path in zip(batch.column("uri").to_pylist(), batch.column("path").to_pylist(), strict=True):
            before = f"{path}/" if path else ""
            try:
                store, place = store_of(uri)
                entries = store.get_file_info(FileSelector(place, recursive=False))
                rows = [
                    (f"{uri.rstrip('/')}/{quote(e.base_name)}", before + e.base_name, e.size or 0, e.type == FileType.Directory)
                    for e in entries
                    if e.type != FileType.NotFound
                ]
            except Exception:  # noqa: BLE001 - the reason comes up when the entry is read
                rows = [(uri, path, 1, False)]
            for at in range(0, len(rows), 10_000):
                cells = zip(*rows[at : at + 10_000], strict=True)
                kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)
