"""What a location names, asked through the file system Spark itself uses."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession


class Place(NamedTuple):
    path: str
    """Full path without scheme and host, as in the ``path`` column after cutting them."""
    is_dir: bool
    names: list[str]
    """Names directly below a directory."""


def locate(spark: SparkSession, location: str, names: bool = False) -> Place | None:
    """None when nothing is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    is_dir = files.getFileStatus(path).isDirectory()
    below = [s.getPath().getName() for s in files.listStatus(path)] if names and is_dir else []
    return Place(files.makeQualified(path).toUri().getPath().rstrip("/"), is_dir, below)


def uri_of(spark: SparkSession, location: str) -> str:
    """The full URI of a location, as Spark itself has it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()


def all_files(spark: SparkSession, location: str) -> Iterator[tuple[str, str, int]]:
    """(URI, path without scheme and host, bytes) of every file at or below a location, hidden ones too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while found.hasNext():
        status = found.next()
        uri = status.getPath().toUri()
        yield uri.toString(), uri.getPath(), status.getLen()
