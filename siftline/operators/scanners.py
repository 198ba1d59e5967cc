"""Scanners of a caller's own that look at one file at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.plans.materialize import keep
from siftline.schemas import FINDING_COLUMNS

FILE_ENGINE = 3
HANDED_ON = 1000  # findings gathered before they leave the worker
_FINDING = pa.struct(
    [
        pa.field("rule_id", pa.string(), nullable=False),
        ("description", pa.string()), ("severity", pa.string()), ("line", pa.int32()), ("column", pa.int32()),
        ("snippet", pa.string()), ("suggestion", pa.string()), ("confidence", pa.float64()),
    ]
)
_FOUND = pa.schema(
    [("path", pa.string()), ("scanner", pa.string()), ("reason", pa.string()), ("k1", pa.int32()), ("k2", pa.int32())]
    + [pa.field(f.name, f.type) for f in _FINDING]
)
_FOUND_SQL = (
    "path string, scanner string, reason string, k1 int, k2 int, rule_id string, description string, severity string,"
    " line int, column int, snippet string, suggestion string, confidence double"
)


@dataclass(frozen=True)
class FileScanner:
    """``scan(path, content)`` gives findings as dicts: ``rule_id`` and any of description, severity, line, column,
    snippet, suggestion and confidence."""

    name: str
    scan: Callable[[str, str], Iterable[dict]]


def scan_files(corpus: DataFrame, scanners: list[FileScanner]) -> tuple[DataFrame, DataFrame]:
    """Findings of the scanners, and (path, scanner, reason) for each file on which one of them failed.

    Texts are read once for all scanners, inside their row.  A scanner that raises, or
    gives something that is no finding, loses its findings in that file only; the
    other scanners and files count.  Both results come from one kept pass.  Null
    contents are not looked at; lines with a marker are the scanner's own business.
    Findings stand after those of rules, by scanner and in the order given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                if content.is_valid:
                    text = content.as_py()
                    waiting += [r for k, s in enumerate(scanners) if (r := _look(s, k, path.as_py(), text)).num_rows]
                if sum(r.num_rows for r in waiting) >= HANDED_ON:
                    yield from _joined(waiting)
                    waiting = []
        yield from _joined(waiting)

    found = keep(corpus.select("path", "content").mapInArrow(run, _FOUND_SQL))
    places = {"phase": F.lit(0), "engine": F.lit(FILE_ENGINE)}
    findings = found.where("reason IS NULL").withColumns(places).select(*FINDING_COLUMNS)
    return findings, found.where("reason IS NOT NULL").select("path", "scanner", "reason")


def _joined(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield from pa.Table.from_batches(rows).combine_chunks().to_batches()


def _look(scanner: FileScanner, number: int, path: str, text: str) -> pa.RecordBatch:
    """What one scanner makes of one file: its findings, or a row that says why there are none."""
    start = {"path": path, "scanner": scanner.name}
    try:
        rows = [{**start, "k1": number, "k2": i, **_fields(f)} for i, f in enumerate(scanner.scan(path, text) or ())]
        return pa.RecordBatch.from_pylist(rows, _FOUND)
    except Exception as error:  # noqa: BLE001 - whatever went wrong is the reason
        return pa.RecordBatch.from_pylist([{**start, "reason": str(error)[:500] or type(error).__name__}], _FOUND)


def _fields(finding: dict) -> dict:
    if not isinstance(finding, dict) or not isinstance(finding.get("rule_id"), str):
        raise TypeError("not a finding: a dict with a rule_id is expected")
    return {f.name: finding.get(f.name) for f in _FINDING}
