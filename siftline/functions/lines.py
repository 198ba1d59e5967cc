"""Predicates on one line of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.functions.patterns import any_of
from siftline.functions.text import is_blank, trim_ws


def has_marker(line: Column, marker: str = C.IGNORE_MARKER) -> Column:
    return F.lower(line).contains(marker.lower())


def not_suppressed(line: Column, rule_id: Column, marker: str = C.IGNORE_MARKER) -> Column:
    """False where a marker on the line silences the rule.

    A bare marker silences every rule.  A marker with a colon silences the rules
    it names, also those whose id starts a longer named id.
    """
    lowered = F.lower(line)
    bare = marker.lower()
    named = F.concat(F.lit(bare + ":"), F.lower(rule_id))
    silenced = F.when(lowered.contains(bare + ":"), lowered.contains(named)).otherwise(lowered.contains(bare))
    return ~F.coalesce(silenced, F.lit(False))


def is_safe_line(line: Column) -> Column:
    """Blank lines, imports and comments."""
    trimmed = trim_ws(line)
    safe = trimmed == ""
    for start in C.SAFE_LINE_STARTS:
        safe = safe | trimmed.startswith(start)
    return safe


def is_manifest(path: Column) -> Column:
    return path.endswith(C.MANIFEST_NAME)


def is_suspicious(line: Column, path: Column) -> Column:
    lowered = F.lower(line)
    manifest = F.lit(False)
    for word in C.MANIFEST_WORDS:
        manifest = manifest | lowered.contains(word)
    return F.when(is_manifest(path), manifest).otherwise(line.rlike(any_of(C.SUSPICIOUS_PATTERNS)))


def is_sampled(line_no: Column, line: Column) -> Column:
    """Every 80th line that is not blank, starting with the first."""
    return ((line_no - 1) % C.SAMPLE_EVERY == 0) & ~is_blank(line)
