"""Masking of secrets in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.functions.finder import found_in
from siftline.functions.patterns import to_java, to_re2


def _steps(text: Column) -> list[Column]:
    steps = [text]
    for pattern, flags, replacement in C.REDACTIONS:
        java = ("(?i)" if "i" in flags else "") + to_java(pattern)
        steps.append(F.regexp_replace(steps[-1], java, replacement))
    return steps


def _touched(text: Column) -> Column:
    """Quick look for texts that a rewrite may change; the others are left alone."""
    return found_in(text, [to_re2(pattern) for pattern, _, _ in C.REDACTIONS])


def redact(text: Column) -> Column:
    """Text with key blocks, bearer headers, assigned secrets and web tokens masked."""
    return F.when(_touched(text), _steps(text)[-1]).otherwise(text)


def redaction_changed(text: Column) -> Column:
    """True when one of the rewrites changed its input."""
    steps = _steps(text)
    changed = F.lit(False)
    for before, after in zip(steps, steps[1:]):
        changed = changed | (before != after)
    return F.when(_touched(text), changed).otherwise(F.lit(False))
