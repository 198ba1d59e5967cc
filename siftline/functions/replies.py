"""Column functions on the raw text of model replies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.text import trim_ws

# What matters when looking for the closing brace: whole strings, an opened
# string without an end, and braces.
_BRACES = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{}]', re.DOTALL)


def _no_constant(name: str):
    raise ValueError(name)


def _is_json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False
    return True


def _object_text(text: str) -> str | None:
    if text.startswith("{") and text.endswith("}"):
        return text
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for token in _BRACES.finditer(text, start):
        if token[0] == '"':
            return None
        if token[0] == "{":
            depth += 1
        elif token[0] == "}":
            depth -= 1
            if depth == 0:
                return text[start : token.end()]
    return None


# Both are marked as not deterministic so that the optimizer, when it pushes a
# filter on the result down, does not run them twice.
@F.pandas_udf(T.StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    found = (None if t is None else _object_text(t) for t in texts)
    return pd.Series([t if t is not None and _is_json(t) else None for t in found], dtype=object)


@F.pandas_udf(T.StringType())
def _strict_json(texts: pd.Series) -> pd.Series:
    return pd.Series([t if t is not None and _is_json(t) else None for t in texts], dtype=object)


def first_json_object(raw: Column) -> Column:
    """Text of the first JSON object in a reply, null when there is no valid one."""
    return _first_object.asNondeterministic()(trim_ws(raw))


def strict_json(text: Column) -> Column:
    """The text itself where it is one valid JSON value, else null.

    ``from_json`` alone also takes single quotes and text after the value.
    """
    return _strict_json.asNondeterministic()(text)


def strip_fence(raw: Column) -> Column:
    """Reply text without a Markdown code fence around it."""
    text = trim_ws(raw)
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    opened = F.regexp_replace(text, r"^```(?:json)?\s*", "")
    unfenced = F.when(inner != "", trim_ws(inner)).otherwise(opened)
    return F.when(text.startswith("```"), unfenced).otherwise(text)


def reply_content(body: Column) -> Column:
    """Reply text inside one of the known response envelopes, else the body itself."""
    quoted = F.when(trim_ws(body).startswith('"'), F.get_json_object(body, "$"))
    return F.coalesce(
        F.get_json_object(body, "$.choices[0].message.content"),
        F.get_json_object(body, "$.message.content"),
        quoted,
        body,
    )
