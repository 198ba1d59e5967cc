"""Column functions on text, paths and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.functions.patterns import JS_SPACE


def split_lines(content: Column, crlf: bool = False) -> Column:
    """Lines of a text; a trailing line end gives a last empty line.

    With ``crlf`` a carriage return before a line feed belongs to the line end.
    """
    text = F.replace(content, F.lit("\r\n"), F.lit("\n")) if crlf else content
    return F.split(text, "\n", -1)


def trim_ws(text: Column) -> Column:
    """Strip Unicode white space, line ends and byte-order marks at both ends."""
    return F.regexp_replace(text, rf"^[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{JS_SPACE}]")


def category_slug(category: Column, prefix: str = C.DISCOVERED_PREFIX) -> Column:
    """Rule id for a free-text category."""
    dashed = F.regexp_replace(F.upper(trim_ws(category)), "[^A-Z0-9]+", "-")
    slug = F.regexp_replace(dashed, r"^-+|-+\z", "")
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(slug, F.lit("")), F.lit(C.UNKNOWN_CATEGORY)))


def extension(path: Column) -> Column:
    """Text after the last dot, empty without a dot."""
    return F.when(path.contains("."), F.substring_index(path, ".", -1)).otherwise(F.lit(""))


def is_script(path: Column) -> Column:
    """JavaScript and TypeScript files; a name that is only a suffix does not count."""
    suffixes = "|".join(s.lstrip(".") for s in C.SCRIPT_SUFFIXES)
    return path.rlike(rf"(?i)[^/]\.(?:{suffixes})\z")


def severity_rank(severity: Column) -> Column:
    """1..4; a severity nobody knows ranks highest."""
    rank = F.when(severity == "low", 1).when(severity == "medium", 2).when(severity == "high", 3)
    return rank.otherwise(4)


def severity_or_low(severity: Column) -> Column:
    return F.when(severity.isin(C.SEVERITIES), severity).otherwise(F.lit("low"))


def severity_or_null(severity: Column) -> Column:
    return F.when(severity.isin(C.SEVERITIES), severity)


def at_least(severity: Column, level: str) -> Column:
    if level not in C.SEVERITIES:
        raise ValueError(f"unknown severity {level!r}")
    return severity_rank(severity) >= C.SEVERITIES.index(level) + 1


def sarif_level(severity: Column) -> Column:
    level = F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning")
    return level.otherwise("note")


def line_or_zero(line: Column) -> Column:
    return F.coalesce(line, F.lit(0))


def signature(rule_id: Column, path: Column, line: Column, snippet: Column) -> Column:
    """Text that names a finding in a baseline."""
    return F.concat_ws(
        "|", rule_id, path, line_or_zero(line).cast("string"), F.coalesce(snippet, F.lit(""))
    )


def finding_id(path: Column, title: Column, category: Column, start: Column, end: Column) -> Column:
    parts = [path, category, F.coalesce(title, F.lit(""))]
    parts += [F.coalesce(x.cast("string"), F.lit("")) for x in (start, end)]
    return F.sha1(F.concat_ws("|", *parts))


def prompt_hash(provider: Column, model: Column, system_prompt: Column, user_prompt: Column) -> Column:
    text = F.concat_ws("|", provider, F.coalesce(model, F.lit("")), system_prompt, user_prompt)
    # never null, and said so: a join on the hash would otherwise build every
    # prompt a second time to filter out null hashes
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def title_with_scenario(title: Column, scenario: Column) -> Column:
    title = F.coalesce(title, F.lit(""))
    has_scenario = F.coalesce(scenario, F.lit("")) != ""
    return F.when(has_scenario, F.concat(title, F.lit(C.TITLE_SCENARIO_SEPARATOR), scenario)).otherwise(title)


def iso_timestamp(instant: Column) -> Column:
    """An instant as ISO 8601 text in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def context(lines: Column, line: Column, radius: int) -> Column:
    """Lines around a 1-based line, clipped to the text."""
    start = F.greatest(F.lit(1), line - radius)
    end = F.least(F.size(lines), line + radius)
    return F.array_join(F.slice(lines, start, F.greatest(F.lit(0), end - start + 1)), "\n")
