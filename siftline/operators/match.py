"""Matching rules against lines."""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.functions.finder import Word, find_lines
from siftline.functions.lines import has_marker, not_suppressed
from siftline.functions.patterns import GROUP, check_patterns, index_words, literal_word, rule_regex, search_pattern
from siftline.functions.text import trim_ws
from siftline.operators.lines import explode_lines

REGEX_ENGINE, CALL_ENGINE, DISCOVERY_ENGINE = 0, 1, 2


Search = str | list[str] | Word
RegexRule = tuple[int, dict, Search]


def regex_rules(rules: list[dict]) -> list[RegexRule]:
    """(rule number, rule, what is searched for) of the rules that have a pattern.

    RE2 searches for the rules of a small pack.  With more than ``GROUP`` rules those
    that are a word or need one are indexed by it, and RE2 searches for the others.
    """
    chosen = [(k, r) for k, r in enumerate(rules) if r["type"] == "regex" and r.get("pattern")]
    indexed = len(chosen) > GROUP
    return [(k, r, indexed and _index(r["pattern"]) or search_pattern(r["pattern"])) for k, r in chosen]


def _index(pattern: str) -> Word | list[str]:
    return literal_word(pattern) or index_words(pattern)


def scan_regex(corpus: DataFrame, rules: list[dict], marker: str = C.IGNORE_MARKER) -> DataFrame:
    """Findings of all regex rules: at most one per rule and line.

    There is no shuffle.  Lines on which some rule may match are searched for in
    whole batches of texts; only those lines go on to the rules one by one.
    """
    return scan_numbered(corpus, regex_rules(rules), marker)


def scan_numbered(corpus: DataFrame, rules: list[RegexRule], marker: str) -> DataFrame:
    check_rules(corpus, rules)
    if not rules:
        return _no_findings(corpus)
    searches = [search for _, _, search in rules]
    lines = corpus.select("path", F.inline(find_lines(F.col("content"), searches)))
    lines = lines.select("path", "line_no", F.col("line").alias("text"), has_marker(F.col("line"), marker).alias("marked"), "found")
    tried = lines.select("path", "line_no", "text", "marked", F.explode("found").alias("test"))
    return _regex_findings(tried.filter(confirmed([r for _, r, _ in rules], searches)), rules, marker)


def check_rules(corpus: DataFrame, rules: list[RegexRule]) -> None:
    """Raise an error that names the first rule whose pattern is not a regex."""
    check_patterns(corpus.sparkSession, [(r["id"], r["pattern"]) for _, r, _ in rules])


def _regex_findings(tried: DataFrame, rules: list[RegexRule], marker: str) -> DataFrame:
    numbered = [(k, r) for k, r, _ in rules]
    return findings_of(tried, numbered, marker, F.lit(REGEX_ENGINE), F.col("rule_no"), F.col("line_no"))


def confirmed(rules: list[dict], searches: list[Search]) -> Column:
    """Does the rule that was picked, the one in ``test``, match as ECMAScript has it?

    The rules are constants of the query.  Up to ``GROUP`` patterns are compiled once
    per task; those of larger packs are looked up by number and compiled where they
    are tried, so the plan does not grow with the pack.  A rule that is a word was
    searched for as it is: it matches where it was found.
    """
    if len(rules) > GROUP:
        tried = [None if isinstance(search, tuple) else rule_regex(r["pattern"]) for r, search in zip(rules, searches)]
        pattern = F.get(F.from_json(F.lit(json.dumps(tried)), "array<string>"), F.col("test"))
        return pattern.isNull() | F.rlike(F.col("text"), pattern)
    cases = " ".join(f"WHEN {i} THEN {rule_matches(r)}" for i, r in enumerate(rules))
    return F.expr(f"CASE test {cases} ELSE true END")


def rule_matches(rule: dict) -> str:
    """SQL test: the pattern is found in the text of the line."""
    return f"text RLIKE {sql_text(rule_regex(rule['pattern']))}"


def sql_text(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def findings_of(
    found: DataFrame, rules: list[tuple[int, dict]], marker: str, engine: Column, k1: Column, k2: Column
) -> DataFrame:
    """Findings from (.., text, test) rows, where ``test`` is a place in ``rules``.

    A column ``marked`` tells which texts hold the marker, where rows share their text.
    """
    found = found.filter("test IS NOT NULL").withColumn("rule", F.get(_rule_table(rules), F.col("test")))
    marked = F.col("marked") if "marked" in found.columns else F.lit(True)
    found = found.filter(~marked | not_suppressed(F.col("text"), F.col("rule.rule_id"), marker))
    return to_finding(found.withColumn("rule_no", F.col("rule.rule_no")), engine, k1, k2)


def _rule_table(rules: list[tuple[int, dict]]) -> Column:
    """What a finding takes from its rule, as a constant array of the query."""
    rows = [
        {"rule_no": k, "rule_id": r["id"], "description": r.get("description"), "severity": r.get("severity"),
         "suggestion": r.get("fix")}
        for k, r in rules
    ]
    return F.from_json(F.lit(json.dumps(rows)), _RULE_TABLE)


_RULE_TABLE = "array<struct<rule_no:int,rule_id:string,description:string,severity:string,suggestion:string>>"


def to_finding(found: DataFrame, engine: Column, k1: Column, k2: Column) -> DataFrame:
    """Finding rows from (path, line_no, text, rule)."""
    return found.select(
        F.col("rule.rule_id").alias("rule_id"),
        F.col("rule.description").alias("description"),
        F.col("rule.severity").alias("severity"),
        "path",
        F.col("line_no").cast("int").alias("line"),
        F.lit(None).cast("int").alias("column"),
        trim_ws(F.col("text")).alias("snippet"),
        F.col("rule.suggestion").alias("suggestion"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(0).alias("phase"),
        engine.alias("engine"),
        k1.cast("int").alias("k1"),
        k2.cast("int").alias("k2"),
    )


def _no_findings(corpus: DataFrame) -> DataFrame:
    nothing = explode_lines(corpus.limit(0)).select("path", "line_no", F.col("line").alias("text"), F.lit(0).alias("test"))
    return _regex_findings(nothing, [(0, {"id": ""}, "")], C.IGNORE_MARKER)
