"""Sets of findings: unions, order, groups, baselines, gates and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.functions.finder import find_lines
from siftline.functions.lines import has_marker
from siftline.functions.text import at_least, is_script, signature
from siftline.operators.calls import call_rules, find_sites, scan_calls
from siftline.operators.match import (
    CALL_ENGINE,
    REGEX_ENGINE,
    Search,
    check_rules,
    confirmed,
    findings_of,
    regex_rules,
    scan_regex,
)
from siftline.schemas import FINDING_COLUMNS, FINDING_ORDER


def static_findings(corpus: DataFrame, rules: list[dict], marker: str = C.IGNORE_MARKER) -> DataFrame:
    """Regex and call findings together; the same line may be found by both.

    Both engines look at a text while it is at hand, so the corpus is read once,
    however many rules there are.
    """
    regex, calls = regex_rules(rules), call_rules(rules)
    if not regex or not calls:
        return scan_regex(corpus, rules, marker).unionByName(scan_calls(corpus, rules, marker))
    check_rules(corpus, regex)
    return _joint_pass(corpus, [(k, r) for k, r, _ in regex], [search for _, _, search in regex], calls, marker)


def _joint_pass(
    corpus: DataFrame,
    regex: list[tuple[int, dict]],
    searches: list[Search],
    calls: list[tuple[int, dict, str]],
    marker: str,
) -> DataFrame:
    targets = [target for _, _, target in calls]
    looked_at = corpus.select(
        "path",
        find_lines(F.col("content"), searches).alias("lines"),
        find_sites(F.col("content"), is_script(F.col("path")), targets).alias("sites"),
    )

    def place(engine: int, at: Column, text: str, call_no: Column, tests: Column) -> Column:
        return F.struct(
            F.lit(engine).alias("engine"), at["line_no"].alias("line_no"), at[text].alias("text"),
            call_no.alias("call_no"), tests.alias("tests"),
        )

    def after_regex(tests: Column) -> Column:
        """Numbers of the call rules, after those of the regex rules."""
        return F.transform(tests, lambda i: i + len(regex))

    lines = F.transform("lines", lambda x: place(REGEX_ENGINE, x, "line", F.lit(0), x["found"]))
    sites = F.transform("sites", lambda x: place(CALL_ENGINE, x, "text", x["call_no"], after_regex(x["tests"])))
    found = looked_at.select("path", F.inline(F.concat(lines, sites)))
    found = found.withColumn("marked", has_marker(F.col("text"), marker))
    found = found.select("path", "engine", "line_no", "text", "marked", "call_no", F.explode("tests").alias("test"))
    found = found.filter(confirmed([r for _, r in regex], searches))
    by_rule = F.col("engine") == REGEX_ENGINE
    return findings_of(
        found, regex + [(k, r) for k, r, _ in calls], marker, F.col("engine"),
        F.when(by_rule, F.col("rule_no")).otherwise(F.col("call_no")),
        F.when(by_rule, F.col("line_no")).otherwise(F.col("rule_no")),
    )


def all_findings(*parts: DataFrame) -> DataFrame:
    """Findings of several sources, nothing dropped."""
    return reduce(DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts])


def order_findings(findings: DataFrame) -> DataFrame:
    """Report order.  A sort by ranges; only reports need it."""
    return findings.orderBy(*FINDING_ORDER)


def diff_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose signature is not in the baseline."""
    key = signature(F.col("rule_id"), F.col("path"), F.col("line"), F.col("snippet"))
    return findings.join(baseline, key == baseline["signature"], "left_anti")


def first_per_path(findings: DataFrame, k: int = C.FINDINGS_PER_REQUEST) -> DataFrame:
    """The first ``k`` findings of each file with their place ``ordinal`` from 0.

    Spark cuts every partition to ``k`` rows per file before the shuffle, so a
    file with very many findings is no hot spot.
    """
    order = Window.partitionBy("path").orderBy(*[c for c in FINDING_ORDER if c != "path"])
    first = findings.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return first.withColumn("ordinal", F.col("place") - 1).drop("place")


def group_by_path(findings: DataFrame, k: int = C.FINDINGS_PER_REQUEST) -> DataFrame:
    """(path, items): the first ``k`` findings of each file as an array in report order."""
    rows = first_per_path(findings, k)
    fields = [c for c in rows.columns if c not in ("path", "phase", "engine", "k1", "k2")]
    item = F.struct("ordinal", *[c for c in fields if c != "ordinal"])
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("items"))


def gate(findings: DataFrame, fail_on: str | None = None, include_discovered: bool = False) -> DataFrame:
    """One row: does a finding reach the threshold?  Without a threshold any finding does."""
    reached = at_least(F.col("severity"), fail_on) if fail_on in C.SEVERITIES else F.lit(True)
    if not include_discovered:
        reached = reached & ~F.col("rule_id").startswith(C.DISCOVERED_PREFIX)
    return findings.agg(F.coalesce(F.bool_or(reached), F.lit(False)).alias("failed"))


def scan_stats(corpus: DataFrame, findings: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """One row: files read and findings, and files that could not be read where they are known."""
    files = corpus.select(F.lit(1).alias("file"), F.lit(0).alias("issue"))
    issues = findings.select(F.lit(0).alias("file"), F.lit(1).alias("issue"))
    counts = files.unionByName(issues).agg(
        F.coalesce(F.sum("file"), F.lit(0)).alias("files_scanned"),
        F.coalesce(F.sum("issue"), F.lit(0)).alias("issues_found"),
    )
    return counts if unread is None else counts.crossJoin(unread.agg(F.count(F.lit(1)).alias("files_unread")))


def report_counts(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: the numbers at the head of a report."""
    issues = findings.select(F.lit(1).alias("issue"), F.lit(0).alias("review"))
    looks = reviews.select(F.lit(0).alias("issue"), F.lit(1).alias("review"))
    return issues.unionByName(looks).agg(
        F.coalesce(F.sum("issue"), F.lit(0)).alias("issues_found"),
        F.coalesce(F.sum("review"), F.lit(0)).alias("reviews"),
    )
