"""Reports: JSON, SARIF and Markdown.

Each report is first a DataFrame with one row per finding or record.  The
``*_lines`` functions put those rows and the text around them into report order;
written as text, the part files in name order make up the document.  No task
ever holds the whole report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import iso_timestamp, sarif_level
from siftline.operators.reviews import attach_reviews
from siftline.plans.materialize import keep
from siftline.schemas import FINDING_ORDER

# Member names of the JSON report, in order.
_JSON_FINDING = {
    "ruleId": "rule_id", "description": "description", "severity": "severity", "file": "path", "line": "line",
    "column": "column", "codeSnippet": "snippet", "suggestion": "suggestion", "confidence": "confidence",
}
_JSON_REVIEW = {
    "id": "id", "title": "title", "category": "category", "severity": "severity", "confidence": "confidence",
    "needsReview": "needs_review", "file": "path", "line": "line", "column": "column", "evidence": "evidence",
    "attackScenario": "attack_scenario", "fix": "fix", "safeAlternative": "safe_alternative",
    "relatedRuleIds": "related_rule_ids", "provider": "provider", "model": "model", "promptHash": "prompt_hash",
}
_SARIF_REVIEW = {
    "confidence": "confidence", "needsReview": "needs_review", "category": "category", "fix": "fix",
    "attackScenario": "attack_scenario", "provider": "provider", "model": "model", "promptHash": "prompt_hash",
}
_SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
# Where a row stands in its section; a file has one review reply per stage.
_PLACE = dict(zip(FINDING_ORDER, ["int", "string", "int", "int", "int"]))


def _object(names: dict[str, str], prefix: str = "") -> Column:
    """Struct with the report's member names; ``to_json`` leaves absent members out."""
    return F.struct(*[F.col(prefix + column).alias(name) for name, column in names.items()])


def _review_place() -> list[Column]:
    zero = F.lit(0)
    return [F.col("stage").alias("phase"), F.col("path"), zero.alias("engine"), F.col("ord").alias("k1"), zero.alias("k2")]


def json_findings(findings: DataFrame) -> DataFrame:
    """Findings as JSON objects, with the columns that order them."""
    return findings.select(*FINDING_ORDER, F.to_json(_object(_JSON_FINDING)).alias("json"))


def json_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.select(*_review_place(), F.to_json(_object(_JSON_REVIEW)).alias("json"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One rule per id with the description of its first finding, and where that stands."""
    place = F.struct(*FINDING_ORDER)
    first = findings.groupBy("rule_id").agg(F.min(F.struct(place.alias("place"), "description")).alias("first"))
    rule = F.struct(
        F.col("rule_id").alias("id"),
        F.col("rule_id").alias("name"),
        F.struct(F.col("first.description").alias("text")).alias("shortDescription"),
    )
    return first.select("rule_id", "first.place.*", F.col("first.description").alias("description"), F.to_json(rule).alias("json"))


def sarif_results(findings: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """One SARIF result per finding; the last review record on it becomes a property."""
    # line 0 and no line are both the first line
    region = F.struct(F.coalesce(F.nullif("line", F.lit(0)), F.lit(1)).alias("startLine"))
    location = F.struct(
        F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias(
            "physicalLocation"
        )
    )
    fields = [
        F.col("rule_id").alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("description").alias("text")).alias("message"),
        F.array(location).alias("locations"),
    ]
    rows = findings
    if reviews is not None:
        rows = attach_reviews(findings, reviews)
        review = F.when(F.col("review").isNotNull(), F.struct(_object(_SARIF_REVIEW, "review.").alias("llm")))
        fields.append(review.alias("properties"))
    return rows.select(*FINDING_ORDER, F.to_json(F.struct(*fields)).alias("json"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    """One Markdown section per finding."""
    text = F.concat(
        F.lit("### ["), F.upper("severity"), F.lit("] "), F.col("rule_id"),
        F.lit("\n**Description**: "), F.coalesce("description", F.lit("")),
        F.lit("\n\n**Place**: `"), F.col("path"), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("")),
        F.lit("`\n\n**Code**:\n```\n"), F.coalesce("snippet", F.lit("")),
        F.lit("\n```\n\n**Fix**: "), F.coalesce("suggestion", F.lit("")),
        F.lit("\n\n---\n"),
    )
    return findings.select(*FINDING_ORDER, text.alias("markdown"))


def markdown_reviews(reviews: DataFrame) -> DataFrame:
    """One Markdown section per review record; parts without a value are left out."""

    def part(before: str, column: str, after: str = "") -> Column:
        has_value = F.coalesce(F.col(column), F.lit("")) != ""
        return F.when(has_value, F.concat(F.lit(before), F.col(column), F.lit(after + "\n\n"))).otherwise(F.lit(""))

    text = F.concat(
        F.lit("### ["), F.upper("severity"), F.lit("] "), F.coalesce("title", F.lit("")),
        F.lit("\n**Category**: "), F.col("category"),
        F.lit("\n\n**Confidence**: "), F.col("confidence"),
        F.lit("; **Needs review**: "), F.when(F.col("needs_review"), "yes").otherwise("no"),
        F.lit("\n\n**Place**: `"), F.col("path"), F.lit(":"), F.coalesce("line", F.lit(0)).cast("string"),
        F.lit("`\n\n"),
        part("**Evidence**:\n```\n", "evidence", "\n```"),
        part("**Attack**: ", "attack_scenario"),
        part("**Fix**: ", "fix"),
        part("**Safer way**: ", "safe_alternative"),
        F.lit("---\n"),
    )
    return reviews.select(*_review_place(), text.alias("markdown"))


def _unread_rows(unread: DataFrame, text: Column) -> DataFrame:
    zero = F.lit(0)
    return unread.select(zero.alias("phase"), "path", *[zero.alias(c) for c in ("engine", "k1", "k2")], text.alias("text"))


def _fixed(rows: DataFrame, section: int, text: Column) -> DataFrame:
    """Text around the sections, one line per row of ``rows``."""
    nowhere = [F.lit(None).cast(kind).alias(name) for name, kind in _PLACE.items()]
    return rows.select(F.lit(section).alias("section"), *nowhere, text.alias("text"))


def _one(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1)


def _listed(rows: DataFrame, section: int, text: str, separator: str = "") -> DataFrame:
    """Rows of one section; the separator goes before all but the first."""
    placed = rows.select(F.lit(section).alias("section"), *[F.col(c).cast(k) for c, k in _PLACE.items()], F.col(text).alias("text"))
    if not separator:
        return placed
    place = F.struct(*_PLACE)
    first = placed.agg(F.min(place)).scalar()
    return placed.withColumn("text", F.when(place == first, F.col("text")).otherwise(F.concat(F.lit(separator), "text")))


def _document(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).orderBy("section", *_PLACE).select("text")


def _now() -> Column:
    return iso_timestamp(F.current_timestamp())


def _duration(ms: int | None) -> list[Column]:
    return [] if ms is None else [F.lit(ms).cast("long").alias("durationMs")]


def json_lines(
    findings: DataFrame,
    stats: DataFrame,
    reviews: DataFrame | None = None,
    review_stats: DataFrame | None = None,
    unread: DataFrame | None = None,
    duration_ms: int | None = None,
    review_ms: int | None = None,
) -> DataFrame:
    """The JSON report; ``stats`` and ``review_stats`` hold one row, ``unread`` (path, reason) of files.

    ``duration_ms`` and ``review_ms``, as a scan gives them, stand with the counts.
    """
    findings = keep(findings)  # several sections read it
    names = {"files_scanned": "filesScanned", "issues_found": "issuesFound", "files_unread": "filesUnread"}
    fields = [F.col(c).alias(name) for c, name in names.items() if c in stats.columns]
    counts = F.to_json(F.struct(*fields, *_duration(duration_ms)))
    head = F.concat(F.lit('{"date":"'), _now(), F.lit('","stats":'), counts)
    parts = [_fixed(stats, -3, head)]
    if unread is not None:
        file = F.to_json(F.struct(F.col("path").alias("file"), "reason"))
        parts += [
            _fixed(_one(findings), -2, F.lit(',"unread":[')),
            _listed(_unread_rows(unread, file), -1, "text", ","),
            _fixed(_one(findings), 0, F.lit('],"vulnerabilities":[')),
        ]
    else:
        parts.append(_fixed(_one(findings), 0, F.lit(',"vulnerabilities":[')))
    parts += [
        _listed(json_findings(findings), 1, "json", ","),
    ]
    if reviews is None:
        return _document([*parts, _fixed(_one(findings), 2, F.lit("]}"))])
    parts += [
        _fixed(_one(findings), 2, F.lit('],"llm":{"findings":[')),
        _listed(json_reviews(reviews), 3, "json", ","),
    ]
    if review_stats is None:
        return _document([*parts, _fixed(_one(findings), 4, F.lit("]}}"))])
    calls = F.to_json(F.struct("calls", F.col("cache_hits").alias("cacheHits"), "failures", *_duration(review_ms)))
    tail = F.concat(F.lit('],"stats":'), calls, F.lit("}}"))
    return _document([*parts, _fixed(review_stats, 4, tail)])


def sarif_lines(
    findings: DataFrame, reviews: DataFrame | None = None, tool: str = "siftline", unread: DataFrame | None = None
) -> DataFrame:
    """The SARIF 2.1.0 report: one run with the rules that were found and all results.

    Files that could not be read are notifications of the run's invocation.
    """
    findings = keep(findings)  # several sections read it
    head = (
        f'{{"$schema":"{_SARIF_SCHEMA}","version":"2.1.0",'
        f'"runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":['
    )
    parts = [
        _fixed(_one(findings), 0, F.lit(head)),
        _listed(sarif_rules(findings), 1, "json", ","),
        _fixed(_one(findings), 2, F.lit(']}},"results":[')),
        _listed(sarif_results(findings, reviews), 3, "json", ","),
    ]
    if unread is None:
        return _document([*parts, _fixed(_one(findings), 4, F.lit("]}]}"))])
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    note = F.struct(
        F.lit("error").alias("level"), F.struct(F.col("reason").alias("text")).alias("message"), F.array(place).alias("locations")
    )
    notes = '],"invocations":[{"executionSuccessful":true,"toolExecutionNotifications":['
    return _document(
        [
            *parts,
            _fixed(_one(findings), 4, F.lit(notes)),
            _listed(_unread_rows(unread, F.to_json(note)), 5, "text", ","),
            _fixed(_one(findings), 6, F.lit("]}]}]}")),
        ]
    )


def markdown_lines(
    findings: DataFrame, stats: DataFrame, reviews: DataFrame | None = None, unread: DataFrame | None = None
) -> DataFrame:
    """The Markdown report: head, findings, review records, then files that could not be read."""
    findings = keep(findings)  # several sections read it
    some = F.col("issues_found") > 0
    found = F.when(some, F.format_string("## %d problems found\n", "issues_found")).otherwise(F.lit("## No problems found\n"))
    head = F.concat(
        F.lit("# Content scan report\n\nDate: "), _now(), F.lit("\n\nFiles scanned: "), F.col("files_scanned").cast("string"), F.lit("\n")
    )
    parts = [_fixed(stats, 0, head), _fixed(stats, 2, found), _listed(markdown_rows(findings), 3, "markdown")]
    if reviews is not None:
        count = reviews.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        parts += [
            _fixed(count, 1, F.format_string("Review records: %d\n", "n")),
            _fixed(count, 4, F.lit("## Review records\n")),
            _listed(markdown_reviews(reviews), 5, "markdown"),
        ]
    if unread is not None:
        some = unread.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        file = F.concat(F.lit("- `"), F.col("path"), F.lit("`: "), F.col("reason"))
        parts += [
            _fixed(some, 6, F.format_string("## %d files could not be read\n", "n")),
            _listed(_unread_rows(unread, file), 7, "text"),
        ]
    return _document(parts)


def write_report(lines: DataFrame, location: str) -> None:
    """Write report lines as text; ``cat`` of the part files in name order is the report."""
    lines.write.mode("overwrite").text(location)
