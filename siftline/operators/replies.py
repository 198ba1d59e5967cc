"""Replies of a model reviewer to findings and review records.

All functions take requests joined with their replies, as ``match_responses``
gives them: the request carries what a reply refers to, so nothing is joined
again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline import schemas as S
from siftline.functions.replies import first_json_object, reply_content, strict_json, strip_fence
from siftline.functions.text import (
    category_slug,
    finding_id,
    line_or_zero,
    severity_or_low,
    title_with_scenario,
)
from siftline.operators.evidence import pick_evidence
from siftline.operators.match import DISCOVERY_ENGINE

_SHAPES = {"discovery": S.DISCOVERY_REPLY, "review": S.REVIEW_REPLY, "chunk": S.CHUNK_REPLY, "intent": S.INTENT_REPLY}
_LISTS = {"discovery": "findings", "review": "analyses", "chunk": "findings", "intent": "findings"}


def parse_replies(answered: DataFrame, kind: str) -> DataFrame:
    """Answered requests with the parsed ``reply`` and ``failed``.

    A reply fails when it holds no valid JSON object, when its list is no list,
    or when an entry of the list cannot be used.  A failed reply gives nothing,
    but for review replies: entries before the bad one count.
    """
    if kind in ("discovery", "review"):
        json = first_json_object(F.col("raw_text"))
    else:
        json = strict_json(strip_fence(reply_content(F.col("raw_text"))))
    rows = answered.filter(F.col("raw_text").isNotNull()).withColumn("json", json)
    rows = rows.withColumn("reply", F.from_json("json", _SHAPES[kind]))
    entries = F.get_json_object("json", "$." + _LISTS[kind])
    bad = F.col("json").isNull() | F.coalesce(~entries.startswith("["), F.lit(False))
    listed = F.col("reply")[_LISTS[kind]]
    if kind == "discovery":
        bad = bad | F.coalesce(F.exists(listed, lambda i: i.isNull() | i["category"].isNull()), F.lit(False))
    else:
        bad = bad | F.coalesce(F.exists(listed, lambda i: i.isNull()), F.lit(False))
    return rows.withColumn("failed", bad)


def _items(answered: DataFrame, kind: str, *keep: str) -> DataFrame:
    good = parse_replies(answered, kind)
    listed = F.col("reply")[_LISTS[kind]]
    if kind == "review":
        bad = F.array_min(F.transform(listed, lambda item, i: F.when(item.isNull(), i)))
        listed = F.slice(listed, F.lit(1), F.coalesce(bad, F.size(listed)))
    else:
        listed = F.when(~F.col("failed"), listed)
    return good.select("path", *keep, F.posexplode(listed).alias("ord", "item"))


def discovery_items(answered: DataFrame) -> DataFrame:
    """One row per finding in the discovery replies with the evidence block it points to."""
    rows = _items(answered, "discovery", "blocks", "provider", "model", "prompt_hash")
    start, end = F.col("item.evidenceLineStart"), F.col("item.evidenceLineEnd")
    rows = rows.withColumn("severity", severity_or_low(F.col("item.severity")))
    return rows.withColumn("evidence", pick_evidence(F.col("blocks"), start, end)["text"])


def discovered_findings(answered: DataFrame) -> DataFrame:
    """Findings named in discovery replies."""
    item = F.col("item")
    return discovery_items(answered).select(
        category_slug(item["category"]).alias("rule_id"),
        title_with_scenario(item["title"], item["attackScenario"]).alias("description"),
        "severity",
        "path",
        item["evidenceLineStart"].alias("line"),
        F.lit(None).cast("int").alias("column"),
        F.col("evidence").alias("snippet"),
        item["fix"].alias("suggestion"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(1).alias("phase"),
        F.lit(DISCOVERY_ENGINE).alias("engine"),
        F.col("ord").alias("k1"),
        F.lit(0).alias("k2"),
    )


def discovery_reviews(answered: DataFrame) -> DataFrame:
    """Review records of discovery replies."""
    item = F.col("item")
    start, end = item["evidenceLineStart"], item["evidenceLineEnd"]
    return discovery_items(answered).select(
        finding_id(F.col("path"), item["title"], item["category"], start, end).alias("id"),
        item["title"].alias("title"),
        item["category"].alias("category"),
        "severity",
        *_defaults(item),
        "path",
        start.alias("line"),
        F.lit(None).cast("int").alias("column"),
        F.coalesce("evidence", item["evidenceSummary"]).alias("evidence"),
        item["attackScenario"].alias("attack_scenario"),
        item["fix"].alias("fix"),
        item["safeAlternative"].alias("safe_alternative"),
        F.lit(None).cast("array<string>").alias("related_rule_ids"),
        "provider", "model", "prompt_hash",
        F.lit(0).alias("stage"),
        "ord",
    )


def _defaults(item: Column) -> list[Column]:
    return [
        F.coalesce(item["confidence"], F.lit("low")).alias("confidence"),
        F.coalesce(item["needsReview"], F.lit(True)).alias("needs_review"),
    ]


def review_records(answered: DataFrame) -> DataFrame:
    """Review records of review replies.  An entry with an unknown index is dropped."""
    rows = _items(answered, "review", "items", "provider", "model", "prompt_hash")
    rows = rows.withColumn("of", F.get("items", F.col("item.index"))).filter(F.col("of").isNotNull())
    item, of = F.col("item"), F.col("of")
    summary = F.coalesce(F.nullif(item["summary"], F.lit("")), of["rule_id"])
    return rows.select(
        F.concat_ws("|", of["rule_id"], "path", line_or_zero(of["line"]).cast("string")).alias("id"),
        F.concat(F.lit(C.REVIEW_TITLE_PREFIX), summary).alias("title"),
        F.coalesce(item["category"], F.lit("review")).alias("category"),
        severity_or_low(F.coalesce(item["severity"], of["severity"])).alias("severity"),
        *_defaults(item),
        "path",
        of["line"].alias("line"),
        of["column"].alias("column"),
        of["snippet"].alias("evidence"),
        item["attackScenario"].alias("attack_scenario"),
        F.coalesce(item["fix"], of["suggestion"]).alias("fix"),
        item["safeAlternative"].alias("safe_alternative"),
        F.array(of["rule_id"]).alias("related_rule_ids"),
        "provider", "model", "prompt_hash",
        F.lit(1).alias("stage"),
        "ord",
    )


def chunk_findings(answered: DataFrame, intent: bool = False) -> DataFrame:
    """Findings of chunk replies at their line in the file, with the lines around them in the chunk."""
    rows = _items(answered, "intent" if intent else "chunk", "chunk_no", "start_line", "chunk_lines")
    item, lines = F.col("item"), F.col("chunk_lines")
    offset = F.coalesce(item["lineOffset"], F.lit(0))
    start = F.greatest(F.lit(0), offset - C.CHUNK_SNIPPET_RADIUS)
    end = F.least(F.size(lines), offset + C.CHUNK_SNIPPET_RADIUS + 1)
    confidence = F.coalesce(F.nullif(item["confidence"], F.lit(0.0)), F.lit(C.DEFAULT_CHUNK_CONFIDENCE))
    return rows.select(
        item["ruleId"].alias("rule_id"),
        item["description"].alias("description"),
        item["severity"].alias("severity"),
        "path",
        (F.col("start_line") + offset).alias("line"),
        F.lit(None).cast("int").alias("column"),
        F.array_join(F.slice(lines, start + 1, F.greatest(F.lit(0), end - start)), "\n").alias("snippet"),
        item["suggestion"].alias("suggestion"),
        confidence.alias("confidence"),
        F.lit(0).alias("phase"),
        F.lit(DISCOVERY_ENGINE).alias("engine"),
        F.col("chunk_no").alias("k1"),
        F.col("ord").alias("k2"),
    )


def intent_verdicts(answered: DataFrame) -> DataFrame:
    """What intent replies say about each chunk; the reasoning only where it is not safe."""
    said = F.col("reply.intent_analysis")
    rows = parse_replies(answered, "intent").filter(~F.col("failed") & said.isNotNull())
    reasoning = F.when(said["verdict"].isin("malicious", "suspicious"), said["reasoning"])
    return rows.select(
        "path", "chunk_no", "start_line",
        F.upper(said["verdict"]).alias("verdict"),
        said["intent_mismatch"].alias("intent_mismatch"),
        said["deception_detected"].alias("deception_detected"),
        said["social_engineering"].alias("social_engineering"),
        reasoning.alias("reasoning"),
    )


def bad_replies(answered: DataFrame, kind: str) -> DataFrame:
    """Replies that could not be used, with the start of their text."""
    failed = parse_replies(answered, kind).filter("failed")
    return failed.select("prompt_hash", "path", "kind", F.substring("raw_text", 1, C.BAD_REPLY_CHARS).alias("raw_start"))


def review_stats(answered: DataFrame, kind: str) -> DataFrame:
    """One row: replies looked at, how many came from the store, how many failed.

    A request that was asked and got no reply (``asked`` without ``raw_text``)
    counts as a call and a failure; a request still pending counts as neither.
    """
    parsed = parse_replies(answered, kind).select("cache_hit", "failed")
    if "asked" in answered.columns:
        silent = answered.filter(F.col("asked") & F.col("raw_text").isNull())
        parsed = parsed.unionByName(silent.select("cache_hit", F.lit(True).alias("failed")))
    return parsed.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if("failed").alias("failures"),
    )


def sum_stats(*parts: DataFrame) -> DataFrame:
    """One row: the counters of several stages added up."""
    names = ["calls", "cache_hits", "failures"]
    together = reduce(DataFrame.unionByName, [p.select(*names) for p in parts])
    return together.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
