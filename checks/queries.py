"""Registered queries.  Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.planted import BASELINE_TEXT, CUSTOM_RULES, RULE_FILE_TEXT, WIDE_PACK, capital_scanner, long_corpus, planted_corpus, planted_responses
from siftline import catalogue as C
from siftline.config import ScanConfig
from siftline.functions.redact import redact, redaction_changed
from siftline.functions.text import (
    at_least,
    category_slug,
    extension,
    iso_timestamp,
    finding_id,
    is_script,
    sarif_level,
    severity_or_low,
    severity_or_null,
    severity_rank,
    split_lines,
)
from siftline.operators.calls import call_sites, scan_calls
from siftline.operators.evidence import evidence_blocks, suspicious_lines
from siftline.operators.findings import (
    all_findings,
    diff_baseline,
    first_per_path,
    gate,
    group_by_path,
    report_counts,
    scan_stats,
    static_findings,
)
from siftline.operators.lines import chunks, explode_lines
from siftline.operators.match import scan_regex
from siftline.operators.replies import (
    bad_replies,
    chunk_findings,
    discovered_findings,
    discovery_reviews,
    intent_verdicts,
    review_records,
    review_stats,
    sum_stats,
)
from siftline.operators.report import (
    json_findings,
    json_reviews,
    markdown_reviews,
    markdown_rows,
    sarif_results,
    sarif_rules,
)
from siftline.operators.requests import (
    chunk_requests,
    complete,
    discovery_requests,
    match_responses,
    pending_requests,
    review_requests,
    with_context,
)
from siftline.operators.reviews import all_reviews, attach_reviews, keep_live_reviews, last_review
from siftline.operators.scanners import FileScanner, scan_files
from siftline.plans.scan import scan
from siftline.sources.baseline import parse_baseline, signatures
from siftline.sources.corpus import corpus_from_table, dedupe_paths, limit_files, path_filter
from siftline.sources.responses import append_responses, latest_responses, read_responses
from siftline.plans.materialize import shared_folder
from siftline.sources.rules import (
    parse_rules,
    rejected,
    apply_preset,
    builtin_rules,
    call_selectors,
    filter_rules,
    presets,
    rule_list,
    rules_from,
    rules_of,
    union_rules,
)

RULES = C.BUILTIN_RULES
INLINE_RULES = [
    {"id": "DOC-001", "name": "Of", "description": "A sentence with of.", "severity": "low", "type": "regex",
     "pattern": r"\bof\b", "fix": "None.", "tags": [], "group": "docs"},
    {"id": "SEC-001", "name": "Eval again", "description": "Repeated id.", "severity": "low", "type": "regex",
     "pattern": r"eval\s*\(", "fix": None, "tags": [], "group": None},
]
LIMIT = 100

# What static findings and records fill in; regex_findings shows all columns.
FINDING = ["rule_id", "description", "severity", "path", "line", "snippet", "suggestion"]
REVIEW = [
    "id", "title", "category", "severity", "confidence", "needs_review", "path", "line", "evidence",
    "attack_scenario", "fix", "safe_alternative", "provider", "model", "prompt_hash", "stage", "ord",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return corpus_from_table(table(spark, sf_dir, "documents"), name, "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_table(table(spark, sf_dir, "pages"), "page_id", F.concat_ws("\n", "url", "html"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_table(table(spark, sf_dir, "conversations"), F.concat_ws("/", "conv_id", "turn"), "text")


def planted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return static_findings(planted_corpus(spark, sf_dir), RULES)


def long_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_regex(long_corpus(spark, sf_dir), RULES)


def known(findings: DataFrame) -> DataFrame:
    """A baseline that holds every finding of a severity other than high, some of them twice."""
    old = signatures(findings.filter("severity <> 'high'"))
    return old.unionByName(signatures(findings.filter("severity = 'critical'")))


def answered(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    if kind == "discovery":
        requests = discovery_requests(planted_corpus(spark, sf_dir))
    elif kind == "review":
        requests = review_requests(long_findings(spark, sf_dir), long_corpus(spark, sf_dir))
    else:
        requests = chunk_requests(long_corpus(spark, sf_dir), RULES, intent=kind == "intent")
    return match_responses(requests, planted_responses(requests, kind))


def _blocks(mode: str) -> Callable:
    return lambda s, d: evidence_blocks(planted_corpus(s, d).unionByName(long_corpus(s, d)), mode)


def _suspicious(mode: str) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        found = suspicious_lines(planted_corpus(s, d).unionByName(long_corpus(s, d)), mode)
        return found.select("path", F.array_join(F.transform("line_nos", lambda n: n.cast("string")), ",").alias("line_nos"))

    return run


def _requests(df: DataFrame) -> DataFrame:
    return df.select("prompt_hash", "path", "kind", "system_prompt", "user_prompt")


def q_rules_by_preset(s: SparkSession, d: str) -> DataFrame:
    found = planted_findings(s, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    packs = [apply_preset(builtin_rules(s), presets(s), p["name"]).withColumn("preset", F.lit(p["name"])) for p in C.PRESETS]
    rules = packs[0]
    for p in packs[1:]:
        rules = rules.unionByName(p)
    kept = rules.join(found, rules["id"] == found["rule_id"], "left")
    return kept.groupBy("preset").agg(
        F.count(F.lit(1)).alias("rules"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings")
    )


def q_rules_filtered(s: SparkSession, d: str) -> DataFrame:
    pack = union_rules(builtin_rules(s), rules_from(s, INLINE_RULES))
    chosen = filter_rules(pack, ["secrets", "tls", "docs"], ["SEC-210", "SEC-206"])
    return static_findings(planted_corpus(s, d), rule_list(chosen)).select(*FINDING)


def q_rule_pack_union(s: SparkSession, d: str) -> DataFrame:
    pack = rule_list(union_rules(builtin_rules(s), rules_from(s, INLINE_RULES)))
    found = scan_regex(planted_corpus(s, d), pack)
    return found.groupBy("rule_id", "description", "k1").agg(F.count(F.lit(1)).alias("n"))


def q_rules_by_engine(s: SparkSession, d: str) -> DataFrame:
    found = planted_findings(s, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    pack = builtin_rules(s)
    regex = rules_of(pack, "regex").select("id", "type", F.col("pattern").alias("looks_for"))
    calls = call_selectors(pack).select("id", "type", F.col("target").alias("looks_for"))
    counted = regex.unionByName(calls).join(found, F.col("id") == F.col("rule_id"), "left")
    return counted.select("id", "type", "looks_for", F.coalesce("n", F.lit(0)).alias("n"))


def q_suppressed_lines(s: SparkSession, d: str) -> DataFrame:
    """Findings the markers silenced: all findings without markers, less those with."""
    corpus = planted_corpus(s, d)
    every = static_findings(corpus, RULES, marker="no such marker").select("rule_id", "path", "line", "snippet", "engine")
    kept = static_findings(corpus, RULES).select("rule_id", "path", "line", "engine")
    return every.join(kept, ["rule_id", "path", "line", "engine"], "left_anti").select(*every.columns)


def q_call_sites(s: SparkSession, d: str) -> DataFrame:
    return call_sites(planted_corpus(s, d))


def q_gate(s: SparkSession, d: str) -> DataFrame:
    found = planted_findings(s, d).filter("severity <> 'critical'")
    rows = [gate(found, level).select(F.lit(level or "any").alias("fail_on"), "failed") for level in [None, *C.SEVERITIES]]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole


def q_gate_discovered(s: SparkSession, d: str) -> DataFrame:
    found = discovered_findings(answered(s, d, "discovery"))
    without = gate(found, "low").select(F.lit(False).alias("counts_discovered"), "failed")
    return without.unionByName(gate(found, "low", True).select(F.lit(True).alias("counts_discovered"), "failed"))


def q_line_context(s: SparkSession, d: str) -> DataFrame:
    corpus = planted_corpus(s, d)
    bare = scan_regex(corpus, RULES).withColumn("snippet", F.lit(None).cast("string"))
    return with_context(bare, corpus, 2).select("rule_id", "path", "line", F.col("context").alias("around"))


def q_finding_context(s: SparkSession, d: str) -> DataFrame:
    """Findings of which every other one has lost its snippet."""
    corpus = planted_corpus(s, d)
    found = scan_regex(corpus, RULES).withColumn("snippet", F.when(F.col("line") % 2 == 0, F.col("snippet")))
    return with_context(found, corpus, 2).select("rule_id", "path", "line", "context")


def q_line_chunks(s: SparkSession, d: str) -> DataFrame:
    pieces = chunks(long_corpus(s, d))
    return pieces.select("path", "chunk_no", "start_line", F.array_join("chunk_lines", "\n").alias("text"))


def q_group_by_path(s: SparkSession, d: str) -> DataFrame:
    groups = group_by_path(long_findings(s, d))
    text = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["ordinal"].cast("string"), i["rule_id"], i["line"].cast("string"))), " ")
    return groups.select("path", F.size("items").alias("n"), text.alias("items"))


def q_first_per_path(s: SparkSession, d: str) -> DataFrame:
    return first_per_path(planted_findings(s, d)).select("path", "ordinal", "rule_id", "line", "engine")


def q_redacted_documents(s: SparkSession, d: str) -> DataFrame:
    text = F.col("content")
    return planted_corpus(s, d).select("path", redact(text).alias("content"), redaction_changed(text).alias("changed"))


def q_redacted_raw_documents(s: SparkSession, d: str) -> DataFrame:
    text = F.col("content")
    rows = documents(s, d).select("path", redact(text).alias("content"), redaction_changed(text).alias("changed"))
    return rows.select("path", F.md5("content").alias("content_md5"), "changed")


def q_pending_requests(s: SparkSession, d: str) -> DataFrame:
    requests = discovery_requests(planted_corpus(s, d))
    return _requests(pending_requests(requests, planted_responses(requests, "discovery")))


def q_matched_responses(s: SparkSession, d: str) -> DataFrame:
    return answered(s, d, "discovery").select("prompt_hash", "path", "raw_text", "cache_hit")


def q_limited_files(s: SparkSession, d: str) -> DataFrame:
    corpus = path_filter(planted_corpus(s, d))
    return _requests(discovery_requests(corpus, "full", max_files=LIMIT)).select("prompt_hash", "path", "user_prompt")


def _discovery_state(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    replies = answered(s, d, "discovery")
    found = all_findings(planted_findings(s, d), discovered_findings(replies))
    return found, discovery_reviews(replies)


def _kept(found: DataFrame) -> DataFrame:
    return found.filter("severity <> 'low'")


def q_reviews_kept(s: SparkSession, d: str) -> DataFrame:
    found, records = _discovery_state(s, d)
    return keep_live_reviews(records, _kept(found)).select(*REVIEW)


def _review_state(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return long_findings(s, d), review_records(answered(s, d, "review"))


def q_last_review(s: SparkSession, d: str) -> DataFrame:
    _, records = _review_state(s, d)
    last = last_review(records)
    return last.select("key_rule", "key_path", "key_line", "review.title", "review.category", "review.severity", "review.ord")


def q_attached_reviews(s: SparkSession, d: str) -> DataFrame:
    found, records = _review_state(s, d)
    rows = attach_reviews(found, records)
    return rows.select("rule_id", "path", "line", F.col("review.category").alias("category"), F.col("review.ord").alias("ord"))


def q_sarif_results(s: SparkSession, d: str) -> DataFrame:
    return sarif_results(*_review_state(s, d))


def q_sarif_rules(s: SparkSession, d: str) -> DataFrame:
    found, _ = _discovery_state(s, d)
    return sarif_rules(found).select("rule_id", "description", "json")


def q_report_counts(s: SparkSession, d: str) -> DataFrame:
    return report_counts(*_discovery_state(s, d))


def q_review_stats(s: SparkSession, d: str) -> DataFrame:
    replies = answered(s, d, "discovery").filter("cache_hit")
    return review_stats(replies, "discovery")


def q_summed_stats(s: SparkSession, d: str) -> DataFrame:
    parts = [review_stats(answered(s, d, kind), kind) for kind in ("review", "chunk")]
    return sum_stats(*parts)


def q_bad_replies(s: SparkSession, d: str) -> DataFrame:
    parts = [bad_replies(answered(s, d, kind), kind) for kind in ("discovery", "review", "chunk")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_severity_functions(s: SparkSession, d: str) -> DataFrame:
    """Severity and category functions on event types and document columns."""
    kinds = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    cycle = F.element_at(F.array(*[F.lit(x) for x in [*C.SEVERITIES, "odd"]]), (F.col("n") % 5 + 1).cast("int"))
    rows = kinds.withColumn("severity", cycle)
    level = F.col("severity")
    return rows.select(
        "event_type", "n", "severity",
        severity_rank(level).alias("rank"),
        severity_or_low(level).alias("or_low"),
        severity_or_null(level).alias("or_null"),
        sarif_level(level).alias("sarif"),
        at_least(level, "high").alias("at_least_high"),
        category_slug(F.concat(F.lit(" -"), "event_type", F.lit("/& "))).alias("slug"),
    )


def q_path_functions(s: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    name = F.col("path")
    pages_ = table(s, d, "pages").select(url.alias("path"), F.col("page_id"))
    rows = pages_.unionByName(planted_corpus(s, d).select("path", F.lit(None).cast("bigint").alias("page_id")))
    return rows.select(
        "path", "page_id", extension(name).alias("extension"), is_script(name).alias("script"),
        finding_id(name, F.lit("T"), F.lit("c"), F.col("page_id").cast("int"), F.lit(None).cast("int")).alias("id"),
    )


def q_dedupe_paths(s: SparkSession, d: str) -> DataFrame:
    corpus = planted_corpus(s, d)
    twice = path_filter(corpus, ["**/*.js"], None).unionByName(path_filter(corpus, ["src/**"], None))
    return dedupe_paths(twice).select("path", F.octet_length("content").alias("n_bytes"))


def q_limit_files(s: SparkSession, d: str) -> DataFrame:
    return limit_files(planted_corpus(s, d), LIMIT).select("path")


def q_full_scan(s: SparkSession, d: str) -> DataFrame:
    """Filtered corpus, preset rules, baseline: findings by rule and severity."""
    config = ScanConfig.create("balanced", disabled_rule_ids=["SEC-002"])
    corpus = path_filter(planted_corpus(s, d), config.include, config.exclude)
    old = known(static_findings(corpus, RULES))
    found = scan(corpus, RULES, config, baseline=old).findings
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_reviewed_scan(s: SparkSession, d: str) -> DataFrame:
    """A scan with stored replies to the discovery requests: findings and records by rule."""
    corpus = planted_corpus(s, d)
    replies = planted_responses(discovery_requests(corpus), "discovery")
    result = scan(corpus, RULES, responses=replies)
    found = result.findings.select("rule_id", "severity", F.lit("finding").alias("kind"))
    records = result.reviews.select(category_slug(F.col("category")).alias("rule_id"), "severity", F.lit("record").alias("kind"))
    return found.unionByName(records).groupBy("kind", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_scan_by_group(s: SparkSession, d: str) -> DataFrame:
    found = planted_findings(s, d).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    groups = builtin_rules(s).select(F.col("id").alias("rule_id"), "group")
    return found.join(groups, "rule_id").groupBy("group", "severity").agg(F.sum("n").alias("n"))


def q_custom_rules(s: SparkSession, d: str) -> DataFrame:
    return scan_regex(planted_corpus(s, d), CUSTOM_RULES).select("rule_id", "path", "line")


def q_wide_rule_pack(s: SparkSession, d: str) -> DataFrame:
    """Some two thousand rules, found by the words they need, over the documents."""
    return scan_regex(documents(s, d), WIDE_PACK).select("rule_id", "path", "line")


def q_file_scanner(s: SparkSession, d: str) -> DataFrame:
    """Findings of a scanner of single files, and the files it failed on."""
    found, failed = scan_files(documents(s, d), [FileScanner("capitals", capital_scanner())])
    found = found.select("path", "rule_id", "line", "snippet", F.lit(None).cast("string").alias("reason"))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("rule_id", "string"), ("line", "int"), ("snippet", "string"))]
    return found.unionByName(failed.select("path", *nothing, "reason"))


def q_parsed_baselines(s: SparkSession, d: str) -> DataFrame:
    """Baseline documents of every layout, one made of each row of the table."""
    docs = table(s, d, "documents")
    parsed = parse_baseline(docs.select("doc_id", F.expr(BASELINE_TEXT).alias("value")))
    return parsed.select("doc_id", F.explode("items").alias("signature"))


def q_parsed_rule_files(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.expr(RULE_FILE_TEXT).alias("value"))
    return parse_rules(files).select("file", "id", "severity", "pattern", "rule_ord")


def q_latest_responses(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    stored = docs.select(
        F.col("source").alias("prompt_hash"), F.md5("text").alias("raw_text"), F.lit("p").alias("provider"),
        F.col("lang").alias("model"), F.col("doc_id").alias("stored_at"),
    )
    return latest_responses(stored)


def q_stored_responses(s: SparkSession, d: str) -> DataFrame:
    """Replies appended to a store twice, and read back: the later one of each prompt."""
    docs = table(s, d, "documents")
    place = f"{shared_folder(s)}/responses-{uuid.uuid4().hex}"
    for model in ("old", "new"):
        append_responses(
            docs.select(
                F.col("doc_id").cast("string").alias("prompt_hash"),
                F.when(F.length("text") % 5 != 0, F.md5("text")).alias("raw_text"),
                F.lit("p").alias("provider"), F.lit(model).alias("model"),
            ),
            place,
        )
    return read_responses(s, place)


def q_iso_timestamps(s: SparkSession, d: str) -> DataFrame:
    instant = F.timestamp_millis(F.col("doc_id") * 86_461_001)
    return table(s, d, "documents").select("doc_id", iso_timestamp(instant).alias("text"))


def q_rejected_rule_files(s: SparkSession, d: str) -> DataFrame:
    """Rule files made of documents: a third with an entry that is null, a third cut off, a third no array."""
    docs = table(s, d, "documents")
    shape = F.when(F.col("doc_id") % 3 == 0, F.expr(RULE_FILE_TEXT)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("[{"), F.md5("text")))
    return rejected(docs.select(F.col("doc_id").cast("string").alias("file"), shape.otherwise(F.col("text")).alias("value")))


def q_completed_requests(s: SparkSession, d: str) -> DataFrame:
    """Requests answered in the tasks by a function that counts; one kind of prompt makes it raise."""

    def ask(system_prompt: str, user_prompt: str) -> str:
        if len(user_prompt) % 7 == 0:
            raise ValueError("no answer")
        return f"{system_prompt}:{len(user_prompt)}"

    docs = table(s, d, "documents")
    asked = docs.select(F.col("doc_id").cast("string").alias("prompt_hash"), F.col("lang").alias("system_prompt"), F.col("text").alias("user_prompt"))
    return complete(asked, ask, "p", "m")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "custom_rules": q_custom_rules,
    "wide_rule_pack": q_wide_rule_pack,
    "file_scanner": q_file_scanner,
    "parsed_baselines": q_parsed_baselines,
    "parsed_rule_files": q_parsed_rule_files,
    "stored_responses": q_stored_responses,
    "iso_timestamps": q_iso_timestamps,
    "rejected_rule_files": q_rejected_rule_files,
    "latest_responses": q_latest_responses,
    "completed_requests": q_completed_requests,
    # corpus and rules
    "corpus_lines": lambda s, d: explode_lines(planted_corpus(s, d)),
    "corpus_lines_crlf": lambda s, d: explode_lines(planted_corpus(s, d), crlf=True),
    "path_filtered_corpus": lambda s, d: path_filter(planted_corpus(s, d)).select("path", F.octet_length("content").alias("n_bytes")),
    "deduped_paths": q_dedupe_paths,
    "limited_files": q_limit_files,
    "rules_by_preset": q_rules_by_preset,
    "rules_by_engine": q_rules_by_engine,
    "rules_filtered": q_rules_filtered,
    "rule_pack_union": q_rule_pack_union,
    # regex scan
    "regex_findings": lambda s, d: scan_regex(planted_corpus(s, d), RULES),
    "regex_findings_raw_docs": lambda s, d: scan_regex(documents(s, d), RULES).select(*FINDING),
    "regex_findings_conversations": lambda s, d: scan_regex(conversations(s, d), [*RULES, *INLINE_RULES]).select(*FINDING),
    "http_urls_in_pages": lambda s, d: scan_regex(pages(s, d), RULES).select(*FINDING),
    "suppressed_lines": q_suppressed_lines,
    # call scan
    "call_sites": q_call_sites,
    "call_findings": lambda s, d: scan_calls(planted_corpus(s, d), RULES).select(*FINDING),
    "static_findings": lambda s, d: planted_findings(s, d).select(*FINDING, "phase", "engine", "k2"),
    "first_findings_per_file": q_first_per_path,
    "findings_by_file": q_group_by_path,
    "findings_by_group": q_scan_by_group,
    # baseline, gate, counts
    "baseline_signatures": lambda s, d: signatures(planted_findings(s, d)),
    "new_since_baseline": lambda s, d: diff_baseline(planted_findings(s, d), known(planted_findings(s, d))).select(*FINDING),
    "gate_by_threshold": q_gate,
    "gate_with_discovered": q_gate_discovered,
    "scan_stats": lambda s, d: scan_stats(planted_corpus(s, d), planted_findings(s, d)),
    # evidence
    "suspicious_lines_targeted": _suspicious("targeted"),
    "suspicious_lines_balanced": _suspicious("balanced"),
    "suspicious_lines_full": _suspicious("full"),
    "evidence_blocks_targeted": _blocks("targeted"),
    "evidence_blocks_balanced": _blocks("balanced"),
    "evidence_blocks_full": _blocks("full"),
    "line_context": q_line_context,
    "finding_context": q_finding_context,
    "line_chunks": q_line_chunks,
    # requests
    "discovery_requests": lambda s, d: _requests(discovery_requests(planted_corpus(s, d))),
    "discovery_requests_unredacted": lambda s, d: _requests(
        discovery_requests(planted_corpus(s, d), "balanced", radius=2, model="m1", redacted=False)
    ),
    "discovery_requests_first_files": q_limited_files,
    "review_requests": lambda s, d: _requests(review_requests(long_findings(s, d), long_corpus(s, d))),
    "chunk_requests": lambda s, d: _requests(chunk_requests(long_corpus(s, d), RULES)),
    "intent_requests": lambda s, d: _requests(chunk_requests(long_corpus(s, d), RULES, intent=True)),
    "redacted_documents": q_redacted_documents,
    "redacted_raw_documents": q_redacted_raw_documents,
    "pending_requests": q_pending_requests,
    "matched_responses": q_matched_responses,
    # replies
    "discovered_findings": lambda s, d: discovered_findings(answered(s, d, "discovery")),
    "discovery_reviews": lambda s, d: discovery_reviews(answered(s, d, "discovery")).select(*REVIEW),
    "review_records": lambda s, d: review_records(answered(s, d, "review")).select(*REVIEW),
    "reviews_kept": q_reviews_kept,
    "last_reviews": q_last_review,
    "attached_reviews": q_attached_reviews,
    "review_stats": q_review_stats,
    "summed_stats": q_summed_stats,
    "chunk_findings": lambda s, d: chunk_findings(answered(s, d, "chunk")),
    "intent_verdicts": lambda s, d: intent_verdicts(answered(s, d, "intent")),
    "bad_replies": q_bad_replies,
    # reports
    "sarif_results": q_sarif_results,
    "sarif_rules": q_sarif_rules,
    "json_findings": lambda s, d: json_findings(planted_findings(s, d)).select("path", "json"),
    "json_reviews": lambda s, d: json_reviews(answered_reviews(s, d)),
    "markdown_rows": lambda s, d: markdown_rows(planted_findings(s, d)).select("path", "markdown"),
    "markdown_reviews": lambda s, d: markdown_reviews(answered_reviews(s, d)),
    "report_counts": q_report_counts,
    # functions
    "severity_functions": q_severity_functions,
    "path_functions": q_path_functions,
    # end to end
    "full_scan": q_full_scan,
    "reviewed_scan": q_reviewed_scan,
}


def answered_reviews(s: SparkSession, d: str) -> DataFrame:
    """Records of both review passes."""
    return all_reviews(discovery_reviews(answered(s, d, "discovery")), review_records(answered(s, d, "review")))
