"""The whole scan: findings, discovery, baseline, review, clean-up."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.config import ScanConfig
from siftline.operators.findings import all_findings, diff_baseline, gate, scan_stats, static_findings
from siftline.operators.replies import (
    discovered_findings,
    discovery_reviews,
    review_records,
    review_stats,
    sum_stats,
)
from siftline.operators.requests import (
    complete,
    discovery_requests,
    match_responses,
    pending_requests,
    review_requests,
)
from siftline.operators.reviews import all_reviews, keep_live_reviews
from siftline.operators.scanners import FileScanner, scan_files
from siftline.plans.materialize import keep
from siftline.schemas import RESPONSE
from siftline.sources.corpus import Files
from siftline.sources.local import table_of
from siftline.sources.responses import append_responses, latest_responses


@dataclass(frozen=True)
class ScanResult:
    findings: DataFrame
    stats: DataFrame
    """One row: files_scanned, issues_found; with ``unread`` also files_unread."""
    failed: DataFrame
    """One row: does the scan fail the gate?"""
    reviews: DataFrame | None = None
    review_stats: DataFrame | None = None
    unread: DataFrame | None = None
    """(path, reason) of files that could not be read, where the scan was given :class:`Files`."""
    scanner_errors: DataFrame | None = None
    """(path, scanner, reason) of files a :class:`FileScanner` failed on, where the scan was given some."""
    duration_ms: int = 0
    """Time from the start of the scan until its findings (and replies of a reviewer) were kept."""
    review_ms: int = 0
    """The part of it that went into requests to the reviewer and their replies."""


def scan(
    corpus: DataFrame | Files,
    rules: list[dict],
    config: ScanConfig | None = None,
    baseline: DataFrame | None = None,
    responses: DataFrame | None = None,
    ask: Callable[[str, str], str] | None = None,
    store: str | None = None,
    scanners: list[Callable[[DataFrame], DataFrame] | FileScanner] | None = None,
) -> ScanResult:
    """Scan a corpus, or the files of ``read_files``, whose unread ones are counted and returned.

    Further ``scanners`` take the corpus and return findings of their own, or look at
    one file at a time (:class:`FileScanner`); those may fail on a file without harm
    to the rest.

    With stored ``responses``, or with ``ask`` to get new ones, a model reviewer
    takes part: first it names further findings, then it comments on the findings
    the baseline leaves.  New replies are appended to ``store`` when it is given.
    """
    started, review_ms = time.monotonic(), 0
    config = config or ScanConfig()
    unread = errors = None
    if isinstance(corpus, Files):
        corpus, unread = corpus.corpus, keep(corpus.unread)  # read by the counts and every report
    found = static_findings(corpus, config.choose(rules), config.marker)
    found = all_findings(found, *[s(corpus) for s in scanners or [] if not isinstance(s, FileScanner)])
    if per_file := [s for s in scanners or [] if isinstance(s, FileScanner)]:
        more, errors = scan_files(corpus, per_file)
        found = all_findings(found, more)
    reviewed = responses is not None or ask is not None
    records, counts = [], []

    if reviewed:
        requests = discovery_requests(
            corpus, config.mode, config.radius, config.marker, config.provider, config.model,
            config.redacted, config.max_files,
        )
        answered, spent = _timed(lambda: _answer(requests, responses, ask, config, store))
        review_ms += spent
        found = all_findings(found, discovered_findings(answered))
        records.append(discovery_reviews(answered))
        counts.append(review_stats(answered, "discovery"))

    if baseline is not None:
        found = diff_baseline(found, baseline)
    found = keep(found)  # read by the counts, the review, the clean-up of records and every report
    if not reviewed:
        failed = gate(found, config.fail_on, config.include_discovered)
        stats = scan_stats(corpus, found, unread)
        return ScanResult(found, stats, failed, unread=unread, scanner_errors=errors, duration_ms=_ms_since(started))

    requests = review_requests(found, corpus, config.radius, config.provider, config.model, config.redacted)
    answered, spent = _timed(lambda: _answer(requests, responses, ask, config, store))
    review_ms += spent
    records.append(review_records(answered))
    counts.append(review_stats(answered, "review"))
    return ScanResult(
        found,
        scan_stats(corpus, found, unread),
        gate(found, config.fail_on, config.include_discovered),
        keep_live_reviews(all_reviews(*records), found),
        sum_stats(*counts),
        unread,
        errors,
        _ms_since(started),
        review_ms,
    )


def _ms_since(start: float) -> int:
    return int((time.monotonic() - start) * 1000)


def _timed(step: Callable[[], DataFrame]) -> tuple[DataFrame, int]:
    """What a step that keeps its result gives, and the milliseconds it took."""
    start = time.monotonic()
    return step(), _ms_since(start)


def _answer(
    requests: DataFrame, responses: DataFrame | None, ask: Callable | None, config: ScanConfig, store: str | None
) -> DataFrame:
    """Requests with stored and new replies."""
    if responses is None:
        responses = table_of(requests.sparkSession, [], RESPONSE)
    stored = latest_responses(responses)
    if ask is None:
        return keep(match_responses(requests, stored).withColumn("asked", F.col("cache_hit")))
    requests = keep(requests)
    new = keep(complete(pending_requests(requests, stored), ask, config.provider, config.model, config.concurrency))
    if store:
        append_responses(new, store)
    stored_hit = match_responses(requests, stored)
    fresh = new.select("prompt_hash", *[F.col(c).alias("new_" + c) for c in ("raw_text", "provider", "model")])
    joined = stored_hit.join(fresh, "prompt_hash", "left")
    for column in ("raw_text", "provider", "model"):
        joined = joined.withColumn(column, F.coalesce(column, "new_" + column)).drop("new_" + column)
    return keep(joined.withColumn("asked", F.lit(True)))
