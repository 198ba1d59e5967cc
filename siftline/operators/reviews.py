"""Review records next to findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import category_slug, line_or_zero
from siftline.schemas import REVIEW_COLUMNS


def all_reviews(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*REVIEW_COLUMNS) for p in parts])


def reviewed_rule() -> Column:
    """Rule a review record is about: the first one it names, else the one its category makes."""
    return F.coalesce(F.get("related_rule_ids", F.lit(0)), category_slug(F.col("category")))


def _key(rule: Column) -> list[Column]:
    return [rule.alias("key_rule"), F.col("path").alias("key_path"), line_or_zero(F.col("line")).alias("key_line")]


_KEYS = ["key_rule", "key_path", "key_line"]


def keep_live_reviews(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Records whose finding (rule, path and line) is still there."""
    live = findings.select(*_key(F.col("rule_id")))
    return reviews.select("*", *_key(reviewed_rule())).join(live, _KEYS, "left_semi").select(*reviews.columns)


def last_review(reviews: DataFrame) -> DataFrame:
    """The last record for each rule, path and line."""
    record = F.struct(*[c for c in reviews.columns])
    keyed = reviews.select(*_key(reviewed_rule()), record.alias("review"))
    return keyed.groupBy(*_KEYS).agg(F.max_by("review", F.struct("review.stage", "review.ord")).alias("review"))


def attach_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with ``review``: the last record on them, or null."""
    keyed = findings.select("*", *_key(F.col("rule_id")))
    return keyed.join(last_review(reviews), _KEYS, "left").select(*findings.columns, "review")
