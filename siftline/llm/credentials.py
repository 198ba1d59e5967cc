"""Secrets in texts, told apart by who owns copies of them.

Patterns give candidates.  Over the whole corpus each candidate's value, as a
hash, is counted by distinct repositories and by distinct owners.  A value that
several owners hold is an example that was copied; one that a single owner holds
in few repositories, and that looks drawn at random, is live-looking.  Spans of
the base patterns are always reported; tokens in the forms of known providers are
reported as well when they are live-looking.  Column functions only.

Cases: null texts count as empty; rows that repeat are rows of their own but one
repository and owner; null repositories and owners are not counted; a hot value
is aggregated before it is shuffled and joined back by its hash.  Extra columns
are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.spans import SPANS, count_of, find_spans, joined
from siftline.plans.materialize import keep

# The base patterns.  Possessive runs and starts at the beginning
# of a run find what the plain forms find, without trying every start in a run.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{24,}+"
# Prefixes that providers publish for their tokens
PROVIDER = r"(?:ghp|gho|ghu|ghs|ghr|glpat|xoxb|xoxp|sk_live|rk_live)[_-][A-Za-z0-9_-]{16,}+"
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "provider"]
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your[_-]|x{6,}|0{8,}|1234567"


def base_spans(text: Column) -> Column:
    assign = F.filter(find_spans(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    access = F.filter(find_spans(text, ACCESS, "access"), lambda s: F.length(s["value"]) >= 20)
    return F.concat(assign, access, find_spans(text, HEX, "hex"))


def in_order(spans: Column) -> Column:
    """By start, then by kind as listed."""
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("place"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def secret_of(span: Column) -> Column:
    """What is secret in a span: the value that is assigned, or the whole match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def looks_random(value: Column) -> Column:
    """Letters and digits, at least eight different characters, no placeholder."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= 8) & ~value.rlike(PLACEHOLDER)


def ownership(candidates: DataFrame) -> DataFrame:
    """(secret, n_repos, n_owners) over all candidates, with partial sums before each shuffle."""
    counts = []
    for column, name in (("repo", "n_repos"), ("owner", "n_owners")):
        different = candidates.select("secret", column).distinct()
        counts.append(different.groupBy("secret").agg(F.count(column).alias(name)))
    # kept, so that spans are joined to it by a plain shuffle, which Spark splits at a hot secret
    return keep(counts[0].join(counts[1], "secret"))


def find_secrets(
    docs: DataFrame,
    max_owners: int = 1,
    max_repos: int = 3,
    repo_col: str = "doc_id",
    owner_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, base, found): one row per document.

    ``base`` holds the spans of the base patterns, ``found`` those and the
    live-looking provider tokens, with ``n_repos``, ``n_owners`` and ``live``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"),
        in_order(F.concat(base_spans(text), find_spans(text, PROVIDER, "provider"))).alias("spans"),
    )
    rows = keep(spans)
    each = rows.select("row_id", "repo", "owner", F.explode("spans").alias("span"))
    each = each.select("*", secret_of(F.col("span")).alias("plain"))
    each = each.select("row_id", "repo", "owner", "span", F.sha2("plain", 256).alias("secret"), looks_random(F.col("plain")).alias("random"))
    judged = each.join(ownership(each).hint("merge"), "secret").select(
        "row_id",
        F.struct(
            F.col("span.start").alias("start"),
            F.array_position(F.array(*map(F.lit, KINDS)), F.col("span.kind")).alias("place"),
            F.col("span.kind").alias("kind"),
            F.col("span.end").alias("end"),
            "n_repos",
            "n_owners",
            (F.col("random") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("live"),
        ).alias("span"),
    )
    judged = judged.groupBy("row_id").agg(F.array_sort(F.collect_list("span")).alias("found"))
    out = rows.select("row_id", "doc_id", base_of("spans").alias("base")).join(judged, "row_id", "left")
    kept = F.filter("found", lambda s: (s["kind"] != "provider") | s["live"])
    nothing = F.array().cast(out.schema["found"].dataType)
    return out.select("doc_id", "base", F.coalesce(kept, nothing).alias("found"))


def base_of(spans: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(BASE)).cast(SPANS)


def secret_columns(found: DataFrame) -> DataFrame:
    """The counts and digests of ``find_secrets``."""
    return found.select(
        "doc_id",
        *(count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )
