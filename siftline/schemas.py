"""Schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

RULE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("selector", T.StringType()),
        T.StructField("fix", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("group", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# Rules in the order they are tried: packs first, then the place inside the pack.
ORDERED_RULE = T.StructType(
    [*RULE.fields, T.StructField("pack_ord", T.IntegerType()), T.StructField("rule_ord", T.IntegerType())]
)

PRESET = "name:string,fail_on:string,enabled_groups:array<string>,disabled_rule_ids:array<string>"

# phase, engine, k1 and k2 give the order findings are reported in: static
# findings per file (regex by rule and line, then calls), discovered ones last.
FINDING_COLUMNS = [
    "rule_id", "description", "severity", "path", "line", "column", "snippet", "suggestion", "confidence",
    "phase", "engine", "k1", "k2",
]
FINDING_ORDER = ["phase", "path", "engine", "k1", "k2"]

REVIEW_COLUMNS = [
    "id", "title", "category", "severity", "confidence", "needs_review", "path", "line", "column", "evidence",
    "attack_scenario", "fix", "safe_alternative", "related_rule_ids", "provider", "model", "prompt_hash",
    "stage", "ord",
]

BASELINE = "signature:string"
RESPONSE = "prompt_hash:string,raw_text:string,provider:string,model:string"

# Member names of the reply documents.
DISCOVERY_REPLY = (
    "findings array<struct<title:string,category:string,severity:string,confidence:string,needsReview:boolean,"
    "evidenceLineStart:int,evidenceLineEnd:int,evidenceSummary:string,attackScenario:string,fix:string,"
    "safeAlternative:string>>"
)
REVIEW_REPLY = (
    "analyses array<struct<index:int,category:string,severity:string,confidence:string,needsReview:boolean,"
    "falsePositive:boolean,summary:string,attackScenario:string,fix:string,safeAlternative:string>>"
)
CHUNK_REPLY = (
    "findings array<struct<ruleId:string,description:string,severity:string,lineOffset:int,suggestion:string,"
    "confidence:double>>"
)
INTENT_REPLY = (
    CHUNK_REPLY
    + ", intent_analysis struct<stated_intent:string,actual_intent:string,intent_mismatch:boolean,"
    "deception_detected:boolean,social_engineering:boolean,"
    "external_code_execution:struct<downloads:boolean,executes_downloads:boolean,sources:array<string>>,"
    "data_exfiltration:struct<sensitive_files:array<string>,env_vars_access:boolean,"
    "external_connections:array<string>>,"
    "persistence:struct<creates_services:boolean,modifies_cron:boolean,install_files:array<string>>,"
    "verdict:string,confidence:double,reasoning:string,recommendation:string>"
)
