"""Rule packs and presets.

A rule pack is a small DataFrame; scanning takes the rules as a plain list, since
their patterns become literals of the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.schemas import ORDERED_RULE, PRESET, RULE
from siftline.sources.files import locate
from siftline.sources.local import table_of

MAX_RULES = 20_000


def rules_from(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules given as dicts, in list order."""
    rows = [{**r, "pack_ord": 0, "rule_ord": i} for i, r in enumerate(rules)]
    return table_of(spark, rows, ORDERED_RULE)


def builtin_rules(spark: SparkSession) -> DataFrame:
    return rules_from(spark, C.BUILTIN_RULES)


def read_rules(spark: SparkSession, location: str) -> DataFrame:
    """Rules of one JSON file, or of every ``*.json`` in a directory in name order.

    A missing place gives no rules.  A file that is not a JSON array is left out, and
    named by :func:`rejected_rules`; the other files still count.
    """
    place = locate(spark, location)
    if place is None:
        return rules_from(spark, [])
    reader = spark.read.option("pathGlobFilter", "*.json") if place.is_dir else spark.read
    files = reader.text(location, wholetext=True).select(F.input_file_name().alias("file"), "value")
    pack = F.dense_rank().over(_in_order("file")) - 1
    return parse_rules(files).withColumn("pack_ord", pack).drop("file").select(*ORDERED_RULE.fieldNames())


def rejected_rules(spark: SparkSession, location: str) -> DataFrame:
    """(file, reason) of the rule files that ``read_rules`` leaves out, as a whole or in part."""
    place = locate(spark, location)
    if place is None:
        return table_of(spark, [], "file string, reason string")
    reader = spark.read.option("pathGlobFilter", "*.json") if place.is_dir else spark.read
    return rejected(reader.text(location, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def rejected(files: DataFrame) -> DataFrame:
    """(file, reason) of files given as (file, value) that hold no rules, or entries that are none."""
    rules = F.from_json("value", "array<" + RULE.simpleString() + ">")
    reason = F.when(~F.ltrim("value").startswith("["), "no JSON array").when(rules.isNull(), "not JSON")
    reason = reason.when(F.exists(rules, F.isnull), "holds entries that are no rules")
    return files.select("file", reason.alias("reason")).where("reason is not null")


def parse_rules(files: DataFrame) -> DataFrame:
    """Rules of rule files given as (file, value), with ``rule_ord``, their place in the file."""
    rules = F.from_json("value", "array<" + RULE.simpleString() + ">")
    listed = files.select("file", F.posexplode(F.when(F.ltrim("value").startswith("["), rules)).alias("pos", "rule"))
    return listed.where("rule is not null").select("file", "rule.*", F.col("pos").cast("int").alias("rule_ord"))


def _in_order(*columns: str) -> WindowSpec:
    """A whole rule pack in one group: packs are configuration of at most MAX_RULES rows."""
    return Window.partitionBy(F.lit(0)).orderBy(*columns)


def union_rules(*packs: DataFrame) -> DataFrame:
    """Packs one after the other; ids may repeat."""
    placed = [
        p.withColumn("rule_ord", F.row_number().over(_in_order("pack_ord", "rule_ord")) - 1).withColumn(
            "pack_ord", F.lit(i)
        )
        for i, p in enumerate(packs)
    ]
    whole = placed[0]
    for pack in placed[1:]:
        whole = whole.unionByName(pack)
    return whole


def rules_of(rules: DataFrame, engine: str) -> DataFrame:
    """Rules of one engine that can match: regex rules need a pattern."""
    chosen = rules.filter(F.col("type") == engine)
    return chosen.filter(F.length("pattern") > 0) if engine == "regex" else chosen


def call_selectors(rules: DataFrame) -> DataFrame:
    """Call rules with the name they look for in ``target``."""
    target = F.substring("selector", len("call:") + 1, 2**31 - 1)
    calls = rules_of(rules, "ast").filter(F.col("selector").startswith("call:"))
    return calls.withColumn("target", target).filter(F.length("target") > 0)


def filter_rules(
    rules: DataFrame, groups: list[str] | None = None, disabled: list[str] | None = None
) -> DataFrame:
    """Keep enabled groups, drop disabled ids.  No groups means no filter by group."""
    if groups:
        rules = rules.filter(F.col("group").isin(groups))
    if disabled:
        rules = rules.filter(~F.col("id").isin(disabled))
    return rules


def presets(spark: SparkSession) -> DataFrame:
    return table_of(spark, C.PRESETS, PRESET)


def apply_preset(rules: DataFrame, presets: DataFrame, name: str) -> DataFrame:
    """Rules a preset keeps; the preset table is one row per preset."""
    chosen = presets.filter(F.col("name") == name).select(
        F.col("enabled_groups").alias("groups"), F.col("disabled_rule_ids").alias("disabled")
    )
    wanted = F.array_contains("groups", "*") | F.array_contains("groups", F.col("group"))
    return rules.join(chosen, wanted & ~F.array_contains("disabled", F.col("id")), "left_semi")


def rule_list(rules: DataFrame, max_rules: int = MAX_RULES) -> list[dict]:
    """Rules on the driver, in order.  A pack is configuration, so its size is checked."""
    rows = rules.orderBy("pack_ord", "rule_ord").limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"a rule pack holds more than {max_rules} rules")
    return [r.asDict() for r in rows]
