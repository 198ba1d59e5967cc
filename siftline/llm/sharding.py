"""Shards that all hold the mixture of sources, by stratified interleaving.

Rows of a source are ranked in the order of a seeded hash.  A row's place is its
fractional rank (rank + u) / n among the n rows of its source, where u in (0, 1) is
drawn for the source, so that sources of a few rows are spread as well.  Sorting all
rows by that interleaves the sources in proportion, and equal cuts of the sorted
rows are the shards: numbers of rows differ by one at most, and each source has
its share in every shard to within one row at either end.

Neither rank needs a source, or the whole table, in one task.  A source is cut by
its hash into buckets of about ``bucket_rows`` rows whose sizes are counted
first; a row's rank is that of its bucket's first row plus its place inside.
Fractional ranks are spread evenly over all their buckets, whatever the sources, and
are counted in the same way.

The law is ``rows``.  A group of equal texts has no place of its own here: its
rows are spread like all others, since a shard's number of rows is fixed.

Cases: null texts have size 1 and the checksum of the empty text; a null source
is a source of its own; rows without an id are ordered by their text; rows that
repeat are rows of their own, interchangeable.  Columns of the names added,
or of ``INSIDE``, are replaced, others pass through.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.plans.materialize import keep


ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
INSIDE = ("_source", "_hash", "_bucket", "_offset", "_of", "_rank", "_fraction", "_start", "_place")


def stratified_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 23,
    bucket_rows: int = 20_000,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs`` with size, text_crc32, law, shard, slot and grown_shard (null)."""
    n_rows = docs.count()
    buckets = max(1, -(-n_rows // bucket_rows))
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(text))
    rows = docs.select(
        *(c for c in docs.columns if c not in ADDED and c not in INSIDE),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.lit("s"), F.col(source_col).cast("string")).alias("_source"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), name)).alias("_hash"),
    ).fillna("", subset=["_source"])
    lead = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_bucket", F.floor(lead * buckets / F.lit(2.0**32)).cast("long"))

    counts = keep(rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    sources = counts.groupBy("_source").agg(F.sum("_n").alias("_of"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = offsets.join(sources, "_source")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", "text_crc32", "size")
    ranked = rows.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, ["_source", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_offset") + F.col("_place")).drop("_bucket", "_offset", "_place")
    unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("source"), "_source")), 1, 5), 16, 10).cast("double")
    ranked = ranked.withColumn("_fraction", (F.col("_rank") + (unit + 0.5) / F.lit(2.0**20)) / F.col("_of"))
    ranked = ranked.withColumn("_bucket", F.floor(F.col("_fraction") * buckets).cast("long"))

    # rows before each bucket: those before its thousand of buckets, and those inside that before it
    sizes = keep(ranked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")))
    thousand = F.expr("_bucket div 1000")
    sizes = sizes.withColumn("_thousand", thousand)
    above = Window.orderBy("_thousand").rowsBetween(Window.unboundedPreceding, -1)
    tops = sizes.groupBy("_thousand").agg(F.sum("_n").alias("_all"))
    tops = tops.select("_thousand", F.coalesce(F.sum("_all").over(above), F.lit(0)).alias("_above"))
    beside = Window.partitionBy("_thousand").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(beside), F.lit(0))).join(tops, "_thousand")
    cuts = keep(cuts.select("_bucket", (F.col("_start") + F.col("_above")).alias("_start")))
    among = Window.partitionBy("_bucket").orderBy("_fraction", "_source", "_hash", "text_crc32", "size")
    placed = ranked.withColumn("_place", F.row_number().over(among) - 1).join(cuts, "_bucket")
    placed = placed.withColumn("_place", F.col("_start") + F.col("_place"))
    shard = F.expr(f"(_place * {shards}) div {max(n_rows, 1)}")
    first = F.expr(f"(shard * {n_rows} + {shards - 1}) div {shards}")
    placed = placed.withColumn("law", F.lit("rows")).withColumn("shard", shard.cast("int"))
    placed = placed.withColumn("slot", (F.col("_place") - first).cast("long")).withColumn("grown_shard", F.lit(None).cast("int"))
    return placed.drop(*INSIDE)
