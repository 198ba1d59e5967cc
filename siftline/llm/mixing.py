"""Mixing sources to target weights by Poisson replication.

A source with share s of the result's documents and n documents of its own gets
the mean repetition rate r = s * N / n.  Each document's number of copies is the
inverse of the Poisson distribution with mean r at a uniform number that the seed
and the document give; copies are exploded and the result is ordered by a hash of
seed, document and copy, which shuffles it over all partitions.  Rates above
``PART`` are drawn as a sum of independent parts, since exp(-r) has no room for
them.  All of it is column functions.

Weights: targets per source (need not add up to 1); sources without one get
``rest`` each, by default the mean of those given, or 1 if none is given, so the
default mixes all sources evenly.  Documents without a source are a source of
their own.  A weight of 0 leaves a source out.

Cases: rows that repeat are drawn alike (same id) and counted as rows; null ids
draw by their text; an empty table gives an empty result; columns ``copy`` and
``mix_key`` are added; columns of these names or of ``INSIDE`` are replaced, others
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.plans.materialize import keep

PART = 256.0
INSIDE = ("_parts", "_steps", "_copies", "_source")
SMALL = 10_000  # sources that are broadcast at most; checked


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the MD5 of the parts."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def poisson_steps(rate: Column) -> Column:
    """Values of the distribution function at 0, 1, .. until nothing is left of it."""
    last = (rate + 12 * F.sqrt(rate) + 30).cast("int")
    nothing = F.struct(F.exp(-rate).alias("mass"), F.exp(-rate).alias("below"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        mass = acc["mass"] * rate / k
        below = acc["below"] + mass
        return F.struct(mass.alias("mass"), below.alias("below"), F.concat(acc["steps"], F.array(below)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), nothing, step, lambda acc: acc["steps"])


def source_rates(docs: DataFrame, weights: dict[str, float], rest: float | None, size: float, source_col: str) -> DataFrame:
    """(source, rate): mean copies of a document of each source; ``size`` times the input comes out."""
    if rest is None:
        rest = sum(weights.values()) / len(weights) if weights else 1.0
    target = F.lit(float(rest))
    for name, weight in sorted(weights.items()):
        target = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(target)
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    counts = keep(counts.withColumn("weight", target))
    sums = counts.agg(F.sum("n"), F.sum("weight")).first()
    all_rows, all_weight = float(sums[0] or 0), float(sums[1] or 0) or 1.0
    rate = F.lit(float(size)) * F.col("weight") / F.lit(all_weight) * F.lit(all_rows) / F.col("n")
    return counts.select("source", "n", rate.alias("rate"))


def with_source(docs: DataFrame, table: DataFrame, source_col: str) -> DataFrame:
    """Each document with the row of its source, whatever share of all one source has.

    Sources with more than one in ``SMALL`` of all rows are fewer than ``SMALL``, so they
    are broadcast; what is left to a shuffle has no hot source.
    """
    table = table.withColumnRenamed("source", "_source")
    same = docs[source_col].cast("string").eqNullSafe(F.col("_source"))
    sums = table.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("rows")).first()
    if sums["sources"] <= SMALL:
        return docs.join(F.broadcast(table.drop("n")), same).drop("_source")
    hot = F.col("n") * SMALL > sums["rows"]
    large, others = F.broadcast(table.where(hot).drop("n")), table.where(~hot).drop("n")
    rest = docs.join(large.select("_source"), same, "left_anti").join(others.hint("merge"), same)
    return docs.join(large, same).unionByName(rest).drop("_source")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    rest: float | None = None,
    size: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Copies of the documents with ``copy`` (from 0) and ``mix_key``, in the order of that key."""
    docs = docs.drop("copy", "mix_key", *INSIDE)
    rates = source_rates(docs, weights or {}, rest, size, source_col)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    rates = rates.withColumn("_parts", parts).withColumn("_steps", poisson_steps(F.col("rate") / F.col("_parts")))
    drawn = with_source(docs, rates.select("source", "n", "_parts", "_steps"), source_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    key = F.lit(str(seed))
    draws = F.transform(
        F.sequence(F.lit(1), F.col("_parts")), lambda i: uniform(key, name, F.lit("draw"), i.cast("string"))
    )
    copies = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("_steps", lambda below: below <= u)))
    drawn = drawn.withColumn("_copies", copies).where("_copies > 0")
    exploded = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    keyed = exploded.withColumn("mix_key", F.md5(F.concat_ws("|", key, name, F.lit("place"), F.col("copy").cast("string"))))
    return keyed.drop(*INSIDE).orderBy("mix_key")
