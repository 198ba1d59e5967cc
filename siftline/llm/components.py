"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.plans.materialize import keep


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge."""
    found = keep(rooted(edges, a, b))
    # kept, so that the nodes of a large component are joined to it by a plain shuffle
    lowest = keep(found.groupBy("root").agg(F.min("node").alias("low")))
    return found.join(lowest.hint("merge"), "root").select("node", F.col("low").alias("root"))


def rooted(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): one node of its component, the same for all of them, for each node that has an edge.

    Each round sends every node to the first of its neighbours and itself in the order of
    a hash, follows that once more, and goes on with the edges between what is left.  As
    that order has nothing to do with ids, what is left is a part of the nodes that does
    not depend on the shape of the graph (about a third of a path at most), so rounds
    grow with the logarithm of the nodes.  Rounds are kept, and so is what each fourth of
    them adds to the result, so plans stay small.  Firsts are summed up before they are
    shuffled, so a node with very many neighbours is never gathered in one place.
    """
    now = keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct())
    steps: list[DataFrame] = []
    while not now.isEmpty():
        ends = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        first = ends.groupBy(F.col("e.a").alias("node")).agg(F.min(_drawn(F.col("e.b"))).alias("first"))
        first = first.select("node", F.least("first", _drawn(F.col("node")))["node"].alias("root"))
        after = first.select(F.col("node").alias("root"), F.col("root").alias("next"))
        steps.append(keep(first.join(after.hint("merge"), "root").select("node", F.col("next").alias("root"))))
        for end in ("a", "b"):
            moved = steps[-1].select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
            now = now.join(moved.hint("merge"), end)
        now = keep(now.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a != b").distinct())
    if not steps:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps.pop()
    while steps:
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = steps.pop().join(later.hint("merge"), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        if len(steps) % 4 == 3:
            found = keep(found)
    return found


def _drawn(node: Column) -> Column:
    return F.struct(F.xxhash64(node).alias("draw"), node.alias("node"))
