"""How document filters interact: what each removes in every order they can be applied in.

1. One pass of the byte transducer (``transducer``) counts each text; its counts say
   which of the filters on a single text it fails.  Texts are not looked at again.
2. The filter on copies fails rows whose text a row with a smaller id has.  The
   smallest id of each text is summed up before it is shuffled, and rows are matched
   to it by text and id together, so a text that very many rows share is spread by
   their ids.
3. Rows become counts by part and set of failed filters, at most 2^filters times the
   label combinations per part.  What a filter removes after others depends on the set
   of those before it only, so the counts are summed once for each filter and set, and
   every order picks its steps from these sums.

Cases: null texts are empty; a null part counts as the part with the empty name; rows
with a null id have no smaller one, are none, and have no labels.  Repeated rows with
one id are not copies of each other.  Labels that repeat count if one of them says so;
null labels say nothing.  Very long texts are counted whole, block by block.  Extra
columns are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.transducer import with_counts
from siftline.plans.materialize import keep

COPIES = "copies"  # the filter that is not a condition on counts

# The audited filters, as conditions on which a text fails
FILTERS: dict[str, str] = {
    "A": "words < 200",
    "B": "100 * distinct_words < 50 * words",
    "C": "100 * capitals > 2 * points",
    "D": "symbols > 0",
    "E": COPIES,
}
MOST_FILTERS = 7  # orders grow with the factorial


def counted(docs: DataFrame, part_col: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, part, mark, and the counts of the text); ``mark`` is the SHA-256 of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("mark"),
        text.alias("text"),
    )
    return with_counts(rows, "text")


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copies``: a row with a smaller id has the same ``mark``."""
    first = keep(rows.groupBy("mark").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null"))
    first = first.withColumn("is_first", F.lit(True)).hint("merge")
    found = rows.join(first, ["mark", "doc_id"], "left")
    return found.withColumn(COPIES, F.col("doc_id").isNotNull() & F.col("is_first").isNull()).drop("is_first")


def with_labels(rows: DataFrame, labels: DataFrame, marks: dict[str, Column], id_col: str) -> DataFrame:
    """``rows`` with one boolean for each of ``marks``, conditions on a row of ``labels``."""
    said = labels.select(F.col(id_col).alias("doc_id"), *(F.coalesce(c, F.lit(False)).alias(name) for name, c in marks.items()))
    said = keep(said.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(name).alias(name) for name in marks)))
    rows = rows.join(said.hint("merge"), "doc_id", "left")
    return rows.withColumns({name: F.coalesce(name, F.lit(False)) for name in marks})


def cells(rows: DataFrame, filters: dict[str, str], marks: list[str]) -> DataFrame:
    """(part, mask, n, and n of each mark): rows by part and failed filters, one bit each in the order given."""
    mask = F.lit(0)
    for bit, condition in enumerate(filters.values()):
        mask = mask + F.when(F.expr(condition), 1 << bit).otherwise(0)
    ones = F.count(F.lit(1)).alias("n")
    return rows.groupBy("part", mask.alias("mask")).agg(ones, *(F.count_if(F.col(m)).alias(m) for m in marks))


def interaction(cells_: DataFrame, names: list[str], marks: dict[str, str]) -> DataFrame:
    """A row for each part, order and step, from the counts of ``cells``.

    ``marks`` names the marks whose removed rows are counted, and the columns for them.
    """
    sets = [(bit, before) for bit in range(len(names)) for before in range(1 << len(names)) if not before >> bit & 1]
    pairs = F.explode(F.array(*(F.struct(F.lit(1 << b).alias("own"), F.lit(p).alias("before")) for b, p in sets)))
    each = cells_.select("*", pairs.alias("pair")).select("*", "pair.own", "pair.before").drop("pair")
    own, mask, before = F.col("own"), F.col("mask"), F.col("before")
    fails, passed = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) == 0
    orders = 1
    for i in range(2, len(names) + 1):
        orders *= i

    def total(value: str | Column, condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, value if isinstance(value, Column) else F.col(value)).otherwise(F.lit(0))).cast("long").alias(name)

    # of the filters that a row fails each is the first of them in equally many orders
    share = F.col("n") * F.floor(F.lit(orders) / F.greatest(F.bit_count(mask), F.lit(1)))
    sums = each.groupBy("part", "own", "before").agg(
        total("n", passed & ~fails, "kept"),
        total("n", passed & fails, "removed"),
        total("n", ~passed & fails, "redundant"),
        total("n", mask == own, "unique_fails"),
        *(total(mark, passed & fails, name) for mark, name in marks.items()),
        total(share, fails, "shapley"),
    )
    steps = []
    for order in permutations(range(len(names))):
        for step, bit in enumerate(order):
            steps.append(("".join(names[i] for i in order), step + 1, 1 << bit, sum(1 << i for i in order[:step])))
    # one row for each order and step, whatever the data
    table = cells_.sparkSession.createDataFrame(steps, "filter_order string, step int, own int, before int")
    columns = ["kept", "removed", "redundant", "unique_fails", *marks.values(), "shapley"]
    return sums.join(F.broadcast(table), ["own", "before"]).select("part", "filter_order", "step", *columns)


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, str] = FILTERS,
    part_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``filters`` are conditions on the counts of a text (``transducer.COUNTED``), or
    ``COPIES``, named by one letter each.
    """
    if not 1 <= len(filters) <= MOST_FILTERS or any(len(name) != 1 for name in filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter are needed")
    rows = keep(counted(docs, part_col, id_col, text_col))
    rows = with_copies(rows)
    rows = with_labels(rows, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, id_col)
    return interaction(cells(rows, filters, ["good", "toxic"]), list(filters), {"good": "good_lost", "toxic": "toxic_lost"})
