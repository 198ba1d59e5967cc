"""Places of regular expression matches in texts, by column functions alone.

Work grows with the length of a text and its number of matches (times the logarithm of
that number, for running sums), however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,value:string>"
SPANS = f"array<{SPAN}>"
BLOCK = 1000  # code points of a block of a text, see ``blocks_of``


def no_spans() -> Column:
    return F.array().cast(SPANS)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array the items up to it, joined (a running sum, a running maximum).

    In each turn an item takes up the one twice as far before it as in the turn before.
    ``values`` has to be a lambda's variable or a column, as it is used more than once.
    """
    far = F.filter(F.array(*(F.lit(1 << i) for i in range(31))), lambda d: d < F.size(values))

    def turn(acc: Column, d: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= d, join(x, F.get(acc, i - d))).otherwise(x))

    return F.aggregate(far, values, turn)


def running_sum(values: Column) -> Column:
    return running(values, lambda x, y: x + y)


def running_max(values: Column) -> Column:
    return running(values, F.greatest)


def find_spans(text: Column, regex: str, kind: str) -> Column:
    """Leftmost non-overlapping matches in order: kind, start, end (exclusive), value.

    Places count code points.  The text between matches comes from a split at the
    same regex, so running sums of both lengths give the places.  The regex must
    not match the empty string.
    """
    gaps = F.transform(F.split(text, regex, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pairs = F.zip_with(found, gaps, lambda value, gap: F.struct(value.alias("value"), (gap + F.coalesce(F.length(value), F.lit(0))).alias("size")))

    def placed(pairs: Column) -> Column:
        return bound(F.transform(pairs, lambda p: p["size"]), lambda sizes: F.zip_with(pairs, running_sum(sizes), span))

    def span(pair: Column, end: Column) -> Column:
        value = pair["value"]
        return F.struct(F.lit(kind).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))

    # the last pair is the text after the last match
    spans = F.filter(bound(pairs, placed), lambda s: s["value"].isNotNull()).cast(SPANS)
    return F.when(text.rlike(regex), spans).otherwise(no_spans())


def blocks_of(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` code points, for ``part_of``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part_of(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text, without walking all of it from its start."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    covering = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substr(covering, start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True where the digits of the value pass the Luhn check."""
    places = F.transform(
        F.split(F.reverse(digits_of(value)), ""),
        lambda digit, i: F.when(i % 2 == 0, digit.cast("int")).otherwise(
            digit.cast("int") * 2 - F.when(digit.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(places, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlapping(spans: Column, others: Column) -> Column:
    """For each of ``spans`` whether it shares a place with one of ``others``.

    Both are put in one order, each of ``others`` by its start and each of ``spans`` by its
    end; the largest end of ``others`` so far then decides.
    """
    def event(place: Column, after: int, number: Column, start: Column, end: Column) -> Column:
        return F.struct(place.alias("place"), F.lit(after).alias("after"), number.alias("number"), start.alias("start"), end.alias("end"))

    asked = F.transform(spans, lambda s, i: event(s["end"], 0, i, s["start"], F.lit(0)))
    held = F.transform(others, lambda o: event(o["start"], 1, F.lit(-1), F.lit(0), o["end"]))

    def decided(events: Column) -> Column:
        def hits(reach: Column) -> Column:
            pairs = F.zip_with(events, reach, lambda e, r: F.struct(e["number"].alias("number"), (r > e["start"]).alias("hit")))
            return F.transform(F.array_sort(F.filter(pairs, lambda p: p["number"] >= 0)), lambda p: p["hit"])

        return bound(F.transform(events, lambda e: e["end"]), lambda x: hits(running_max(x)))

    return bound(F.array_sort(F.concat(asked, held)), decided)


def mask(text: Column, spans: Column) -> Column:
    """The text with each span (in order of start) put as <KIND>; overlapping ones as one, by the kind of the first."""

    def cut(spans: Column) -> Column:
        def fresh(reach: Column) -> Column:
            pieces = F.zip_with(
                spans,
                F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1)),
                lambda s, at: F.struct(s["kind"].alias("kind"), at.alias("at"), s["start"].alias("start")),
            )
            last = F.element_at(reach, -1)
            begun = F.filter(pieces, lambda p: p["start"] >= p["at"])

            def put(blocks: Column) -> Column:
                parts = F.transform(begun, lambda p: F.concat(part_of(blocks, p["at"], p["start"]), F.lit("<"), F.upper(p["kind"]), F.lit(">")))
                return F.concat(F.array_join(parts, ""), part_of(blocks, last, F.length(text)))

            return bound(blocks_of(text), put)

        return bound(running_max(F.transform(spans, lambda s: s["end"])), fresh)

    return F.when(F.size(spans) > 0, bound(spans, cut)).otherwise(text)
