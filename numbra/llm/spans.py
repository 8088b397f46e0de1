"""Spans of regular expressions as DataFrame expressions: positions count code points, ends are exclusive.

Work on a text of n characters with k spans is n + k log k: positions are prefix sums by doubling steps, and
spans are looked up by bisection, since appending to an array within an aggregate copies it each time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that parts words.
SPACE = r"\x20\x09-\x0D"
_POWERS = [1 << k for k in range(31)]
#: The last word of a text and the first one; starts inside a word are refused, so the search is linear.
_LAST, _FIRST = rf"(?<![^{SPACE}])([^{SPACE}]++)[{SPACE}]*+\z", rf"^[{SPACE}]*+([^{SPACE}]++)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(lengths: Column) -> Column:
    """Running sums of array<int>, each step adding the value a power of two before."""

    def sums(x: Column) -> Column:
        steps = F.filter(F.array(*map(F.lit, _POWERS)), lambda s: s < F.size(x))
        return F.aggregate(steps, x, lambda acc, s: F.transform(acc, lambda v, i: v + F.coalesce(F.get(acc, i - s), F.lit(0))))

    return let(lengths, sums)


def find_spans(text: Column, pattern: str, when: Column, context: bool = False) -> Column:
    """array<struct<start int, end int, match string>> of the leftmost non-overlapping matches, in order.

    What lies between the matches gives their positions: split() and regexp_extract_all() walk the text in
    the same way. Patterns must not match the empty string. Where `when` is false or null the array is empty
    without a look at the text. With `context`, left and right are the nearest words between a match and its
    neighbours in the text, those that touch the match included; empty if there is none.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def gap(t: Column) -> Column:
        words = [F.regexp_extract(t, _LAST, 1).alias("last"), F.regexp_extract(t, _FIRST, 1).alias("first")] if context else []
        return F.struct(F.length(t).alias("n"), *words)

    def build(m: Column, g: Column) -> Column:
        def place(ends: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                sides = [F.get(g, i)["last"].alias("left"), F.get(g, i + 1)["first"].alias("right")] if context else []
                return F.struct((F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("match"), *sides)

            return F.transform(m, one)

        return let(prefix_sums(F.transform(m, lambda x, i: F.length(x) + F.get(g, i)["n"])), place)

    between = F.transform(F.split(text, pattern, -1), gap)
    shape = "array<struct<start:int,end:int,match:string" + ",left:string,right:string" * context + ">>"
    return F.when(when, let(found, lambda m: let(between, lambda g: build(m, g)))).otherwise(F.array()).cast(shape)


def apart(spans: Column, *others: Column) -> Column:
    """The spans that share no character with any of `others`; each of those is sorted and without overlaps."""

    def against(rows: Column, other: Column) -> Column:
        def kept(steps: Column) -> Column:
            def free(s: Column) -> Column:
                # how many of `other` end at or before the start, by bisection
                def step(n: Column, k: Column) -> Column:
                    return F.when((n + k <= F.size(other)) & (F.get(other, n + k - 1)["end"] <= s["start"]), n + k).otherwise(n)

                return ~F.coalesce(F.get(other, F.aggregate(steps, F.lit(0), step))["start"] < s["end"], F.lit(False))

            return F.filter(rows, free)

        steps = F.filter(F.array(*map(F.lit, reversed(_POWERS))), lambda k: k <= F.size(other))
        return F.when((F.size(rows) > 0) & (F.size(other) > 0), let(steps, kept)).otherwise(rows)

    def without(rows: Column, other: Column) -> Column:
        return let(rows, lambda x: against(x, other))

    return reduce(without, others, spans)


def labelled(spans: Column, kind: str, rank: int) -> Column:
    """array<struct<start, end, rank, kind>> of spans."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))


def join_spans(spans: Column, by_kind: bool) -> Column:
    """kind:start:end, comma-joined, by kind as ranked and then start, or by start and then kind."""
    if by_kind:
        spans = F.transform(spans, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    else:
        spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    each = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")
