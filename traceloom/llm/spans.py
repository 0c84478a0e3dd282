"""Places of regex matches in a text, in DataFrame functions alone.

``split`` gives the pieces between matches and ``regexp_extract_all`` the matches; running lengths give code point offsets.
A span is struct(kind, rank, start, end, text); rank orders the kinds.

One text may hold very many matches, so nothing compares each with each or walks the text once a match: running sums are built
in blocks, overlaps are sought by binary search, and pieces of a text are cut from pages of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 256
SPAN = "struct<kind:string,rank:int,start:int,end:int,text:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The running results of ``add`` over an array of whole numbers, from 0 on.

    An array that grows by one is copied each time, so it grows by blocks of about the root of its length: n values cost about n ** 1.5.
    """

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), out.alias("out"))

    def grown(acc: Column, value: Column) -> Column:
        return let(add(acc["at"], value), lambda x: state(x, F.concat(acc["out"], F.array(x.cast("int")))))

    def over(numbers: Column) -> Column:
        n = F.size(numbers)
        each = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        empty = F.array().cast("array<int>")

        def block(acc: Column, first: Column) -> Column:
            done = F.aggregate(F.slice(numbers, first, each), state(acc["at"], empty), grown)
            return let(done, lambda b: state(b["at"], F.concat(acc["out"], b["out"])))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), each), state(F.lit(0), empty), block)["out"]

    return let(values, over)


def below(values: Column, bound: Column) -> Column:
    """How many numbers of an ascending array are smaller than ``bound``, by binary search."""

    def halve(acc: Column, _: Column) -> Column:
        def at(middle: Column) -> Column:
            # Past the end there is no value, and the upper border is met already.
            low = F.struct((middle + 1).alias("low"), acc["high"].alias("high"))
            return F.when(F.get(values, middle) < bound, low).otherwise(F.struct(acc["low"].alias("low"), middle.alias("high")))

        return let(F.floor((acc["low"] + acc["high"]) / 2).cast("int"), at)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), halve)["low"]


def found(text: Column, pattern: str, kind: str, rank: int, worth: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` (never empty ones).  ``worth``: a cheap test without which none are sought."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(m))
        ends = running(F.zip_with(pieces, m, lambda p, x: F.length(p) + F.length(x)), lambda a, n: a + n)

        def span(end: Column, match: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), (end - F.length(match)).alias("start"), end.alias("end"), match.alias("text"))

        return F.when(F.size(m) > 0, F.zip_with(ends, m, span)).otherwise(none())

    all_found = let(matches, placed)
    return all_found if worth is None else F.when(worth, all_found).otherwise(none())


def in_order(spans: Column) -> Column:
    """By start, then rank, then end."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def reach(spans: Column) -> Column:
    """Of spans by start, for each the largest end up to it."""
    return running(F.transform(spans, lambda s: s["end"]), lambda a, e: F.greatest(a, e))


def borders(spans: Column) -> Column:
    """What ``apart`` needs of spans that are sorted by start."""
    return F.struct(F.transform(spans, lambda s: s["start"]).alias("starts"), reach(spans).alias("reach"))


def apart(span: Column, others: Column) -> Column:
    """Whether ``span`` overlaps none of the spans whose ``borders`` are given."""
    last = F.get(others["reach"], below(others["starts"], span["end"]) - 1)
    return F.coalesce(last <= span["start"], F.lit(True))


def by_rank(spans: Column, ranks: int) -> Column:
    """Per rank the starts and the ends of its spans; spans of a rank must be in order and not overlap."""

    def of(own: Column) -> Column:
        return F.struct(F.transform(own, lambda s: s["start"]).alias("starts"), F.transform(own, lambda s: s["end"]).alias("ends"))

    return F.array(*[let(F.filter(spans, lambda s: s["rank"] == rank), of) for rank in range(ranks)])


def among(span: Column, ranked: Column) -> Column:
    """Whether the same span is among those of ``by_rank``."""

    def same(own: Column) -> Column:
        return let(below(own["starts"], span["start"]), lambda i: (F.get(own["starts"], i) == span["start"]) & (F.get(own["ends"], i) == span["end"]))

    return F.coalesce(let(F.get(ranked, span["rank"]), same), F.lit(False))


def pages(text: Column) -> Column:
    """The text in pages of ``PAGE`` code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def cut(paged: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` (0 is the first) of a text given in pages."""
    first = F.floor(start / PAGE).cast("int")
    few = F.slice(paged, first + 1, F.floor(length / PAGE).cast("int") + 2)
    return F.substring(F.array_join(few, ""), start - first * PAGE + 1, length)
