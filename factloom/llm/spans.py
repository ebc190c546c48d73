"""Spans of patterns in texts, in code points and end exclusive, with built-in functions alone.

Texts are split by a pattern and its matches taken out; the lengths of both give each match's place.
Patterns must not match the empty string and should repeat groups possessively only: then Java's
matcher neither recurses nor tries a run of characters from each of its places, however long the text is.

Running sums go over chunks and then over their totals, and texts are cut into blocks before parts are taken from them, so work
grows with the text and with the spans (but for sorting), not with their square.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"
#: Numbers of a chunk of a running sum; characters of a block of a text.
CHUNK, BLOCK = 64, 1024


def none() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def before(values: Column, zero: Column, merge: Callable[[Column, Column], Column], kind: str) -> Column:
    """For an array of `kind`, an array of what `merge`, which must be associative, makes of all before each place, `zero` at the first."""
    empty = F.array().cast(f"array<{kind}>")
    start = lambda: F.struct(zero.cast(kind).alias("at"), empty.alias("out"))
    append = lambda acc, x: F.struct(merge(acc["at"], x).cast(kind).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    size = F.size(values)
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(CHUNK)), lambda i: F.slice(values, i, F.lit(CHUNK)))
    within = F.transform(chunks, lambda chunk: F.aggregate(chunk, start(), append))

    def whole(parts):
        bases = F.aggregate(parts, start(), lambda acc, c: append(acc, c["at"]), lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, bases, lambda c, base: F.transform(c["out"], lambda x: merge(base, x).cast(kind))))

    return let(within, whole)


def running(values: Column) -> Column:
    """The sums of all numbers before each place."""
    return before(values, F.lit(0), lambda a, b: a + b, "int")


def find(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches as an array of (start, end, kind, value), value being a group of the match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("n"), m.alias("v")))
    if value_group:
        parts = F.zip_with(parts, F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), lambda p, v: F.struct(p["gap"].alias("gap"), p["n"].alias("n"), v.alias("v")))

    def placed(p):
        at = running(F.transform(p, lambda x: x["gap"] + x["n"]))
        spans = F.zip_with(p, at, lambda x, a: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["n"]).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")))
        return F.slice(spans, F.lit(1), F.size(spans) - 1)

    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(none())


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Sorted by start, then by the place of the kind in `kinds`."""
    rank = lambda s: reduce(lambda rest, i: F.when(s["kind"] == kinds[i], i).otherwise(rest), reversed(range(len(kinds))), F.lit(len(kinds)))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"])).cast(SPAN)


def _after(spans: Column) -> Column:
    """For spans sorted by start, how far those before each reach."""
    return before(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest, "int")


def apart(spans: Column, others: Column) -> Column:
    """The spans, by start, that share no place with any of `others`."""
    mark = lambda some, own: F.transform(some, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))

    def kept(every):
        # others come first of those that start together; from the left how far they reach, from the right where the next begins
        reach = before(F.transform(every, lambda s: F.when(s["own"], 0).otherwise(s["end"])), F.lit(0), F.greatest, "int")
        begin = F.reverse(before(F.reverse(F.transform(every, lambda s: F.when(s["own"], 2**31 - 1).otherwise(s["start"]))), F.lit(2**31 - 1), F.least, "int"))
        judged = F.arrays_zip(every.alias("s"), reach.alias("reach"), begin.alias("begin"))
        free = F.filter(judged, lambda x: x["s"]["own"] & (x["reach"] <= x["s"]["start"]) & (x["begin"] >= x["s"]["end"]))
        return F.transform(free, lambda x: F.struct(x["s"]["start"], x["s"]["end"], x["s"]["kind"], x["s"]["value"])).cast(SPAN)

    every = F.array_sort(F.concat(mark(spans, True), mark(others, False)))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), F.array_sort(spans)).otherwise(let(every, kept))


def replaced(text: Column, spans: Column, put: Callable[[Column], Column] = lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))) -> Column:
    """The text with each span, sorted by start, put as <KIND> or what else `put` makes of it; what an earlier span covers goes with it."""

    def between(blocks, a, b):
        first = F.floor(a / BLOCK).cast("int")
        some = F.slice(blocks, first + 1, F.floor(b / BLOCK).cast("int") - first + 1)
        return F.substring(F.array_join(some, ""), a - first * BLOCK + 1, b - a)

    def made(x):
        judged = F.arrays_zip(x["spans"].alias("s"), x["reach"].alias("reach"))
        parts = F.transform(F.filter(judged, lambda p: p["s"]["start"] >= p["reach"]), lambda p: F.concat(between(x["blocks"], p["reach"], p["s"]["start"]), put(p["s"])))
        end = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), between(x["blocks"], end, x["n"]))

    known = F.struct(
        spans.alias("spans"), _after(spans).alias("reach"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), F.length(text).alias("n")
    )
    return F.when(F.size(spans) == 0, text).otherwise(let(known, made))
