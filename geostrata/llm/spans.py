"""Matches of a pattern with their places, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spans that an array grows by at a time.
CHUNK = 300
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def none() -> Column:
    return F.lit(None).cast(SPAN)


def spans(text: Column, pattern: str, width: int, whole: bool = False) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` in ``text`` as an array of spans.

    ``start`` and ``end`` count code points from 0. ``before`` and ``after`` hold up to ``width``
    code points between a match and the next one on that side, or with ``whole`` of the text there,
    other matches included. The text's pieces between matches and the matches themselves, each
    measured, give the places. The state of an aggregate is copied at every step, so it holds no
    more than ``CHUNK`` spans: a text with very many matches takes time in proportion to them.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none_yet = F.array().cast(SPAN)
    none_at_all = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        before = F.right(F.concat(acc["tail"], x["piece"]) if whole else x["piece"], F.lit(width))
        tail = F.right(F.concat(before, x["value"]), F.lit(width)) if whole else acc["tail"]
        end = start + F.length(x["value"])
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), x["value"].alias("value"), before.alias("before"), F.left(x["next"], F.lit(width)).alias("after"))
        return F.struct(end.cast("int").alias("at"), tail.alias("tail"), F.concat(acc["out"], F.array(span)).alias("out"))

    def ahead(acc: Column, part: Column) -> Column:
        zero = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), none_yet.alias("out"))
        return F.aggregate(part, zero, step, lambda a: F.struct(a["at"].alias("at"), a["tail"].alias("tail"), F.concat(acc["all"], F.array(a["out"])).alias("all")))

    def step_back(acc: Column, s: Column) -> Column:
        after = F.left(F.concat(s["after"], acc["head"]), F.lit(width))
        return F.struct(F.left(F.concat(s["value"], after), F.lit(width)).alias("head"), F.concat(acc["out"], F.array(s.withField("after", after))).alias("out"))

    def back(acc: Column, part: Column) -> Column:
        zero = F.struct(acc["head"].alias("head"), none_yet.alias("out"))
        return F.aggregate(F.reverse(part), zero, step_back, lambda a: F.struct(a["head"].alias("head"), F.concat(acc["all"], F.array(a["out"])).alias("all")))

    def places(z: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda c: F.slice(z, c * CHUNK + 1, F.lit(CHUNK)))
        every = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none_at_all.alias("all")), ahead, lambda a: a["all"])
        if not whole:
            return F.flatten(every)
        return F.aggregate(F.reverse(every), F.struct(F.lit("").alias("head"), none_at_all.alias("all")), back, lambda a: F.reverse(F.flatten(a["all"])))

    def zipped(x: Column) -> Column:
        n = F.size(x["m"])
        return F.arrays_zip(F.slice(x["p"], F.lit(1), n).alias("piece"), x["m"].alias("value"), F.slice(x["p"], F.lit(2), n).alias("next"))

    # variables of their own, or the text would be matched anew wherever they stand
    once = F.transform(F.array(F.struct(pieces.alias("p"), found.alias("m"))), zipped)
    return F.flatten(F.transform(once, lambda z: F.when(F.size(z) > 0, places(z)).otherwise(none_yet)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    d = F.split(F.reverse(digits), "")
    value = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.struct(F.lit(0).alias("s"), d.alias("d")),
        lambda acc, i: F.struct((acc["s"] + F.when(i % 2 == 1, F.element_at(acc["d"], i).cast("int")).otherwise((F.element_at(acc["d"], i).cast("int") * 2).cast("int") - F.when(F.element_at(acc["d"], i).cast("int") > 4, 9).otherwise(0))).cast("int").alias("s"), acc["d"].alias("d")),
        lambda acc: acc["s"],
    )
    return value % 10 == 0
