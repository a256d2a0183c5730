"""Spans of regular expressions in code points, as Column expressions.

A match is set between two sentinels, and the text is split there: every second piece is a match, and the lengths of the
pieces before it tell where it starts. Lookarounds work, and lengths count code points where Java's offsets would count
UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\u0001"


def spans(text: Column, pattern: str) -> Column:
    """The matches of a pattern as array<struct<start int, end int>>, ends exclusive. The pattern may not match the empty string."""
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK, "�")
    pieces = F.split(F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    return _walk(pieces)


def group_spans(text: Column, pattern: str) -> Column:
    """The spans of group 2 of a pattern whose match is group 1 and then group 2."""
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK, "�")
    return _walk(F.split(F.regexp_replace(clean, pattern, f"$1{_MARK}$2{_MARK}"), _MARK, -1))


def _walk(pieces: Column) -> Column:
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        found = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def piece(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points."""
    return F.substring(text, start + 1, end - start)


def around(text: Column, start: Column, end: Column, radius: int = 16) -> Column:
    """A span with what stands within ``radius`` characters of it."""
    low = F.greatest(start - radius, F.lit(0))
    return F.substring(text, low + 1, end + radius - low)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def greedy(ranked: Column, kind: str) -> Column:
    """The members of a ranked array of spans that overlap none taken before them."""
    return F.aggregate(ranked, F.array().cast(f"array<{kind}>"), lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


def overlap_pairs(spans_: Column) -> Column:
    """How many pairs of an array's spans overlap."""
    order = F.sequence(F.lit(1), F.size(spans_))
    count = lambda i: F.size(F.filter(F.slice(spans_, i + 1, F.size(spans_)), lambda y: overlap(F.element_at(spans_, i), y)))
    return F.when(F.size(spans_) < 2, F.lit(0)).otherwise(F.aggregate(order, F.lit(0), lambda s, i: s + count(i)))
