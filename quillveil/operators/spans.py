"""Interval operators on arrays of spans, inside a row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import text as T


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def in_order(spans: Column) -> Column:
    return F.array_sort(spans)


def strongest_first(spans: Column) -> Column:
    """By priority, score, length, place, then type; equal ones as they came."""
    keyed = F.transform(spans, lambda s, i: F.struct((-E.priority(s["type"])).alias("a"), (-s["score"]).alias("b"), (s["start"] - s["end"]).alias("c"), s["start"].alias("d"), E.tie_rank(s["type"]).alias("e"), s["type"].alias("f"), i.alias("g"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def resolved(spans: Column) -> Column:
    """The strongest spans that don't overlap, in order of place."""
    kept = F.aggregate(strongest_first(spans), T.no_spans(), lambda acc, s: F.when(F.exists(acc, lambda k: _overlap(k, s)), acc).otherwise(F.array_append(acc, s)))
    return in_order(kept)
