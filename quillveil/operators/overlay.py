"""Replacements laid over a text that is cut into segments (nodes, cells, pages, channels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import placeholders as P
from ..functions import text as T

SEPARATOR = "\n\n"


def replacements(text: Column, spans: Column, key: Column) -> Column:
    """(start, end, placeholder) of each used span, in order."""
    def token(s: Column) -> Column:
        own = F.filter(key, lambda k: (k["original"] == T.surface(text, s)) & (P.label_of(k["placeholder"]) == E.label_of(s["type"], s["label"])))
        return F.element_at(own, 1)["placeholder"]

    return F.transform(F.array_sort(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), token(s).alias("placeholder")))


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def overlaid(text: Column, segments: Column, reps: Column) -> Column:
    """Each segment's new text: a placeholder stands in the segment where its value begins, the value's characters go from all."""

    def segment(s: Column) -> Column:
        own = F.filter(reps, lambda r: (r["start"] < s["end"]) & (r["end"] > s["start"]))

        def step(a: Column, r: Column) -> Column:
            token = F.when(r["start"] >= s["start"], r["placeholder"]).otherwise("")
            return F.struct(F.least(r["end"], s["end"]).cast("int").alias("at"), F.concat(a["out"], _between(text, a["at"], r["start"]), token).alias("out"))

        return F.aggregate(own, F.struct(s["start"].cast("int").alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], _between(text, a["at"], s["end"])))

    return F.transform(segments, segment)


def rewritten_range(text: Column, reps: Column, start: Column, end: Column) -> Column:
    """The range with the replacements that lie in it; null if none does."""
    inside = F.filter(reps, lambda r: (r["start"] >= start) & (r["end"] <= end))
    return F.when(F.size(inside) > 0, overlaid(text, F.array(F.struct(start.alias("start"), end.alias("end"))), inside)[0])


def in_segments(segments: DataFrame, reps: DataFrame, *keys: str) -> DataFrame:
    """The replacements that touch each segment, as rows: both sides' columns, a replacement's with the prefix r_, and whether it begins there."""
    r = reps.select(*keys, *(F.col(c).alias(f"r_{c}") for c in reps.columns if c not in keys))
    met = segments.join(r, list(keys)).where((F.col("r_start") < F.col("end")) & (F.col("r_end") > F.col("start")))
    return met.withColumn("begins", F.col("r_start") >= F.col("start"))


def one_document(pages: DataFrame, *keys: str, page: str = "page", text: str = "text", spans: str = "spans") -> DataFrame:
    """The pages of a document as one text with the spans moved: keys, text, spans. Empty pages at the front take no separator.

    A document's pages meet in one row, as it is masked as one; the source refuses documents of more than 1,000 pages.
    """
    rows = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(page, F.col(text).alias("t"), F.col(spans).alias("s")))).alias("pages"))

    def step(a: Column, p: Column) -> Column:
        some = F.length(a["text"]) > 0
        shift = F.when(some, F.length(a["text"]) + len(SEPARATOR)).otherwise(0)
        moved = F.transform(p["s"], lambda s: T.span(s["start"] + shift, s["end"] + shift, s["type"], s["score"], s["label"]))
        return F.struct(F.concat(a["text"], F.when(some, SEPARATOR).otherwise(""), p["t"]).alias("text"), F.concat(a["spans"], moved).alias("spans"))

    whole = F.aggregate("pages", F.struct(F.lit("").alias("text"), T.no_spans().alias("spans")), step)
    return rows.select(*keys, whole.alias("d")).select(*keys, F.col("d.text").alias("text"), F.col("d.spans").alias("spans"))
