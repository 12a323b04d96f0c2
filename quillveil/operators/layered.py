"""Documents whose text lies in layers: glyphs on pages, and channels beside them (titles of an outline, values of a form).

All layers are masked as one text with one key: a name is the same placeholder on a page, in a title and in a field. What comes out
are tables for a writer: rectangles with their placeholders, channels with their new values, and what still survives.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import document, glyphs, masking, overlay, recognizers, verify

NO_TEXT = "NO_TEXT_LAYER"


def combined(placed: DataFrame, channels: DataFrame, doc: str = "doc") -> DataFrame:
    """Per document: text (pages, then a line for each channel), body (length of the pages' text), ranges (channel, ord, start, end). Channels: doc, channel, ord, value."""
    body = glyphs.text_of(placed, doc)
    own = channels.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("channel", "ord", "value"))).alias("_c"))

    kinds = dict(channels.dtypes)
    empty = F.expr(f"cast(array() as array<struct<channel:{kinds['channel']},ord:{kinds['ord']},start:int,end:int>>)")

    def step(a, c):
        start = F.length(a["text"]) + 1
        place = F.struct(c["channel"].alias("channel"), c["ord"].alias("ord"), start.alias("start"), (start + F.length(c["value"])).alias("end"))
        return F.struct(F.concat(a["text"], F.lit("\n"), c["value"]).alias("text"), F.array_append(a["ranges"], place).alias("ranges"))

    rows = body.join(own, doc, "left")
    whole = F.aggregate(F.coalesce("_c", F.expr(f"cast(array() as array<struct<channel:{kinds['channel']},ord:{kinds['ord']},value:string>>)")), F.struct(F.col("text").alias("text"), empty.alias("ranges")), step)
    return rows.select(doc, F.length("text").alias("body"), whole.alias("w")).select(doc, "w.text", "body", "w.ranges")


@F.pandas_udf(masking._ROW)
def _healed(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        used, key, out = verify.healed(t, document.process(t, recognizers.found(t))) if t is not None else ([], [], None)
        rows.append(([dict(zip(("start", "end", "type", "score", "label"), s)) for s in used], [dict(zip(("placeholder", "original", "type"), k)) for k in key], out))
    return pd.DataFrame(rows, columns=["spans", "key", "anonymized"])


def masked(rows: DataFrame) -> DataFrame:
    """Masks, and once more what still stands in the masked text in another form; adds spans, key, anonymized, left (what survives that too) and error."""
    error = F.when(F.length(F.regexp_replace("text", f"[{T.WS}]", "")) < glyphs.LEAST_CHARS, NO_TEXT)
    out = rows.withColumn("_row", _healed("text")).select(*rows.columns, "_row.*")
    return out.withColumns({"left": verify.leaks(F.translate("anonymized", "[]", "xx"), F.transform("key", lambda k: k["original"])), "error": error})


def redacted(page_glyphs: DataFrame, channels: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc, anonymized, key, left, error), rectangles (doc, page, x0, y0, x1, y1, token), and changed channels (doc, channel, ord, value)."""
    placed = glyphs.mapped(page_glyphs, doc)
    rows = masked(combined(placed, channels, doc)).withColumn("_reps", overlay.replacements(F.col("text"), F.col("spans"), F.col("key")))
    reps = rows.select(doc, "body", F.explode("_reps").alias("r")).where(F.col("r.end") <= F.col("body")).select(doc, F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.placeholder").alias("token"))
    rects = glyphs.rectangles(glyphs.covered(placed, reps, doc), doc)
    rects = rects.join(reps.select(doc, F.col("start").alias("s_start"), "token"), [doc, "s_start"]).select(doc, "page", "x0", "y0", "x1", "y1", "token")
    new = rows.select(doc, "text", "_reps", F.explode("ranges").alias("c"))
    new = new.withColumn("value", overlay.rewritten_range(F.col("text"), F.col("_reps"), F.col("c.start"), F.col("c.end"))).where("value is not null")
    return rows.select(doc, "anonymized", "key", "left", "error"), rects, new.select(doc, F.col("c.channel").alias("channel"), F.col("c.ord").alias("ord"), "value")
