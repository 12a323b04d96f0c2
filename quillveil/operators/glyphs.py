"""Pages as glyphs: text with the place of each character, rectangles of spans, scanned pages, and text channels beside the pages.

A glyph is a row: keys, page, line, pos, ch, quad (eight numbers). Lines are joined by one line feed, pages by two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Overlap of lines, least characters of a page with text, share of a page that an image must cover, depth of a tree.
SAME_LINE, LEAST_CHARS, IMAGE_COVER, MOST_DEPTH = 0.4, 3, 0.5, 32


def bounds(quad: Column) -> Column:
    """The upright box around a quad."""
    xs, ys = ([F.element_at(quad, k) for k in ks] for ks in ((1, 3, 5, 7), (2, 4, 6, 8)))
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def mapped(glyphs: DataFrame, *keys: str) -> DataFrame:
    """The glyphs with ``start``, the offset of each in its document's text. Lines without glyphs don't show."""
    w = Window.partitionBy(*keys).orderBy("page", "line", "pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    chars = F.coalesce(F.sum(F.length("ch")).over(before), F.lit(0))
    new_line = F.coalesce((F.lag("line").over(w) != F.col("line")) | (F.lag("page").over(w) != F.col("page")), F.lit(False)).cast("int")
    new_page = F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(False)).cast("int")
    rows = glyphs.withColumns({"_chars": chars, "_gap": new_line, "_page": new_page})
    gaps = F.sum(F.col("_gap") + F.col("_page")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", (F.col("_chars") + gaps).cast("int")).drop("_chars", "_gap", "_page")


def text_of(placed: DataFrame, *keys: str) -> DataFrame:
    """The text of each document's mapped glyphs: keys, text. A document's glyphs meet in one row, as it is detected as one."""
    rows = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", "line", "pos", "ch"))).alias("g"))

    def step(a: Column, g: Column) -> Column:
        gap = F.when(a["page"].isNull(), "").when(a["page"] != g["page"], "\n\n").when(a["line"] != g["line"], "\n").otherwise("")
        return F.struct(F.concat(a["text"], gap, g["ch"]).alias("text"), g["page"].alias("page"), g["line"].alias("line"))

    kinds = dict(placed.dtypes)
    first = F.struct(F.lit("").alias("text"), F.lit(None).cast(kinds["page"]).alias("page"), F.lit(None).cast(kinds["line"]).alias("line"))
    return rows.select(*keys, F.aggregate("g", first, step, lambda a: a["text"]).alias("text"))


def covered(placed: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """The glyphs of each span, one a distinct quad: keys, s_start, s_end, page, start, quad. Spans: keys, start, end."""
    s = spans.select(*keys, F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    met = placed.join(s, list(keys)).where((F.col("start") < F.col("s_end")) & (F.col("start") + F.length("ch") > F.col("s_start")))
    return met.groupBy(*keys, "s_start", "s_end", "page", "quad").agg(F.min("start").alias("start"))


def rectangles(quads: DataFrame, *keys: str) -> DataFrame:
    """One rectangle for each run of a span's quads on one line: keys, s_start, s_end, nth, page, x0, y0, x1, y1."""
    rows = quads.groupBy(*keys, "s_start", "s_end").agg(F.array_sort(F.collect_list(F.struct("start", "page", bounds(F.col("quad")).alias("b")))).alias("q"))
    box = "struct<page:int,x0:double,y0:double,x1:double,y1:double>"

    def step(acc: Column, q: Column) -> Column:
        last, b = F.try_element_at(acc, F.lit(-1)), q["b"]
        overlap = F.least(last["y1"], b["y1"]) - F.greatest(last["y0"], b["y0"])
        same = (last["page"] == q["page"]) & (overlap > SAME_LINE * F.least(last["y1"] - last["y0"], b["y1"] - b["y0"]))
        fresh = F.struct(q["page"].cast("int").alias("page"), *(b[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
        wide = F.struct(last["page"].alias("page"), F.least(last["x0"], b["x0"]).alias("x0"), F.least(last["y0"], b["y0"]).alias("y0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1"))
        return F.when(F.coalesce(same, F.lit(False)), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), wide)).otherwise(F.array_append(acc, fresh))

    out = rows.select(*keys, "s_start", "s_end", F.posexplode(F.aggregate("q", F.expr(f"cast(array() as array<{box}>)"), step)).alias("nth", "r"))
    return out.select(*keys, "s_start", "s_end", "nth", "r.*")


def scanned_pages(pages: DataFrame, glyphs: DataFrame, images: DataFrame, *keys: str) -> DataFrame:
    """Per page: chars (not blank), cover (largest image's share of the page), image_only. Pages: keys, page, area; images: keys, page, area."""
    on = [*keys, "page"]
    chars = glyphs.where(F.trim("ch") != "").groupBy(*on).agg(F.count("*").alias("chars"))
    largest = images.groupBy(*on).agg(F.max("area").alias("image"))
    out = pages.join(chars, on, "left").join(largest, on, "left")
    out = out.select(*on, F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce(F.col("image") / F.greatest(F.col("area"), F.lit(1.0)), F.lit(0.0)).alias("cover"))
    return out.withColumn("image_only", (F.col("chars") < LEAST_CHARS) & (F.col("cover") >= IMAGE_COVER))


def scanned(classified: DataFrame, *keys: str) -> DataFrame:
    """Per document whether it is a scan: hardly any text, or a page that is an image only."""
    return classified.groupBy(*keys).agg(((F.sum("chars") < LEAST_CHARS) | F.bool_or("image_only")).alias("scanned"))


def flattened(nodes: DataFrame, *keys: str, most: int = MOST_DEPTH) -> DataFrame:
    """A forest of rows (keys, id, parent, ord, value) in reading order: adds depth and path; what lies deeper than ``most`` is left out.

    One join a level, at most ``most`` levels; the levels' rows are joined with the nodes by parent.
    """
    level = nodes.where("parent is null").withColumns({"depth": F.lit(0), "path": F.array("ord")})
    out = level
    for depth in range(1, most):
        up = level.select(*keys, F.col("id").alias("parent"), F.col("path").alias("_path"))
        level = nodes.join(up, [*keys, "parent"]).withColumns({"depth": F.lit(depth), "path": F.array_append("_path", F.col("ord"))}).drop("_path").select(*out.columns)
        if not level.head(1):
            break
        out = out.unionByName(level)
    return out


def channels(rows: DataFrame, *keys: str) -> DataFrame:
    """Text channels of a document (information fields, outline, form values, notes) as one text, a line each, empty ones left out: keys, text."""
    some = rows.where(F.length(F.trim("value")) > 0)
    return some.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("channel", "ord", "value"))), lambda x: x["value"]), "\n").alias("text"))
