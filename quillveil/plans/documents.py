"""Registered queries of pages, scans, files and bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..operators import glyphs, layered, scan, verify
from ..sources import files, office
from .catalog import PLANTED_SQL, planted, query, table

#: Events as glyphs: a user is a document, 8 events a line, 4 lines a page.
GLYPHS_SQL = """WITH g AS (SELECT user_id AS doc, event_id // 32 AS page, event_id // 8 AS line, event_id AS pos, substr(event_type, 1, 1) AS ch, event_id % 8 * 10.0 AS x, event_id // 8 % 4 * 20.0 AS y FROM events),
m AS (SELECT *, (coalesce(sum(1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(CASE WHEN lp <> page THEN 2 WHEN ll <> line THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING))::INT AS start
FROM (SELECT *, lag(page) OVER (PARTITION BY doc ORDER BY pos) AS lp, lag(line) OVER (PARTITION BY doc ORDER BY pos) AS ll FROM g) WINDOW w AS (PARTITION BY doc ORDER BY pos))
"""


def glyph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    x, y = k % 8 * 10.0, F.floor(k / 8) % 4 * 20.0
    quad = F.array(x, y + 12, x + 8, y + 12, x + 8, y, x, y)
    return e.select(F.col("user_id").alias("doc"), F.floor(k / 32).cast("int").alias("page"), F.floor(k / 8).cast("int").alias("line"), k.alias("pos"), F.substring("event_type", 1, 1).alias("ch"), quad.alias("quad"))


@query(GLYPHS_SQL + "SELECT doc, string_agg(CASE WHEN lp <> page THEN chr(10) || chr(10) WHEN ll <> line THEN chr(10) ELSE '' END || ch, '' ORDER BY pos) AS text, max(start) AS last FROM m GROUP BY doc")
def glyph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of glyphs, and the place of the last."""
    placed = glyphs.mapped(glyph_rows(spark, sf_dir), "doc")
    return glyphs.text_of(placed, "doc").join(placed.groupBy("doc").agg(F.max("start").alias("last")), "doc")


@query(
    GLYPHS_SQL
    + ", s AS (SELECT DISTINCT user_id AS doc, (user_id % 5)::INT AS a, (user_id % 5 + 9)::INT AS b FROM events) SELECT m.doc, a, (row_number() OVER (PARTITION BY m.doc ORDER BY min(pos)) - 1)::INT AS nth, page::INT AS page, min(x) AS x0, min(y) AS y0, max(x) + 8 AS x1, max(y) + 12 AS y1 FROM m JOIN s ON m.doc = s.doc AND start >= a AND start < b GROUP BY m.doc, a, page, line"
)
def glyph_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of a span of each document: one a line."""
    placed = glyphs.mapped(glyph_rows(spark, sf_dir), "doc")
    a = (F.col("doc") % 5).cast("int")
    spans = placed.select("doc").distinct().select("doc", a.alias("start"), (a + 9).alias("end"))
    rects = glyphs.rectangles(glyphs.covered(placed, spans, "doc"), "doc")
    return rects.select("doc", F.col("s_start").alias("a"), "nth", "page", "x0", "y0", "x1", "y1")


@query(
    """WITH p AS (SELECT user_id AS doc, event_id // 32 AS page, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT doc, page, CASE WHEN n < 3 THEN n ELSE n END AS chars, (page % 10) / 10.0 AS cover FROM p),
i AS (SELECT *, chars < 3 AND cover >= 0.5 AS image_only FROM c) SELECT doc, sum(chars) < 3 OR bool_or(image_only) AS scanned, count(*) FILTER (WHERE image_only) AS pages FROM i GROUP BY doc"""
)
def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose pages hold hardly any text, or a page that is an image."""
    g = glyph_rows(spark, sf_dir)
    pages = g.select("doc", "page").distinct()
    images = pages.select("doc", "page", F.explode(F.array(F.lit(0.0), F.col("page") % 10 * 60.0)).alias("area"))
    c = glyphs.scanned_pages(pages.withColumn("area", F.lit(600.0)), g, images, "doc")
    return glyphs.scanned(c, "doc").join(c.groupBy("doc").agg(F.count_if("image_only").alias("pages")), "doc")


@query(
    """WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey - c_custkey % 50 + (c_custkey % 50 - 1) // 2 END AS parent, c_custkey // 50 AS doc, c_name AS value FROM customer),
r AS (SELECT doc, id, 0 AS depth, lpad(id::VARCHAR, 9, '0') AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.doc, t.id, r.depth + 1, r.path || '/' || lpad(t.id::VARCHAR, 9, '0') FROM t JOIN r ON t.doc = r.doc AND t.parent = r.id WHERE r.depth < 31)
SELECT doc, id, depth::INT AS depth, path FROM r"""
)
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested entries flattened in reading order."""
    k = F.col("c_custkey")
    parent = F.when(k % 50 != 0, k - k % 50 + F.floor((k % 50 - 1) / 2))
    nodes = table(spark, sf_dir, "customer").select(F.floor(k / 50).cast("long").alias("doc"), k.alias("id"), parent.cast("long").alias("parent"), k.alias("ord"), F.col("c_name").alias("value"))
    path = F.array_join(F.transform("path", lambda x: F.lpad(x.cast("string"), 9, "0")), "/")
    return glyphs.flattened(nodes, "doc").select("doc", "id", "depth", path.alias("path"))


@query("SELECT c_nationkey AS doc, string_agg(c_name, chr(10) ORDER BY c_custkey % 3, c_custkey) AS text FROM customer WHERE c_custkey % 5 <> 0 GROUP BY c_nationkey")
def channel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text beside the pages (fields, titles, form values) as one text, empty values left out."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), (k % 3).alias("channel"), k.alias("ord"), F.when(k % 5 == 0, " ").otherwise(F.col("c_name")).alias("value"))
    return glyphs.channels(rows, "doc")


# ---- scans ------------------------------------------------------------------------------------------------------------------


def scan_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer: a labelled id, a name beside its label, a number of eight digits alone, a far word, a label glued to its value."""
    p = planted(spark, sf_dir)
    word = lambda n, text, x, y: F.struct(F.lit(n).alias("word_idx"), text.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(float(x + 60)).alias("x1"), F.lit(float(y + 20)).alias("y1"))
    words = [('ת"ז', 0, 0), (F.col("id"), 70, 0), ("סכום", 400, 0), (F.concat(F.lit("7"), F.col("seven")), 0, 100), ("שם", 0, 200), ("דנה", 70, 200), ("לוי", 140, 200), ("רחוק", 900, 200), (F.concat(F.lit("טלפון"), F.col("seven")), 0, 300)]
    row = F.array(*(word(n, t if isinstance(t, Column) else F.lit(t), x, y) for n, (t, x, y) in enumerate(words)))
    w = p.select(F.col("k").alias("doc"), F.lit(0).alias("page"), F.explode(row).alias("w")).select("doc", "page", "w.*")
    return w.withColumn("confidence", F.lit(95.0))


SCAN_SQL = PLANTED_SQL + """, s AS (SELECT k AS doc, CASE WHEN substr(id, 1, 1) = '5' THEN 'IL_COMPANY' ELSE 'ISRAELI_ID' END AS kind FROM p) """


@query(
    SCAN_SQL
    + """SELECT doc, kind AS type, 4 AS start, 13 AS "end", 70.0::DOUBLE AS x0, 130.0::DOUBLE AS x1 FROM s UNION ALL SELECT doc, 'IL_NUMBER', 19, 27, 0, 60 FROM s UNION ALL SELECT doc, 'PERSON', 31, 38, 70, 200 FROM s UNION ALL SELECT doc, 'IL_PHONE', 44, 56, 0, 60 FROM s"""
)
def scan_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of scanned pages by rules, by shape and by labels, united, each with its box."""
    d = scan.detect_pages(scan_words(spark, sf_dir), "doc", "page")
    s = d.select("doc", F.posexplode("spans").alias("n", "s"), "boxes").select("doc", "s.type", "s.start", "s.end", F.element_at("boxes", F.col("n") + 1).alias("b"))
    return s.select("doc", "type", "start", "end", F.col("b.x0").alias("x0"), F.col("b.x1").alias("x1"))


@query(
    SCAN_SQL
    + "SELECT doc, 'ת\"ז [' || CASE WHEN kind = 'IL_COMPANY' THEN 'COMPANY' ELSE 'ID' END || '_1] סכום [NUM_1] שם [NAME_1] רחוק [PHONE_1]' AS anonymized, 'validated,ocr,ocr,ocr' AS sources, 0 AS n_leaks, false AS refused FROM s"
)
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned documents masked, how far each value can be trusted, and whether one is refused."""
    d = scan.redacted_documents(scan_words(spark, sf_dir))
    return d.select("doc", "anonymized", F.array_join(F.transform("key", lambda k: k["source"]), ",").alias("sources"), F.size("leaks").alias("n_leaks"), "refused")


@query(
    SCAN_SQL
    + """, b AS (SELECT unnest([70.0, 0, 70, 0, 0, 0, 0]) AS x0, unnest([0.0, 100, 200, 300, 0, 200, 300]) AS y0, unnest([130.0, 60, 200, 60, 130, 200, 60]) AS x1)
SELECT doc, 10 + greatest(x0 - 3, 0) * 0.36 AS x0, greatest(y0 - 3, 0) * 0.36 AS y0, 10 + (x1 + 3) * 0.36 AS x1, (y0 + 23) * 0.36 AS y1 FROM s, b"""
)
def scan_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles to whiten on scanned pages: of every span, and of labels with their values."""
    d = scan.detect_pages(scan_words(spark, sf_dir), "doc", "page")
    sizes = {"image_w": 1700.0, "image_h": 2200.0, "page_w": 612.0, "page_h": 792.0, "origin_x": 10.0, "origin_y": 0.0}
    return scan.rectangles(d, d.select("doc", "page", *(F.lit(v).alias(n) for n, v in sizes.items())), "doc", "page").drop("page")


@query(SCAN_SQL + "SELECT doc, 2::BIGINT AS words_left, 0::BIGINT AS spans_left FROM s")
def scan_second_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second reading of the whitened pages finds: nothing."""
    w = scan_words(spark, sf_dir)
    b = scan.detect_pages(w, "doc", "page").select("doc", "page", F.explode("boxes").alias("b")).select("doc", "page", "b.*")
    left = scan.whitened(w, b, "doc", "page")
    again = scan.detect_pages(left, "doc", "page").select("doc", F.size("spans").cast("long").alias("spans_left"))
    return left.groupBy("doc").agg(F.count("*").alias("words_left")).join(again, "doc")


@query("""SELECT c_custkey AS doc, c_custkey % 4 = 0 AS refused FROM customer""")
def unreadable_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which no page can be read are refused."""
    k = F.col("c_custkey")
    word = lambda n, c: F.struct(F.lit(n).alias("word_idx"), F.concat(F.lit("w"), F.lit(str(n))).alias("text"), F.lit(n * 70.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(n * 70.0 + 60).alias("x1"), F.lit(20.0).alias("y1"), c.alias("confidence"))
    low = F.when(k % 4 == 0, 40.0).otherwise(90.0)
    w = table(spark, sf_dir, "customer").select(k.alias("doc"), F.explode(F.array(*(word(n, low) for n in range(3)))).alias("w")).select("doc", F.lit(0).alias("page"), "w.*")
    return scan.redacted_documents(w).select("doc", "refused")


# ---- bytes and files --------------------------------------------------------------------------------------------------------


@query(
    PLANTED_SQL + """SELECT k, [id || ' [utf-8]'] AS plain, [id || ' [utf-16be]'] AS wide, [id || ' [utf-8 (reversed)]'] AS backwards, [id || ' [utf-8]'] AS packed, []::VARCHAR[] AS fonts, true AS single, false AS double FROM p"""
)
def byte_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in the bytes of a file: as they are, in UTF-16, backwards, in packed streams, but not in fonts; and generations."""

    @F.pandas_udf(K.BinaryType())
    def packed(ids: pd.Series) -> pd.Series:
        import zlib

        return ids.map(lambda v: b"1 0 obj << >> stream\r\n" + zlib.compress(v.encode()) + b"endstream %%EOF")

    @F.pandas_udf(K.BinaryType())
    def font(ids: pd.Series) -> pd.Series:
        import zlib

        return ids.map(lambda v: b"1 0 obj << /FontFile2 3 >> stream\n" + zlib.compress(v.encode()) + b"endstream")

    p = planted(spark, sf_dir)
    needles = F.array(F.col("id"))
    raw = lambda c: F.encode(F.concat(F.lit("a"), c, F.lit("b")), "UTF-8")
    found = {
        "plain": verify.byte_leaks(raw(F.col("id")), needles), "wide": verify.byte_leaks(F.encode("id", "UTF-16BE"), needles), "backwards": verify.byte_leaks(raw(F.reverse("id")), needles),
        "packed": verify.byte_leaks(packed("id"), needles), "fonts": verify.byte_leaks(font("id"), needles),
    }
    once, twice = (F.encode(F.lit("startxref 1 %%EOF" * n), "UTF-8") for n in (1, 2))
    return p.select("k", *(c.alias(n) for n, c in found.items()), verify.generations(once)["single"].alias("single"), verify.generations(twice)["single"].alias("double"))


@query(PLANTED_SQL + "SELECT k, id AS in_text, id || ',' || 'דנה לוי' AS warn, false AS passed, id || ' [utf-8],דן [utf-8],דנה לוי [utf-8]' AS in_bytes FROM p")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers on a finished file; of what is in the bytes alone, fragments aren't worth a warning."""
    row = lambda c, kind: F.struct(F.lit("[X_1]").alias("placeholder"), c.alias("original"), F.lit(kind).alias("type"))
    key = F.array(row(F.col("id"), "ISRAELI_ID"), row(F.lit("דן"), "PERSON"), row(F.lit("דנה לוי"), "PERSON"))
    content = F.encode(F.concat(F.lit("נדן "), F.col("id"), F.lit("9 דנה לוי startxref %%EOF")), "UTF-8")
    p = planted(spark, sf_dir)
    p = verify.checked_files(p.select("k", content.alias("content"), F.lit("text").alias("text"), F.concat(F.lit("title "), F.col("id")).alias("meta"), key.alias("key")))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return p.select("k", joined("in_text"), joined("warn"), "passed", joined("in_bytes"))


@F.pandas_udf(K.BinaryType())
def _docx(texts: pd.Series) -> pd.Series:
    return texts.map(files.token_docx)


def office_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planted(spark, sf_dir)
    text = F.concat(F.lit("לקוח "), "id", F.lit("\nטל "), "phone", F.lit(" או "), "phone", F.lit("\nדרכון 3"), "seven", F.lit(", 3"), F.substring("seven", 1, 3), F.lit("-"), F.substring("seven", 4, 4))
    return p.select("k", "phone", F.concat(F.lit("a/"), F.col("k").cast("string"), F.lit(".docx")).alias("path"), text.alias("text")).withColumn("content", _docx("text"))


@query(
    PLANTED_SQL
    + """SELECT k, 'לקוח [' || CASE WHEN substr(id, 1, 1) = '5' THEN 'COMPANY' ELSE 'ID' END || '_1]' || chr(10) || 'טל [PHONE_1] או [PHONE_1]' || chr(10) || 'דרכון [PASSPORT_1], [PASSPORT_2]' AS text, true AS same, NULL::VARCHAR AS error FROM p"""
)
def office_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office files masked, healed (a passport number written in another form too) and restored."""
    rows = office.redact_files(office_rows(spark, sf_dir))
    back = office.restore_files(rows, "redacted", "key")
    return back.select("k", files.office_text("redacted").alias("text"), (files.office_text("restored") == files.office_text("content")).alias("same"), "error")


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'LEGACY_XLS_UNSUPPORTED' WHEN 1 THEN 'UNSUPPORTED' WHEN 2 THEN 'UNREADABLE' END AS error, CASE WHEN c_custkey % 4 = 3 THEN 'mail [EMAIL_1]' END AS text FROM customer")
def file_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of file to its reader; what can't be read is refused by a code."""
    k = F.col("k")
    ending = F.when(k % 4 == 0, "xls").when(k % 4 == 1, "pdf").when(k % 4 == 2, "docx").otherwise("txt")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumns({"path": F.concat(F.lit("f."), ending), "content": F.encode(F.lit("mail a@b.co"), "UTF-8")})
    return office.redact_files(rows).select("k", "error", "text")



@query(
    PLANTED_SQL
    + "SELECT k, 'טל [PHONE_1] סוף' || chr(10) || 'About [PHONE_1]' || chr(10) || 'Plain' AS anonymized, 'About [PHONE_1]' AS title, 30.0::DOUBLE AS x0, 30.0 + (length(phone) - 1) * 10 + 8 AS x1, 0 AS n_left FROM p"
)
def layered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of a page and titles beside it, masked with one key: the rectangle of the value, and the new title."""
    p = planted(spark, sf_dir).select(F.col("k").alias("doc"), "phone")
    text = F.concat(F.lit("טל "), "phone", F.lit(" סוף"))
    g = p.select("doc", F.lit(0).alias("page"), F.lit(0).alias("line"), F.posexplode(F.split(text, "")).alias("pos", "ch"))
    x = F.col("pos") * 10.0
    g = g.withColumn("quad", F.array(x, F.lit(0.0), x + 8, F.lit(0.0), x + 8, F.lit(12.0), x, F.lit(12.0)))
    titles = p.select("doc", F.lit("outline").alias("channel"), F.posexplode(F.array(F.concat(F.lit("About "), "phone"), F.lit("Plain"))).alias("ord", "value"))
    docs, rects, new = layered.redacted(g, titles)
    out = docs.join(rects, "doc").join(new.select("doc", F.col("value").alias("title")), "doc")
    return out.select(F.col("doc").alias("k"), "anonymized", "title", "x0", "x1", F.size("left").alias("n_left"))
