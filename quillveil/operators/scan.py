"""Pages read by OCR: text with word ranges, quality gate, rectangles. Words are rows; a page is the unit of grouping."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T
from . import document, masking, overlay, recognizers, verify

# Limits of the quality gate, padding of rectangles.
LEAST_WORDS, LEAST_MEAN, LOW, MOST_LOW = 2, 75.0, 60.0, 0.12
PAD, LEAST_PAD = 0.15, 1.0


def words_of(pages: DataFrame, *keys: str) -> DataFrame:
    """Words of recognised pages as rows: keys, word_idx and the words' own fields. Pages hold blocks of paragraphs of lines of words, or
    ``words`` at once."""
    if "words" in pages.columns:
        flat = F.col("words")
    else:
        lines = F.flatten(F.transform(F.flatten(F.transform("blocks", lambda b: b["paragraphs"])), lambda p: p["lines"]))
        flat = F.flatten(F.transform(lines, lambda x: x["words"]))
    return pages.select(*keys, F.posexplode(flat).alias("word_idx", "w")).select(*keys, "word_idx", "w.*")


def page_text(words: DataFrame, *keys: str) -> DataFrame:
    """Each word's range in the page's text, words joined by one space: adds start, end."""
    before = Window.partitionBy(*keys).orderBy("word_idx", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return words.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def words_in(ranges: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Words that overlap a span of their page (a span's columns get the prefix s_)."""
    s = spans.select(*keys, *(F.col(c).alias(f"s_{c}") for c in spans.columns if c not in keys))
    return ranges.join(s, list(keys)).where((F.col("start") < F.col("s_end")) & (F.col("end") > F.col("s_start")))


def quality(words: DataFrame, *keys: str) -> DataFrame:
    """Per page: n_words, mean_confidence, low_ratio, readable."""
    some = words.where(F.trim("text") != "")
    out = some.groupBy(*keys).agg(F.count("*").alias("n_words"), F.avg("confidence").alias("mean_confidence"), F.avg((F.col("confidence") < LOW).cast("double")).alias("low_ratio"))
    return out.withColumn("readable", (F.col("n_words") >= LEAST_WORDS) & (F.col("mean_confidence") >= LEAST_MEAN) & (F.col("low_ratio") <= MOST_LOW))


def box_of(words: DataFrame, *keys: str) -> DataFrame:
    return words.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def padded(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> list[Column]:
    pad = F.greatest((y1 - y0) * PAD, F.lit(LEAST_PAD))
    return [F.greatest(x0 - pad, F.lit(0.0)), F.greatest(y0 - pad, F.lit(0.0)), F.least(x1 + pad, width), F.least(y1 + pad, height)]


def to_page(box: list[Column], image: tuple[Column, Column], page: tuple[Column, Column], origin: tuple[Column, Column]) -> list[Column]:
    """Pixels to points; the y axis isn't turned."""
    scale = [page[0] / image[0], page[1] / image[1]]
    return [origin[k % 2] + c * scale[k % 2] for k, c in enumerate(box)]


def islands(spans: DataFrame, *keys: str) -> DataFrame:
    """Overlapping spans of a page united to one row each: start, end, n. Touching ones stay apart."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach > F.col("start"), 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


# Labels of fields by type, longest label and value in words, gap in heights, score of what a scan tells by shape or label alone.
LABELS = [
    ("שם", "PERSON"), ("שם הלקוח", "PERSON"), ("שם המבקש", "PERSON"), ("שם מלא", "PERSON"), ("שם התובע", "PERSON"), ("שם הנתבע", "PERSON"),
    ("תעודת זהות", "ISRAELI_ID"), ('ת"ז', "ISRAELI_ID"), ("ת.ז", "ISRAELI_ID"), ("מספר זהות", "ISRAELI_ID"), ("מס' זהות", "ISRAELI_ID"), ("מ.ז", "ISRAELI_ID"),
    ("טלפון", "IL_PHONE"), ("טל'", "IL_PHONE"), ("נייד", "IL_PHONE"), ("פלאפון", "IL_PHONE"), ("פקס", "IL_PHONE"), ("מס' טלפון", "IL_PHONE"),
]
LABEL_WORDS, VALUE_WORDS, GAP, LABEL_LINE, WEAK = 2, 3, 1.5, 0.5, 0.5
NUMBER = f"(?<![0-9/])[0-9](?:[{T.HWS}.-]?[0-9]){{7,9}}(?![0-9/])"
BOX = ("x0", "y0", "x1", "y1")
_SPACES = re.compile(f"[{T.WS}]+")
_MARKS = re.compile(f"[{T.BIDI}]")
_NUMBER = re.compile(NUMBER)


def label_form(text: str) -> str:
    """A word or words as labels are compared: canonical, without direction marks and white space."""
    return _SPACES.sub("", _MARKS.sub("", unicodedata.normalize("NFC", text)))


_KEYS = [(label_form(t), kind) for t, kind in LABELS]


def exact_label(text: str) -> str | None:
    """Type of a text that is a label, with or without a colon."""
    form = label_form(text)
    form = form[:-1] if form.endswith(":") else form
    return next((kind for key, kind in _KEYS if key == form), None)


def glued_label(text: str) -> str | None:
    """Type of a word that begins with a label and goes on."""
    form = label_form(text)
    return next((kind for key, kind in _KEYS if len(form) > len(key) and form.startswith(key)), None)


def _height(b: dict) -> float:
    return b["y1"] - b["y0"]


def _one_line(a: dict, b: dict) -> bool:
    return min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]) > LABEL_LINE * min(_height(a), _height(b))


def _gap(a: dict, b: dict) -> float:
    return max(0.0, max(a["x0"], b["x0"]) - min(a["x1"], b["x1"]))


def union_box(boxes: list[dict]) -> dict:
    if not boxes:
        raise ValueError("no boxes")
    return {c: (min if c in ("x0", "y0") else max)(b[c] for b in boxes) for c in BOX}


def _neighbours(box: dict, label: set[int], words: list[dict]) -> list[int]:
    """Words of a label's line next to it: to the right, then to the left, from one to the next, three in all."""
    line = [k for k, w in enumerate(words) if k not in label and w["text"].strip() and _one_line(box, w)]
    right = sorted((k for k in line if words[k]["x0"] >= box["x1"]), key=lambda k: words[k]["x0"])
    left = sorted((k for k in line if words[k]["x1"] <= box["x0"]), key=lambda k: -words[k]["x1"])
    most, picked = GAP * _height(box), []
    for side in (right, left):
        last = box
        for k in side:
            if len(picked) == VALUE_WORDS or exact_label(words[k]["text"]) or glued_label(words[k]["text"]) or _gap(last, words[k]) > most:
                break
            picked.append(k)
            last = words[k]
    return picked


def anchored(words: list[dict]) -> list[tuple[list[int], list[int], str]]:
    """Labels with the words of their values: (label words, value words, type). The longest label at a place counts."""
    out, k = [], 0
    while k < len(words):
        taken = 1
        if words[k]["text"].strip():
            if kind := glued_label(words[k]["text"]):
                out.append(([], [k], kind))
            else:
                for n in range(min(LABEL_WORDS, len(words) - k), 0, -1):
                    own = words[k : k + n]
                    close = all(_one_line(a, b) and _gap(a, b) <= GAP * max(_height(a), _height(b)) for a, b in zip(own, own[1:]))
                    kind = exact_label(" ".join(w["text"] for w in own)) if close and all(w["text"].strip() for w in own) else None
                    if kind:
                        value = _neighbours(union_box(own), set(range(k, k + n)), words)
                        out += [(list(range(k, k + n)), value, kind)] if value else []
                        taken = n
                        break
        k += taken
    return out


def united(found: list[document.Span]) -> list[document.Span]:
    """Overlapping spans as one, of the stronger type; nothing that any of them covers is lost."""
    out: list[document.Span] = []
    for s in sorted(found, key=lambda s: s[:2]):
        if out and s[0] < out[-1][1]:
            a = out[-1]
            mine, theirs = document.PRIORITY.get(s[2], 0), document.PRIORITY.get(a[2], 0)
            better = mine > theirs or mine == theirs and s[3] > a[3]
            out[-1] = (a[0], max(a[1], s[1]), s[2] if better else a[2], max(a[3], s[3]), a[4])
        else:
            out.append(s)
    return out


def page_spans(words: list[dict]) -> tuple[str, list[document.Span], list[dict], bool]:
    """Text, spans and boxes of a page, and whether a span has no word under it: rules, long numbers, and values beside labels."""
    text = " ".join(w["text"] for w in words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w["text"]) + 1)
    found = document.process(text, recognizers.found(text))[0]
    found += [(m.start(), m.end(), "IL_NUMBER", WEAK, None) for m in _NUMBER.finditer(text)]
    labels = anchored(words)
    found += [(min(starts[k] for k in v), max(starts[k] + len(words[k]["text"]) for k in v), kind, WEAK, None) for _, v, kind in labels]
    spans, boxes, lost = united(found), [], False
    for s in spans:
        under = [w for k, w in enumerate(words) if starts[k] < s[1] and starts[k] + len(w["text"]) > s[0]]
        lost |= not under
        boxes += [union_box(under)] if under else []
    return text, spans, boxes + [union_box([words[k] for k in (*label, *value)]) for label, value, _ in labels], lost


_PAGE = K.StructType([
    K.StructField("text", K.StringType()), K.StructField("spans", T.SPANS_TYPE),
    K.StructField("boxes", K.ArrayType(K.StructType([K.StructField(c, K.DoubleType()) for c in BOX]))), K.StructField("unmappable", K.BooleanType()),
])


@F.pandas_udf(_PAGE)
def _detected(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for words in pages:
        text, spans, boxes, lost = page_spans([dict(w) for w in words])
        rows.append((text, [dict(zip(("start", "end", "type", "score", "label"), s)) for s in spans], boxes, lost))
    return pd.DataFrame(rows, columns=["text", "spans", "boxes", "unmappable"])


def detect_pages(words: DataFrame, *keys: str) -> DataFrame:
    """Per page of words (keys, word_idx, text, x0, y0, x1, y1): keys, text, spans, boxes, unmappable. A page's words meet in one row."""
    rows = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word_idx", "text", *(F.col(c).cast("double").alias(c) for c in BOX)))).alias("_words"))
    return rows.withColumn("_page", _detected("_words")).select(*keys, "_page.*")


def redacted_documents(words: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """Scanned documents masked as one text a document: doc, text, spans, key (with fidelity in ``source``), anonymized, leaks, refused.

    Pages that fail the quality gate are left out; a document without a readable page is refused, one whose masked text still holds
    a trusted value too. Numbers run over all pages of a document.
    """
    gate = quality(words, doc, page)
    good = words.join(gate.where("readable").select(doc, page), [doc, page])
    whole = overlay.one_document(detect_pages(good, doc, page), doc, page=page)
    out = masking.mask(whole, F.col("spans"), resolve=False).withColumn("key", F.transform("key", lambda k: F.struct(k["placeholder"].alias("placeholder"), k["original"].alias("original"), k["type"].alias("type"), verify.fidelity(k["type"], k["original"]).alias("source"))))
    out = out.withColumn("leaks", verify.trusted_leaks(F.col("anonymized"), F.col("key")))
    refused = gate.groupBy(doc).agg((~F.bool_or("readable")).alias("_none"))
    return refused.join(out, doc, "left").withColumn("refused", F.col("_none") | F.coalesce(F.size("leaks") > 0, F.lit(False))).drop("_none")


def rectangles(detected: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """What a writer whitens: the boxes of detected pages, padded and in page points: keys, x0, y0, x1, y1. ``sizes``: keys, image_w,
    image_h, page_w, page_h, origin_x, origin_y."""
    rows = detected.select(*keys, F.explode("boxes").alias("b")).join(sizes, list(keys))
    c = F.col
    box = padded(c("b.x0"), c("b.y0"), c("b.x1"), c("b.y1"), c("image_w"), c("image_h"))
    place = to_page(box, (c("image_w"), c("image_h")), (c("page_w"), c("page_h")), (c("origin_x"), c("origin_y")))
    return rows.select(*keys, *(x.alias(n) for x, n in zip(place, BOX)))


def whitened(words: DataFrame, boxes: DataFrame, *keys: str) -> DataFrame:
    """What a second reading of the pages sees: the words that no box covers. Boxes: keys, x0, y0, x1, y1."""
    b = boxes.select(*keys, *(F.col(c).alias(f"b_{c}") for c in BOX))
    on = [words[k] == b[k] for k in keys]
    met = (words["x0"] < b["b_x1"]) & (words["x1"] > b["b_x0"]) & (words["y0"] < b["b_y1"]) & (words["y1"] > b["b_y0"])
    for c in on:
        met = met & c
    return words.join(b, met, "left_anti")
