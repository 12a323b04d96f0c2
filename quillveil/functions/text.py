"""Text expressions shared by all operators: character classes, matches with positions, normalisation.

Positions are code points. Java's ``\\s`` and ``\\b`` aren't used: the classes below are spelled out.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K

# White space of the matching rules; separators allowed inside numbers; characters that are looked through.
WS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
HWS = " \\t\\u00A0\\u202F\\uFEFF"
INVISIBLE = "\\u00AD\\u200B-\\u200F\\u202A-\\u202E\\u2066-\\u2069\\uFEFF"
BIDI = "\\u200E\\u200F\\u202A-\\u202E\\u2066-\\u2069"
QUOTES = "\"'`\\u05F4\\u05F3\\u201C\\u201D\\u201F\\u2018\\u2019"
WORDISH = "A-Za-z0-9\\u0590-\\u05FF"
TOKEN = f"\\[[^\\[\\]]*_[0-9]+[{WS}]*\\]"

SPAN = "struct<start:int,end:int,type:string,score:double,label:string>"
SPANS = f"array<{SPAN}>"
#: The same as a type object: modules that hold Arrow functions are imported on executors, where no DDL can be parsed.
SPANS_TYPE = K.ArrayType(K.StructType([K.StructField("start", K.IntegerType()), K.StructField("end", K.IntegerType()), K.StructField("type", K.StringType()), K.StructField("score", K.DoubleType()), K.StructField("label", K.StringType())]))


def no_spans() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def span(start: Column, end: Column, kind: Column | str, score: Column | float, label: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    score = F.lit(score) if isinstance(score, (int, float)) else score
    label = F.lit(None) if label is None else label
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("type"), score.cast("double").alias("score"), label.cast("string").alias("label"))


def pieces(text: Column, value: str | Column, lead: str = "", before: str = "") -> Column:
    """The text cut around all matches of ``value`` (after ``lead``): gaps and matches by turns."""
    clean = F.translate(text, "\x01\x02", "  ")
    pattern = F.lit(f"{before}({lead})({value})") if isinstance(value, str) else value
    return F.split(F.regexp_replace(clean, pattern, F.lit("$1\x01$2\x02")), "[\x01\x02]", -1)


def spans_of(text: Column, value: str, kind: str, score: float = 1.0, *, lead: str = "", before: str = "", ok: Callable[[Column], Column] | None = None, kinds: Callable[[Column], Column] | None = None) -> Column:
    """Spans of all matches whose surface passes ``ok``."""

    def step(a: Column, p: Column) -> Column:
        end = a["pos"] + F.length(p)
        take = a["hit"] & ok(p) if ok else a["hit"]
        return F.struct(end.alias("pos"), (~a["hit"]).alias("hit"), F.when(take, F.array_append(a["out"], span(a["pos"], end, kind, score))).otherwise(a["out"]).alias("out"))

    found = F.aggregate(pieces(text, value, lead, before), F.struct(F.lit(0).alias("pos"), F.lit(False).alias("hit"), no_spans().alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(f"{before}{lead}{value}"), found).otherwise(no_spans())


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


#: Characters that detection reads in another form, so that what it looks for may not stand in the text as such.
UNUSUAL = f"[{INVISIBLE}\\u0660-\\u0669\\u06F0-\\u06F9\\uFB1D-\\uFB4E\\uFF10-\\uFF19]"
INVISIBLE_RE = re.compile(f"[{INVISIBLE}]")


def folds() -> dict[int, str]:
    """Characters that detection reads in another form: full-width and Arabic digits, canonical forms of single characters, and
    nothing for invisible ones."""
    out = {c: n for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and (n := unicodedata.normalize("NFC", chr(c))) != chr(c)}
    out |= {base + d: str(d) for base in (0xFF10, 0x0660, 0x06F0) for d in range(10)}
    return out | {c: "" for c in range(0x10000) if INVISIBLE_RE.match(chr(c))}


def shadow(text: Column) -> Column:
    """Text as detection reads it: invisible characters dropped, full-width and Arabic digits folded, characters with a one-character
    canonical form in that form (those with a longer one are folded on Python strings only)."""
    single = {chr(c): n for c, n in folds().items() if len(n) == 1}
    return F.translate(F.regexp_replace(text, f"[{INVISIBLE}]", ""), "".join(single), "".join(single.values()))


def from_shadow(text: Column, spans: Column) -> Column:
    """Spans of the shadow as spans of the text; nothing is done where no character was dropped. One pass over the characters."""
    at = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(~c.rlike(f"[{INVISIBLE}]"), i)), lambda i: i.isNotNull())
    moved = lambda kept: F.transform(spans, lambda s: span(F.element_at(kept, s["start"] + 1), F.element_at(kept, s["end"]) + 1, s["type"], s["score"], s["label"]))
    once = F.transform(F.array(at), moved)[0]  # a lambda binds the places, so that they are worked out once
    return F.when((F.size(spans) > 0) & text.rlike(f"[{INVISIBLE}]"), once).otherwise(spans)


def surface(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def placeholder_key(token: Column) -> Column:
    """A placeholder without direction marks, quotes and white space, so that cosmetic changes don't matter."""
    return F.regexp_replace(token, f"[{BIDI}{QUOTES}{WS}]", "")


def same_placeholder(a: Column, b: Column) -> Column:
    """Whether two placeholder keys are one: letters in any canonical form, as the collation compares them."""
    plain = "^[\\x00-\\x7F]*$"
    return (a == b) | F.when(a.rlike(plain) | b.rlike(plain), False).otherwise(F.collate(a, "UNICODE") == F.collate(b, "UNICODE"))


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, f"[\\u00AD{BIDI}]", "")


def leak_form(text: Column) -> Column:
    """Without controls, white space and hyphens; dots and brackets stay."""
    return F.regexp_replace(strip_controls(text), f"[{WS}\\u2010-\\u2015-]", "")


def literal(value: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def bounded(value: Column) -> Column:
    """Pattern of the value as a whole word."""
    return F.concat(F.lit(f"(?<![{WORDISH}])"), literal(value), F.lit(f"(?![{WORDISH}])"))


def has_word(text: Column, value: Column) -> Column:
    return (F.length(value) > 0) & F.regexp_like(text, bounded(value))


def word_starts(text: Column, value: Column) -> Column:
    """Places of all occurrences of a value as a whole word, overlapping ones too."""
    gaps = F.split(F.regexp_replace(F.translate(text, "\x01", " "), F.concat(F.lit(f"(?<![{WORDISH}])(?="), literal(value), F.lit(f"(?![{WORDISH}]))")), F.lit("\x01")), "\x01", -1)
    ends = F.aggregate(gaps, F.expr("cast(array() as array<int>)"), lambda a, p: F.array_append(a, F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), a), -1), F.lit(0)) + F.length(p)))
    return F.slice(ends, F.lit(1), F.size(ends) - 1)


assert sys.maxunicode > 0xFFFF
