"""Leak checks on masked texts, parts and bytes, and fidelity of keys read from scans."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import entities as E
from ..functions import placeholders as P
from ..functions import text as T
from ..functions import validators as V
from . import document

#: Digit runs with single separators, as a leak may be written.
RUN = f"[0-9](?:[{T.WS}.()\\u00AD\\u2010-\\u2015-]?[0-9])*"


def survives(body: Column, needle: Column) -> Column:
    """Whether a needle is still in the text, forwards or backwards: numbers bounded by non-digits, words as whole words."""
    def found(n: Column) -> Column:
        number = F.regexp_like(T.leak_form(body), F.concat(F.lit("(?<![0-9])"), T.literal(T.leak_form(n)), F.lit("(?![0-9])")))
        return F.when(T.leak_form(needle).rlike("^[0-9]+$"), number).otherwise(T.has_word(T.strip_controls(body), T.strip_controls(n)))

    return F.coalesce((F.length(needle) > 0) & (found(needle) | found(F.reverse(needle))), F.lit(False))


def leaks(body: Column, needles: Column, meta: Column | None = None) -> Column:
    """The needles that survive in the text, or in the text beside it."""
    seen = (lambda n: survives(body, n)) if meta is None else (lambda n: survives(body, n) | survives(meta, n))
    return F.filter(F.array_distinct(needles), seen)


#: Trusted values shorter than this are found by chance.
LEAST_TRUSTED = 4


def trusted_leaks(text: Column, key: Column) -> Column:
    """Values of a scan's key that checked out and still stand in the masked text."""
    own = F.filter(key, lambda k: (k["source"] == "validated") & (F.length(k["original"]) >= LEAST_TRUSTED) & F.contains(text, k["original"]))
    return F.transform(own, lambda k: k["original"])


TEXT_PART = "(?i)\\.(xml|rels)$"


def part_leaks(parts: Column, needles: Column) -> Column:
    """(path, needle) of every needle that survives in a text part of a file (a map of path to decoded text): as in ``leaks``, and names
    of several words with other gaps between them, or none."""
    def hits(part: Column) -> Column:
        named = lambda n: F.coalesce(F.regexp_like(T.strip_controls(part["value"]), P.name_pattern(n)), F.lit(False))
        return F.transform(F.filter(F.array_distinct(needles), lambda n: survives(part["value"], n) | named(n)), lambda n: F.struct(part["key"].alias("path"), n.alias("needle")))

    return F.flatten(F.transform(F.filter(F.map_entries(parts), lambda p: p["key"].rlike(TEXT_PART)), hits))


_CONTROLS, _GAPS, _GAP = re.compile(f"[\\u00AD{T.BIDI}]"), re.compile(f"[{T.WS}\\u2010-\\u2015-]"), f"[{T.WS}\\u2010-\\u2015-]*"
_RUNS, _NAME_GAP = re.compile(RUN), re.compile(P.NAME_GAP)


def plain_form(text: str) -> str:
    """Leak form of a string."""
    return _GAPS.sub("", _CONTROLS.sub("", text))


def _is_number(form: str) -> bool:
    return form != "" and form.isascii() and form.isdigit()


def _has_word(text: str, words: str) -> bool:
    return re.search(f"(?<![{T.WORDISH}]){re.escape(words)}(?![{T.WORDISH}])", text) is not None


def plain_survives(body: str, needle: str) -> bool:
    """``survives`` on strings."""
    if not needle:
        return False
    form = plain_form(needle)
    if _is_number(form):
        seen = plain_form(body)
        return any(re.search(f"(?<![0-9]){n}(?![0-9])", seen) for n in (form, form[::-1]))
    seen, word = _CONTROLS.sub("", body), _CONTROLS.sub("", needle)
    return any(_has_word(seen, n) for n in (word, word[::-1]) if n)


def plain_leak_spans(text: str, value: str, kind: str) -> list[tuple[int, int, str, float, None]]:
    """``leak_spans`` on strings."""
    form, word = plain_form(value), value.strip()
    if _is_number(form):
        return [(m.start(), m.end(), kind, 1.0, None) for m in _RUNS.finditer(text) if plain_form(m[0]) == form]
    if not word:
        return []
    return [(m.start(), m.start() + len(word), kind, 1.0, None) for m in re.finditer(f"(?<![{T.WORDISH}])(?={re.escape(word)}(?![{T.WORDISH}]))", text)]


def plain_part_leaks(text: str, needles: list[str]) -> list[str]:
    """The needles that survive in a part's text, names of several words with any gap between them."""
    seen, out = _CONTROLS.sub("", text), []
    for n in dict.fromkeys(needles):
        words = [w for w in _NAME_GAP.split(_CONTROLS.sub("", n)) if w]
        loose = len(words) >= 2 and not _is_number(plain_form(n)) and re.search(f"(?<![{T.WORDISH}]){_GAP.join(map(re.escape, words))}(?![{T.WORDISH}])", seen)
        if loose or plain_survives(text, n):
            out.append(n)
    return out


def healed(text: str, result: tuple, most: int = 1) -> tuple:
    """A result that also covers values written in another form: what survives is found again, and all is masked anew."""
    for _ in range(most):
        spans, key, out = result
        body = re.sub(r"[\[\]]", "x", out)
        left = [k for k in key if plain_survives(body, k[1])]
        more = [s for k in left for s in plain_leak_spans(text, k[1], k[2])]
        if not more:
            return result
        used = document.resolved([*spans, *more])
        masked, key = document.masked(text, used)
        result = (used, key, masked)
    return result


# What tells streams of fonts and images, and the forms in which a value may lie in bytes.
ASSET = re.compile(rb"/FontFile[23]?\b|/Length1\b|/Subtype\s*/(?:Image|CIDFontType|Type1C|TrueType)|/Type\s*/Font")
FORMS = (("utf-8", "utf-8", False), ("utf-16le", "utf-16-le", False), ("utf-16be", "utf-16-be", False), ("utf-8 (reversed)", "utf-8", True), ("utf-16le (reversed)", "utf-16-le", True))
STREAM = re.compile(rb"stream\r?\n?(.*?)endstream", re.S)


def streams(content: bytes) -> list[bytes]:
    """The streams of a file but those of fonts and images, as they lie and inflated where they can be."""
    out = []
    for m in STREAM.finditer(content):
        at = content.rfind(b" obj", 0, m.start() + 4)
        head = content[max(at, m.start() - 2000) if at >= 0 else max(0, m.start() - 512) : m.start()]
        if ASSET.search(head):
            continue
        out.append(m[1])
        for bits in (15, -15):
            try:
                out.append(zlib.decompressobj(bits).decompress(m[1]))
                break
            except zlib.error:
                continue
    return out


def bytes_hold(content: bytes, needles: list[str]) -> list[str]:
    """``needle [form]`` of every form of a needle in a file's bytes or streams."""
    where = [content, *streams(content)]
    out = []
    for n in needles:
        for name, code, back in FORMS:
            form = (n[::-1] if back else n).encode(code, "surrogatepass")
            if form and any(form in w for w in where):
                out.append(f"{n} [{name}]")
    return out


@F.pandas_udf(K.ArrayType(K.StringType()))
def byte_leaks(contents: pd.Series, needles: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else bytes_hold(c, [] if n is None else list(n)) for c, n in zip(contents, needles)])


def generations(content: Column) -> Column:
    """Whether a file has one generation alone: exactly one end mark and one table mark."""
    raw = F.decode(content, "ISO-8859-1")
    n = lambda mark: F.regexp_count(raw, F.lit(mark))
    return F.struct(n("%%EOF").alias("ends"), n("startxref").alias("tables"), ((n("%%EOF") == 1) & (n("startxref") == 1)).alias("single"))


def worth_warning(key: Column, text_hits: Column, byte_hits: Column) -> Column:
    """The originals to warn of: whatever survives in the text, and of what is only in the bytes the rows of high confidence."""
    own = F.filter(key, lambda k: F.array_contains(text_hits, k["original"]) | F.array_contains(byte_hits, k["original"]) & high_confidence(k))
    return F.array_distinct(F.transform(own, lambda k: k["original"]))


def checked_files(df: DataFrame, content: str = "content", text: str = "text", meta: str = "meta", key: str = "key") -> DataFrame:
    """Adds all three layers on finished files: in_text (values in the text or beside it), in_bytes (forms in the bytes), generations,
    warn (what to warn of) and passed."""
    needles = F.transform(key, lambda k: k["original"])
    df = df.withColumns({"in_text": leaks(F.col(text), needles, F.col(meta)), "in_bytes": byte_leaks(F.col(content), needles), "generations": generations(F.col(content))})
    plain = F.transform("in_bytes", lambda h: F.regexp_replace(h, " \\[[^\\[]*\\]$", ""))
    return df.withColumns({"warn": worth_warning(F.col(key), F.col("in_text"), plain), "passed": (F.size("in_text") == 0) & (F.size("in_bytes") == 0) & F.col("generations.single")})


def leak_spans(text: Column, key: Column) -> Column:
    """Spans of a key's values in any format of theirs: numbers as runs of the same leak form, others as whole words."""
    runs = T.spans_of(text, RUN, "IL_NUMBER")
    is_number = lambda k: T.leak_form(k["original"]).rlike("^[0-9]+$")
    numbers = F.flatten(F.transform(F.filter(key, is_number), lambda k: F.transform(F.filter(runs, lambda s: T.leak_form(T.surface(text, s)) == T.leak_form(k["original"])), lambda s: T.span(s["start"], s["end"], k["type"], 1.0))))
    trimmed = F.transform(F.filter(key, lambda k: ~is_number(k)), lambda k: F.struct(F.regexp_replace(k["original"], f"^[{T.WS}]+|[{T.WS}]+$", "").alias("original"), k["type"].alias("type")))
    words = F.flatten(F.transform(F.filter(trimmed, lambda k: F.length(k["original"]) > 0), lambda k: F.transform(T.word_starts(text, k["original"]), lambda at: T.span(at, at + F.length(k["original"]), k["type"], 1.0))))
    return F.array_distinct(F.concat(numbers, words))


#: Shorter numbers are too often part of another to be believed where they aren't bounded.
LEAST_DIGITS = 5


def high_confidence(row: Column) -> Column:
    """Whether a survivor of this key row counts without a second look: a number (in leak form) of five digits or more, else a structured type or two words."""
    number = T.leak_form(row["original"])
    words = F.filter(F.split(T.strip_controls(row["original"]), f"[{T.WS}]+"), lambda w: w != "")
    return F.when(number.rlike("^[0-9]+$"), F.length(number) >= LEAST_DIGITS).otherwise(E.structured(row["type"]) | (F.size(words) >= 2))


def fidelity(kind: Column, original: Column) -> Column:
    """validated, ocr or unreadable: how far a value read from a scan can be trusted."""
    rest = F.when(original.rlike("[0-9]"), "ocr").otherwise("unreadable")
    checked = F.when(kind == "ISRAELI_ID", V.israeli_id(original)).when(kind == "IL_PHONE", V.israeli_phone(original)).when(kind == "IL_COMPANY", V.israeli_company(original)).otherwise(False)
    return F.when(kind.isin("EMAIL_ADDRESS", "IL_IBAN") | checked, "validated").when(kind.isin("PERSON", "ORGANIZATION", "LOCATION", "IL_NUMBER"), "ocr").otherwise(rest)
