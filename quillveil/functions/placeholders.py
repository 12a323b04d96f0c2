"""Placeholders and the text around them: parts, counts, places, the note to a model, languages, units of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Latin placeholders of a composer, letters of the two scripts, units that a reader clicks, marks that gold texts leave out.
LATIN_TOKEN = "\\[[A-Za-z]+_[0-9]+\\]"
HEBREW, LATIN = "[\\u0590-\\u05FF]", "[A-Za-z]"
UNIT = "[A-Za-z\\u0590-\\u05FF]+(?:['\\u2019\\u05F3\\u05F4][A-Za-z\\u0590-\\u05FF]+)*|[0-9]+(?:[.\\-/][0-9]+)*"
GOLD_MARKS = "[\"'\\u05F3\\u05F4\\u2018\\u2019]"
NAME_GAP = f"[{T.WS}\\u2010-\\u2015\\u00AD-]+"
ALNUM = "\\p{L}\\p{N}"

#: The note that goes with masked text: a rule of dashes, then a line that a marker tells by. Wording and marker are the caller's to change.
RULE = "\n\n———————————————\n"
MARKERS = {"he": "הנחיה ל-AI", "en": "Note to the AI"}
NOTES = {
    "he": f"{RULE}{MARKERS['he']}: במקום פרטים אישיים יש בטקסט סימונים בסוגריים מרובעים, כמו [סוג_מספר]. נא להשאיר כל סימון כמות שהוא.",
    "en": f"{RULE}{MARKERS['en']}: personal details were replaced by marks in square brackets, like [type_number]. Please leave each mark as it is.",
}


def label_of(token: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_extract(token, "^\\[([\\s\\S]*)_[^_]*\\]$", 1)


def index_of(token: Column) -> Column:
    """The number of a placeholder; null if it has none."""
    return F.regexp_extract(token, f"_([0-9]+)[{T.WS}]*\\]$", 1).try_cast("long")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(T.TOKEN))


def n_restored(text: Column, unmatched: Column) -> Column:
    """Placeholders of the text that were found in the key."""
    return F.greatest(F.lit(0), n_tokens(text) - F.size(unmatched))


def looks_returned(text: Column) -> Column:
    """Two placeholders or more: an answer that comes back rather than a new document."""
    return n_tokens(text) >= 2


def n_distinct(text: Column) -> Column:
    return F.size(F.array_distinct(T.placeholders(text)))


def highest_index(key: DataFrame, *by: str, placeholder: str = "placeholder") -> DataFrame:
    """Per ``by`` and label the highest number in use: by, label, highest."""
    rows = key.select(*by, label_of(F.col(placeholder)).alias("label"), index_of(F.col(placeholder)).alias("n"))
    return rows.groupBy(*by, "label").agg(F.max("n").alias("highest"))


def token_at(text: Column, offset: Column) -> Column:
    """The Latin placeholder at an offset, both edges included; null if there is none."""
    found = F.filter(T.spans_of(text, LATIN_TOKEN, "TOKEN"), lambda s: (s["start"] <= offset) & (s["end"] >= offset))
    return F.when(F.size(found) > 0, T.surface(text, F.element_at(found, 1)))


def word_at(text: Column, offset: Column) -> Column:
    """The run of non-space characters at an offset, without marks at its edges; null on a space or inside a placeholder."""
    space, char = f"[{T.WS}]", lambda i: F.substring(text, i + 1, F.lit(1))
    at = F.when((offset >= F.length(text)) | char(offset).rlike(space), offset - 1).otherwise(offset)
    left, right = (F.regexp_extract(F.substring(text, F.lit(1), at), f"[^{T.WS}]*$", 0), F.regexp_extract(F.substring(text, at + 1, F.length(text)), f"^[^{T.WS}]*", 0))
    run = F.concat(left, right)
    word = F.regexp_replace(run, f"^[^{ALNUM}]+|[^{ALNUM}]+$", "")
    start = at - F.length(left) + F.length(F.regexp_extract(run, f"^[^{ALNUM}]*", 0))
    before = F.when(start > 0, char(start - 1)).otherwise("")
    inside = before.isin("[", "_") & char(start + F.length(word)).isin("_", "]")
    return F.when((at >= 0) & ~char(at).rlike(space) & (word != "") & ~inside, word)


def units(text: Column) -> Column:
    """Words and numbers, each kept whole, letters apart from digits."""
    return F.regexp_extract_all(text, F.lit(f"({UNIT})"), 1)


def marked(text: Column, values: Column) -> Column:
    """The text in parts, each with whether it is one of the values; a longer value goes before one inside it."""
    known = F.filter(F.array_distinct(values), lambda v: F.length(v) > 0)
    longest = F.array_sort(F.transform(known, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    pattern = F.concat(F.lit("()("), F.array_join(F.transform(longest, lambda k: T.literal(k["v"])), "|"), F.lit(")"))
    cut = F.transform(T.pieces(text, pattern), lambda p, i: F.struct(p.alias("part"), (i % 2 == 1).alias("hit")))
    whole = F.array(F.struct(text.alias("part"), F.lit(False).alias("hit")))
    return F.filter(F.when(F.size(known) > 0, cut).otherwise(whole), lambda x: x["part"] != "")


def blocks_text(blocks: Column) -> Column:
    """Blocks one a line; line ends at a block's end don't count."""
    return F.array_join(F.transform(blocks, lambda b: F.regexp_replace(b, "\\n+$", "")), "\n")


def language(text: Column, fallback: str = "he") -> Column:
    """he or en, by which script has more letters (Hebrew on a tie); the fallback for texts without letters."""
    he, latin = F.regexp_count(text, F.lit(HEBREW)), F.regexp_count(text, F.lit(LATIN))
    return F.when((he == 0) & (latin == 0), fallback).when(he >= latin, "he").otherwise("en")


def without_note(text: Column) -> Column:
    return F.regexp_replace(text, "\\n*—{3,}[\\s\\S]*$", "")


def with_note(text: Column, lang: Column | str = "he", notes: dict[str, str] = NOTES, markers: dict[str, str] = MARKERS) -> Column:
    """The text with its note; one that has a note of either language stays as it is."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    noted = F.contains(text, F.lit(markers["he"])) | F.contains(text, F.lit(markers["en"]))
    return F.when(noted, text).otherwise(F.concat(text, F.when(lang == "en", notes["en"]).otherwise(notes["he"])))


def content_language(text: Column, fallback: str = "he") -> Column:
    """Language of what the user wrote: without the note and the placeholders."""
    return language(F.regexp_replace(without_note(text), LATIN_TOKEN, " "), fallback)


def gold_form(text: Column) -> Column:
    """For comparison with gold surfaces: no quotes, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, GOLD_MARKS, ""), f"[{T.WS}]+", " "), "^ | $", "")


def name_pattern(needle: Column) -> Column:
    """Pattern of a name of two words or more with anything, or nothing, between its words; null for numbers and single words."""
    words = F.filter(F.split(T.strip_controls(needle), NAME_GAP), lambda w: w != "")
    body = F.array_join(F.transform(words, T.literal), f"[{T.WS}\\u2010-\\u2015-]*")
    whole = F.concat(F.lit(f"(?<![{T.WORDISH}])"), body, F.lit(f"(?![{T.WORDISH}])"))
    return F.when((F.size(words) >= 2) & ~T.leak_form(needle).rlike("^[0-9]*$"), whole)


def utf16(text: Column, big: bool = False) -> Column:
    return F.encode(text, "UTF-16BE" if big else "UTF-16LE")


def n_before(starts: Column, place: Column) -> Column:
    """How many of the places lie before this one."""
    return F.size(F.filter(starts, lambda s: s < place))
