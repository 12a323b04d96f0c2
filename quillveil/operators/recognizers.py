"""Extractors: text to spans. One table of rules, run in two ways: on Python strings inside the Arrow function that masks (``found``),
and as native expressions (``native``). With the native form alone a query took 5 s to plan and compile; tests hold them equal.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import validators as V

H, WS = T.HWS, T.WS

# Patterns of labels and values.
ID_LABEL = f"(?:ת[\"'׳״.]ז|תעודת[{WS}]+זהות|מספר[{WS}]+זהות|ז[{WS}]*\\.[{WS}]*ת)"
NINE = "[0-9]{9}(?![0-9])"
PHONE = f"\\(?(?:\\+?972[-.{H}()]{{0,2}}|0)(?:[0-9][-.{H}()]{{0,2}}){{7,9}}[0-9](?![A-Za-z0-9_])"
CASE_TYPES = "(?:ע[\"'׳״]א|ע[\"'׳״]פ|רע[\"'׳״]א|רע[\"'׳״]פ|בג[\"'׳״][צץ]|בש[\"'׳״]א|ת[\"'׳״]א|ת[\"'׳״]פ|ה[\"'׳״]פ|דנ[\"'׳״]א|ת\\.[אפ]\\.?)"
LAND = f"גוש[{WS}]*:?[{WS}]*[0-9]{{1,6}}[{WS}]*[,\\-–]?[{WS}]*חלק(?:ה|ות)[{WS}]*:?[{WS}]*[0-9]{{1,5}}(?:[{WS}]*/[{WS}]*[0-9]{{1,4}})?"
NUMBERED = f"(?:[{WS}]+(?:מספר|מס['׳]?))?[{WS}]+"
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}(?![A-Za-z0-9_-])"
CARD = "[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"
US_PHONE = "(?:\\+?1[ .-]?)?(?:\\([2-9][0-9]{2}\\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![A-Za-z0-9_])"
DATE = "[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"


def _number(low: int, high: int) -> str:
    return f"(?<![0-9])[0-9](?:[-{H}]?[0-9]){{{low - 1},{high - 1}}}(?![0-9])"


#: type, label, value, characters after the label in which a value may begin
LABELLED = [
    ("ISRAELI_ID", f"(?:ת[\"'׳״.]ז|תעודת[{WS}]+זהות|מספר[{WS}]+זהות|עוסק[{WS}]+(?:מורשה|פטור))", _number(7, 9), 20),
    ("IL_COMPANY", f"(?:ח[\"'׳״.]פ|מספר[{WS}]+תאגיד)", _number(9, 9), 24),
    ("IL_PASSPORT", "דרכון", _number(6, 9), 24),
    ("IL_BAR", f"(?:מ\\.[{WS}]*ר\\.?|מספר[{WS}]+רישיון(?:[{WS}]+עו[\"'׳״]?ד)?)", _number(3, 7), 12),
    ("DATE_OF_BIRTH", f"(?:יליד(?:ת|ה)?|נולד(?:ה)?|תארי?ך[{WS}]+לידה|ת\\.?[{WS}]*לידה)", DATE, 20),
]


def _after(label: str, window: int) -> str:
    """A label and the characters up to the first value that begins inside the window."""
    return f"{label}[\\s\\S]{{0,{window - 1}}}?"


class Rule(NamedTuple):
    """Matches of ``value`` after ``lead``, where ``before`` holds, whose surface passes ``check``. Texts without any of ``needs`` have none."""

    kind: str
    value: str
    score: float = 1.0
    lead: str = ""
    before: str = ""
    check: str = ""
    needs: tuple[str, ...] = ()


#: Checks of a surface by name: as an expression, and on a string.
CHECKS: dict[str, tuple[Callable[[Column], Column], Callable[[str], bool]]] = {
    "id": (V.israeli_id, V.is_israeli_id),
    "long id": (lambda c: F.length(T.digits(c)).between(8, 9) & V.israeli_id(c), lambda c: 8 <= len(V.only_digits(c)) <= 9 and V.is_israeli_id(c)),
    "company": (V.israeli_company, V.is_israeli_company),
    "phone": (V.israeli_phone, V.is_israeli_phone),
    "iban": (V.israeli_iban, V.is_israeli_iban),
    "card": (V.card, V.is_card),
    "ssn": (V.ssn, V.is_ssn),
}

#: In the order in which their spans come.
RULES = [
    Rule("ISRAELI_ID", NINE, before="(?<![0-9])", check="id"),
    Rule("ISRAELI_ID", f"[0-9](?:[-.{H}]?[0-9]){{6,8}}", lead=_after(ID_LABEL, 25), check="long id", needs=("ת",)),
    Rule("IL_PHONE", PHONE, before="(?<![A-Za-z0-9_+])", check="phone"),
    Rule("IL_COMPANY", NINE, before="(?<![0-9])", check="company"),
    Rule("IL_IBAN", f"(?i:IL)[0-9]{{2}}(?:[-{H}]?[0-9]){{19}}(?![A-Za-z0-9_])", before="(?<![A-Za-z0-9_])", check="iban"),
    *(Rule(kind, value, lead=_after(label, window), needs=needs) for (kind, label, value, window), needs in zip(LABELLED, [("זהות", "ז", "עוסק"), ("פ", "תאגיד"), ("דרכון",), ("מ",), ("ל",)])),
    Rule("IL_CASE", "[0-9]{5,7}-[0-9]{2}-[0-9]{2}(?![0-9])", 0.9, before="(?<![0-9])", needs=("-",)),
    Rule("IL_CASE", "[0-9]{3,7}(?:/[0-9]{2,4})?", 0.9, lead=f"תיק{NUMBERED}", needs=("תיק",)),
    Rule("IL_CASE", "[0-9]{1,6}/[0-9]{2,4}|[0-9]{3,7}-[0-9]{2}-[0-9]{2,4}", 0.9, before="(?<![א-ת])", lead=f"{CASE_TYPES}[{WS}]+", needs=tuple("עבתהד")),
    Rule("IL_LAND", LAND, needs=("גוש",)),
    Rule("IL_POLICY", "[0-9][0-9\\-/]{3,19}", 0.9, lead=f"פוליס(?:ה|ת)(?:[{WS}]+ביטוח)?(?:[{WS}]+(?:מספר|מס['׳]?|שמספרה))?[{WS}]+", needs=("פוליס",)),
    Rule("IL_INSURED", "[0-9]{4,15}", 0.9, lead=f"מבוטח{NUMBERED}", needs=("מבוטח",)),
    Rule("CREDIT_CARD", CARD, before="(?<![0-9-])", check="card"),
    *(Rule("US_SSN", f"[0-9]{{3}}{sep}[0-9]{{2}}{sep}[0-9]{{4}}(?![0-9])", before="(?<![0-9])", check="ssn", needs=(sep,)) for sep in (" ", "-")),
    Rule("US_PHONE", US_PHONE, before="(?<![A-Za-z0-9_+])"),
]
EMAIL_RULE = Rule("EMAIL_ADDRESS", EMAIL, before="(?<![A-Za-z0-9_.%+-])", needs=("@",))
#: What a text must hold for any rule to find something.
CANDIDATE = "[0-9@]|בע[\"'׳״]?מ|ע[\"'׳״]ר"


def rule_spans(text: Column, rule: Rule) -> Column:
    found = T.spans_of(text, rule.value, rule.kind, rule.score, lead=rule.lead, before=rule.before, ok=CHECKS[rule.check][0] if rule.check else None)
    return F.when(F.contains(text, F.lit(rule.needs[0])), found).otherwise(T.no_spans()) if len(rule.needs) == 1 else found


def native(text: Column) -> Column:
    """Spans of every rule but organisations, concatenated in fixed order."""
    return F.concat(F.when(text.rlike("[0-9]"), F.concat(*(rule_spans(text, r) for r in RULES))).otherwise(T.no_spans()), rule_spans(text, EMAIL_RULE))


Found = tuple[int, int, str, float, str | None]


def compiled(rules: Iterable[Rule]) -> list[tuple[Rule, re.Pattern, Callable[[str], bool] | None]]:
    return [(r, re.compile(f"{r.before}({r.lead})({r.value})"), CHECKS[r.check][1] if r.check else None) for r in rules]


_COMPILED = compiled((*RULES, EMAIL_RULE))
_DIGIT = re.compile("[0-9]")
#: Characters that detection reads in another form, by their canonical form or digit; None: looked through.
_FOLDS = T.folds()
_UNUSUAL = re.compile("[^\x00-\x7f\u0590-\u05ea]")


def plain_shadow(text: str) -> tuple[str, list[int] | None]:
    """The text as detection reads it, and where each of its characters comes from (None: each from its own place)."""
    if not _UNUSUAL.search(text):
        return text, None
    out = text.translate(_FOLDS)
    if len(out) == len(text) and not T.INVISIBLE_RE.search(text):
        return out, None
    at = [i for i, c in enumerate(text) for _ in _FOLDS.get(ord(c), c)]
    return out, at


def with_rules(rules: Iterable[Rule]) -> Callable[[str], list[Found]]:
    """Detection by the built-in rules and the caller's own, which come last; the result is a function of a text."""
    own = compiled(rules)
    return lambda text: found(text, own)


def found(text: str, own: Sequence[tuple] = ()) -> list[Found]:
    """Spans of all rules, organisations after them, then those of ``own`` compiled rules, with their places in the text itself."""
    seen, at = plain_shadow(text)
    out: list[Found] = []
    digits = _DIGIT.search(seen) is not None
    for rule, pattern, check in _COMPILED:
        if not (digits or rule is EMAIL_RULE) or rule.needs and not any(n in seen for n in rule.needs):
            continue
        out += [(m.start(2), m.end(2), rule.kind, rule.score, None) for m in pattern.finditer(seen) if check is None or check(m[2])]
    out += [(s["start"], s["end"], s["type"], s["score"], None) for s in organisation_spans(seen)]
    out += [(m.start(2), m.end(2), rule.kind, rule.score, None) for rule, pattern, check in own for m in pattern.finditer(seen) if check is None or check(m[2])]
    return out if at is None else [(at[a], at[b - 1] + 1, *rest) for a, b, *rest in out]


# Words at which a name to the left of a company suffix ends, and words that alone name nobody.
STOP = frozenset(
    """נגד כנגד וכנגד של את עם בין לבין מול כלפי אצל לפי בגין בעניין התובע התובעת התובעים הנתבע הנתבעת הנתבעים בשם מטעם ידי וכן וגם
    אל על אשר כי היא הוא זו זה לפיכך לכן ולכן משכך ומשכך לאור בהתאם כאמור מאחר הואיל אולם ברם כאשר כמו ואילו וכ כן
    הגיש הגישה הגישו הודיע הודיעה הודיעו פנה פנתה פנו טען טענה טענו שילם שילמה שילמו ביקש ביקשה ביקשו דרש דרשה דרשו רכש רכשה רכשו
    מכר מכרה מכרו התחייב התחייבה סירב סירבה אישר אישרה הסכים הסכימה קבע קבעה חתם חתמה הצהיר הצהירה קיבל קיבלה מדובר נמסר נטען נחתם נקבע""".split()
)
GENERIC = frozenset("חברה החברה בחברה לחברה מחברה מהחברה וחברה תאגיד התאגיד עסק העסק הגוף הצד הצדדים".split())
SUFFIX = re.compile("(?<![A-Za-zא-ת])(?:בע[\"'׳״]?מ|ע[\"'׳״]ר)(?![A-Za-zא-ת])")
NAME = re.compile("[A-Za-zא-ת][A-Za-zא-ת'׳\"״־-]*")
MOST_WORDS, LOOK_BACK = 4, 80


def organisation_spans(text: str | None) -> list[dict]:
    """Names that end in a company suffix: up to four words to its left, joined by spaces."""
    out = []
    for suffix in SUFFIX.finditer(text or ""):
        edge, names = suffix.start(), []
        low = max(0, edge - LOOK_BACK)
        for m in reversed(list(NAME.finditer(text[low:edge]))):
            gap = text[low + m.end() : edge]
            if len(names) == MOST_WORDS or gap.strip(" \t") or m[0] in STOP or len(m[0]) == 1:
                break
            names.append(m[0])
            edge = low + m.start()
        if names and not GENERIC.issuperset(names):
            out.append({"start": edge, "end": suffix.end(), "type": "ORGANIZATION", "score": 0.9, "label": None})
    return out


@F.pandas_udf(T.SPANS_TYPE)
def _organisations(texts: pd.Series) -> pd.Series:
    return texts.map(organisation_spans)


def organisations(text: Column) -> Column:
    """Python sees only texts that hold a suffix."""
    hit = text.rlike(SUFFIX.pattern)
    return F.when(hit, F.coalesce(_organisations(F.when(hit, text)), T.no_spans())).otherwise(T.no_spans())


def manual(text: Column, terms: list[tuple[str, str | None]]) -> Column:
    """Every occurrence of the user's terms, not glued to a character of the same class (digit or letter)."""
    out = [T.no_spans()]
    for value, label in terms:
        value = value.strip()
        if value:
            edge = lambda c: "[0-9]" if c.isdigit() else "\\p{L}" if c.isalpha() else "(?!)."
            found = T.spans_of(text, "\\Q" + value.replace("\\E", "\\E\\\\E\\Q") + f"\\E(?!{edge(value[-1])})", "MANUAL", before=f"(?<!{edge(value[0])})")
            out.append(_labelled(found, label))
    return F.concat(*out)


def _labelled(spans: Column, label: str | None) -> Column:
    return F.transform(spans, lambda s: T.span(s["start"], s["end"], s["type"], s["score"], F.lit(label)))


# Tags of a named-entity model.
NER_TYPES = {"PER": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION"}


# Points of Hebrew letters, letters in which a cut word goes on.
POINTS, LETTERS = re.compile("[\u0591-\u05C7]"), {"he": re.compile("[א-ת]"), "en": re.compile("[A-Za-z]")}
_SPACE_RUN = re.compile(f"[{WS}]+")


def _search_form(text: str) -> tuple[str, list[int]]:
    """A text without points and with single spaces, and where each character comes from."""
    out, at = [], []
    for k, c in enumerate(text):
        if POINTS.match(c):
            continue
        if _SPACE_RUN.match(c):
            if k and _SPACE_RUN.match(text[k - 1]):
                continue
            c = " "
        out.append(c)
        at.append(k)
    return "".join(out), at


def align_ner(text: str, raw: Sequence[dict], lang: str | None = None) -> list[dict]:
    """Raw model output (raw tag, surface, score) as spans: found in order from a running cursor, else at its first place, else dropped.

    Points and runs of white space don't matter; a match goes on through letters of the model's language (of the surface's, if None).
    """
    seen, at = _search_form(text)
    out, cursor = [], 0
    for r in raw:
        kind = NER_TYPES.get(re.sub("^[BIES]-", "", r["raw"] or ""))
        words = _SPACE_RUN.sub(" ", POINTS.sub("", re.sub(" ?##", "", r["surface"] or ""))).strip()
        if not kind or not words:
            continue
        start = seen.find(words, cursor)
        start = start if start >= 0 else seen.find(words)
        if start < 0:
            continue
        end = at[start + len(words) - 1] + 1
        letters = LETTERS[lang or ("he" if LETTERS["he"].search(words) else "en")]
        while end < len(text) and letters.match(text[end]):
            end += 1
        out.append({"start": at[start], "end": end, "type": kind, "score": float(r["score"]), "label": None})
        cursor = start + len(words)
        while cursor < len(at) and at[cursor] < end:
            cursor += 1
    return out


@F.pandas_udf(T.SPANS_TYPE)
def ner_spans(texts: pd.Series, raw: pd.Series) -> pd.Series:
    """Spans of recorded model output: ``raw`` is an array of (raw, surface, score)."""
    return pd.Series([align_ner(t or "", [] if r is None else [dict(x) for x in r]) for t, r in zip(texts, raw)])
