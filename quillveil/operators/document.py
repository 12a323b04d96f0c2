"""What happens to one document's spans after detection: resolution, completion, numbering, masking.

These steps look at each other's results in order; as nested expressions 1,500 short rows took 22 s, mostly to compile, so they are
one Arrow function over the rows that have spans. Detection before it and restoring after it stay expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

from ..functions.entities import TIE_ORDER, TYPES

LABEL = {t[0]: t[1] for t in TYPES}
PRIORITY = {t[0]: t[2] for t in TYPES}
TIE = {t: k for k, t in enumerate(TIE_ORDER)}
# White space, letters and digits of words, marks that don't tell placeholders apart.
SPACE = "\t\n\x0b\f\r \xa0  -     　﻿"
WORD = "A-Za-z0-9֐-׿"
TOKEN = re.compile(f"\\[[^\\[\\]]*_[0-9]+[{SPACE}]*\\]")
COSMETIC = re.compile(f"[‎‏‪-‮⁦-⁩\"'`״׳“”‟‘’{SPACE}]")

Span = tuple[int, int, str, float, str | None]


def overlap(a: Span, b: Span) -> bool:
    return a[0] < b[1] and b[0] < a[1]


def resolved(found: Iterable[Span]) -> list[Span]:
    """The strongest spans that don't overlap: by priority, score, length, place, type, then as they came."""
    kept: list[Span] = []
    for s in sorted(found, key=lambda s: (-PRIORITY.get(s[2], 0), -s[3], s[0] - s[1], s[0], TIE.get(s[2], len(TIE)), s[2])):
        if not any(overlap(k, s) for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[:2])


def with_remainders(text: str, found: list[Span]) -> list[Span]:
    """As ``resolved``; what the winners leave of a loser stays a span, trimmed."""
    winners, rests = resolved(found), []
    for s in found:
        if s in winners:
            continue
        at = s[0]
        for w in [*(w for w in winners if overlap(w, s)), (s[1], s[1], "", 0.0, None)]:
            a, b = at, w[0]
            while a < b and text[a] in _SPACES:
                a += 1
            while b > a and text[b - 1] in _SPACES:
                b -= 1
            if a < b:
                rests.append((a, b, *s[2:]))
            at = max(at, w[1])
    return resolved([*winners, *rests]) if rests else winners


_SPACES = frozenset(c for c in map(chr, range(0x10000)) if re.match(f"[{SPACE}]", c))


def completed(text: str, found: list[Span]) -> list[Span]:
    """Every whole-word occurrence of each surface, overlapping ones too; labels aren't carried over."""
    out = []
    for kind, words, score in dict.fromkeys((s[2], text[s[0] : s[1]], s[3]) for s in found):
        if words.strip():
            pattern = re.compile(f"(?<![{WORD}])(?={re.escape(words)}(?![{WORD}]))")
            out += [(m.start(), m.start() + len(words), kind, score, None) for m in pattern.finditer(text)]
    return out


def plain_token(token: str) -> str:
    """A placeholder in canonical form, without marks that don't tell placeholders apart."""
    return COSMETIC.sub("", token if token.isascii() else unicodedata.normalize("NFC", token))


def masked(text: str, used: list[Span]) -> tuple[str, list[tuple[str, str, str]]]:
    """The masked text and its key in order of appearance; numbers whose placeholder is in the text already are skipped."""
    taken = {plain_token(t) for t in TOKEN.findall(text)}
    tokens: dict[tuple[str, str], str] = {}
    key, out, at, last = [], [], 0, {}
    for start, end, kind, _, label in used:
        name, words = label or LABEL.get(kind, kind), text[start:end]
        if (name, words) not in tokens:
            n = last.get(name, 0) + 1
            while plain_token(f"[{name}_{n}]") in taken:
                n += 1
            last[name] = n
            tokens[name, words] = f"[{name}_{n}]"
            key.append((tokens[name, words], words, kind))
        out += [text[at:start], tokens[name, words]]
        at = end
    return "".join([*out, text[at:]]), key


def process(text: str, found: list[Span], excluded: Sequence[str] = (), disabled: Sequence[str] = (), remainders: bool = False) -> tuple[list[Span], list[tuple[str, str, str]], str]:
    """Filter, resolve, filter, complete, filter, resolve, mask. A disabled type must not suppress another, so the filter runs three times."""
    off = lambda s: s[2] != "MANUAL" and (s[2] in disabled or text[s[0] : s[1]] in excluded)
    open_ = [s for s in found if not off(s)]
    base = [s for s in (with_remainders(text, open_) if remainders else resolved(open_)) if not off(s)]
    used = resolved([*base, *(s for s in completed(text, base) if not off(s))])
    return used, *reversed(masked(text, used))
