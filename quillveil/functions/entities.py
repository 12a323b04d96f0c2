"""Entity types: label, priority, family, structured or not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type, label in placeholders, priority, family that switches it, whether a survivor of it always counts as a leak.
TYPES = [
    ("MANUAL", "TERM", 4, None, False),
    ("ISRAELI_ID", "ID", 3, "identifiers", True),
    ("IL_COMPANY", "COMPANY", 3, "identifiers", True),
    ("IL_PASSPORT", "PASSPORT", 3, "identifiers", False),
    ("IL_BAR", "BAR", 3, "identifiers", False),
    ("DATE_OF_BIRTH", "DOB", 3, "identifiers", False),
    ("IL_PHONE", "PHONE", 3, "contact", True),
    ("IL_IBAN", "IBAN", 3, "financial", True),
    ("IL_CASE", "CASE", 3, "financial", True),
    ("IL_LAND", "LAND", 3, "financial", True),
    ("IL_POLICY", "POLICY", 3, "financial", True),
    ("IL_INSURED", "INSURED", 3, "financial", True),
    ("EMAIL_ADDRESS", "EMAIL", 3, "contact", True),
    ("CREDIT_CARD", "CARD", 3, None, False),
    ("US_SSN", "SSN", 3, None, False),
    ("US_PHONE", "USPHONE", 3, None, False),
    ("PERSON", "NAME", 2, "people", False),
    ("ORGANIZATION", "ORG", 1, "places", False),
    ("LOCATION", "LOC", 1, "places", False),
    ("IL_NUMBER", "NUM", 1, "numbers", True),
]
NAMES = [t[0] for t in TYPES]
#: Order of types on equal spans: by name, but an id comes directly before a phone.
TIE_ORDER = sorted(set(NAMES) - {"ISRAELI_ID"})
TIE_ORDER.insert(TIE_ORDER.index("IL_PHONE"), "ISRAELI_ID")


def _case(kind: Column, values: dict, default) -> Column:
    return reduce(lambda c, kv: c.when(kind == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(kind == next(iter(values)), F.lit(next(iter(values.values()))))).otherwise(default)


def label_of(kind: Column, own: Column | None = None) -> Column:
    usual = _case(kind, {t[0]: t[1] for t in TYPES}, kind)
    return usual if own is None else F.coalesce(own, usual)


def priority(kind: Column) -> Column:
    return _case(kind, {t[0]: t[2] for t in TYPES}, F.lit(0))


def tie_rank(kind: Column) -> Column:
    return _case(kind, {t: k for k, t in enumerate(TIE_ORDER)}, F.lit(len(TIE_ORDER)))


def family_of(kind: Column) -> Column:
    return _case(kind, {t[0]: t[3] for t in TYPES if t[3]}, F.lit(None))


def structured(kind: Column) -> Column:
    return kind.isin([t[0] for t in TYPES if t[4]])


def toggled(disabled: Column, family: str) -> Column:
    """Disabled types after a family's switch: all on if all were off, else all off."""
    own = F.array(*(F.lit(t[0]) for t in TYPES if t[3] == family))
    return F.when(F.size(F.array_except(own, disabled)) == 0, F.array_except(disabled, own)).otherwise(F.array_union(disabled, own))


def family_off(disabled: Column, family: str) -> Column:
    """Whether all types of a family are off."""
    own = F.array(*(F.lit(t[0]) for t in TYPES if t[3] == family))
    return F.size(F.array_except(own, disabled)) == 0


def known_types(disabled: Column) -> Column:
    return F.array_intersect(disabled, F.array(*map(F.lit, NAMES)))
