"""Checks of numbers, as expressions, and the same on Python strings for Arrow functions (``is_``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits


def israeli_id(raw: Column) -> Column:
    d = digits(raw)
    return F.length(d).between(1, 9) & ~F.lpad(d, 9, "0").eqNullSafe("000000000") & F.call_function("luhn_check", F.lpad(d, 9, "0"))


def israeli_company(raw: Column) -> Column:
    d = digits(raw)
    return (F.length(d) == 9) & d.startswith("5") & F.call_function("luhn_check", d)


def phone_digits(raw: Column) -> Column:
    """National form: the trunk prefix 972 becomes 0; a 0 after it stays and makes the number invalid."""
    return F.regexp_replace(F.regexp_replace(raw, "[^0-9+]", ""), "^\\+?972", "0")


def israeli_phone(raw: Column) -> Column:
    return phone_digits(raw).rlike("^0(?:5[0-9]|7[2-9])[0-9]{7}$|^0[2-489][0-9]{7}$")


def israeli_iban(raw: Column) -> Column:
    c = F.upper(F.regexp_replace(raw, "[^0-9A-Za-z]", ""))
    number = F.concat(F.substring(c, 5, 19), F.lit("1821"), F.substring(c, 3, 2))
    return F.when(c.rlike("^IL[0-9]{21}$"), number.try_cast("decimal(38,0)") % 97 == 1).otherwise(False)


def card(raw: Column) -> Column:
    d = digits(raw)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def ssn(raw: Column) -> Column:
    d = digits(raw)
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


_NOT_DIGIT = re.compile("[^0-9]")
_PLAN = re.compile("0(?:5[0-9]|7[2-9])[0-9]{7}|0[2-489][0-9]{7}")


def only_digits(raw: str) -> str:
    return _NOT_DIGIT.sub("", raw)


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_israeli_id(raw: str) -> bool:
    d = only_digits(raw)
    return 1 <= len(d) <= 9 and d.strip("0") != "" and luhn(d)


def is_israeli_company(raw: str) -> bool:
    d = only_digits(raw)
    return len(d) == 9 and d[0] == "5" and luhn(d)


def is_israeli_phone(raw: str) -> bool:
    return _PLAN.fullmatch(re.sub("^\\+?972", "0", re.sub("[^0-9+]", "", raw))) is not None


def is_israeli_iban(raw: str) -> bool:
    c = re.sub("[^0-9A-Za-z]", "", raw).upper()
    return re.fullmatch("IL[0-9]{21}", c) is not None and int(c[4:] + "1821" + c[2:4]) % 97 == 1


def is_card(raw: str) -> bool:
    d = only_digits(raw)
    return 13 <= len(d) <= 19 and luhn(d)


def is_ssn(raw: str) -> bool:
    d = only_digits(raw)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
