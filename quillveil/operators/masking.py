"""Placeholders: masking texts with their spans, restoring them from a key, numbering over a session."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T
from . import document, recognizers

KEY = "array<struct<placeholder:string,original:string,type:string>>"


_ROW = K.StructType([K.StructField("spans", T.SPANS_TYPE), K.StructField("key", K.ArrayType(K.StructType([K.StructField(c, K.StringType()) for c in ("placeholder", "original", "type")]))), K.StructField("anonymized", K.StringType())])


def _processed(excluded: Sequence[str], disabled: Sequence[str], remainders: bool, detect: bool, resolve: bool = True):
    @F.pandas_udf(_ROW)
    def run(texts: pd.Series, given: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, given):
            if text is None or own is None and not detect:
                rows.append((None, None, None))
                continue
            found = recognizers.found(text) if detect else []
            found += [(s["start"], s["end"], s["type"], s["score"], s["label"]) for s in own] if own is not None else []
            if not found:
                rows.append((None, None, None))
                continue
            used, key, out = document.process(text, found, excluded, disabled, remainders) if resolve else (found, *reversed(document.masked(text, found)))
            rows.append(([dict(zip(("start", "end", "type", "score", "label"), s)) for s in used], [dict(zip(("placeholder", "original", "type"), k)) for k in key], out))
        return pd.DataFrame(rows, columns=["spans", "key", "anonymized"])

    return run


def mask(df: DataFrame, given: Column | None, text: str = "text", excluded: Sequence[str] = (), disabled: Sequence[str] = (), remainders: bool = False, detect: bool = False, resolve: bool = True) -> DataFrame:
    """Adds spans, key and anonymized from the spans ``given`` and, with ``detect``, those of all rules; Python sees only rows that may have some. Without ``resolve`` the given spans, in order and apart, are masked as they are."""
    own = given if given is not None else F.lit(None).cast(T.SPANS)
    some = F.coalesce(F.size(own) > 0, F.lit(False))
    some = some | F.col(text).rlike(recognizers.CANDIDATE) | F.col(text).rlike(T.UNUSUAL) if detect else some
    df = df.withColumn("_row", _processed(tuple(excluded), tuple(disabled), remainders, detect, resolve)(F.when(some, F.col(text)), F.when(some, own)))
    df = df.withColumns({"spans": F.coalesce("_row.spans", T.no_spans()), "key": F.coalesce("_row.key", F.expr(f"cast(array() as {KEY})")), "anonymized": F.coalesce("_row.anonymized", F.col(text))})
    return df.drop("_row")


@F.pandas_udf(T.SPANS_TYPE)
def _found(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [dict(zip(("start", "end", "type", "score", "label"), s)) for s in recognizers.found(t)])


def with_found(df: DataFrame, text: str, out: str = "_found") -> DataFrame:
    """Adds all spans of all rules, found on the text's shadow."""
    some = F.col(text).rlike(recognizers.CANDIDATE) | F.col(text).rlike(T.UNUSUAL)
    return df.withColumn(out, F.coalesce(_found(F.when(some, F.col(text))), T.no_spans()))


def with_found_native(df: DataFrame, text: str, out: str = "_found") -> DataFrame:
    """The same as expressions (but for the organisation walk); long to plan, and characters whose canonical form is longer aren't folded."""
    df = df.withColumn("_shadow", T.shadow(F.col(text)))
    df = df.withColumn("_seen", F.concat(recognizers.native(F.col("_shadow")), recognizers.organisations(F.col("_shadow"))))
    return df.withColumn(out, T.from_shadow(F.col(text), F.col("_seen"))).drop("_shadow", "_seen")


def anonymize_deterministic(df: DataFrame, text: str = "text") -> DataFrame:
    """Detect, resolve, complete, resolve, mask."""
    return mask(df, None, text, detect=True)


def anonymize_with(df: DataFrame, extra: Column | None = None, excluded: Sequence[str] = (), disabled: Sequence[str] = (), terms: Sequence[tuple[str, str | None]] = (), text: str = "text") -> DataFrame:
    """As above with the caller's spans and terms, remainders kept, and the filter before resolving, after it and after completion."""
    more = [*([extra] if extra is not None else []), *([recognizers.manual(F.col(text), list(terms))] if terms else [])]
    return mask(df, F.concat(*more) if more else None, text, excluded, disabled, True, True)


def anonymize_manual(df: DataFrame, terms: Sequence[tuple[str, str | None]], text: str = "text") -> DataFrame:
    return mask(df, recognizers.manual(F.col(text), list(terms)), text)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` looks at it."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def restored(text: Column, key: Column) -> tuple[Column, Column]:
    """The text with every known placeholder replaced (cosmetic changes allowed; of equal ones the last row holds), and the unknown ones."""
    known = F.transform(F.reverse(key), lambda k: F.struct(T.placeholder_key(k["placeholder"]).alias("token"), k["original"].alias("original")))

    def original(rows: Column, p: Column) -> Column:
        return _bound(T.placeholder_key(p), lambda q: F.try_element_at(F.filter(rows, lambda k: T.same_placeholder(k["token"], q)), F.lit(1))["original"])

    def whole(rows: Column) -> Column:
        return F.array_join(F.transform(T.pieces(text, T.TOKEN), lambda p, i: F.when(i % 2 == 1, F.coalesce(original(rows, p), p)).otherwise(p)), "")

    def unknown(rows: Column) -> Column:
        return F.filter(T.placeholders(text), lambda p: original(rows, p).isNull())

    return F.when(text.contains("["), _bound(known, whole)).otherwise(text), _bound(known, unknown)
