"""Functions for Spark SQL: detection, masking and restoring of a text, and the public checks of numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import validators as V
from . import document, masking, recognizers

CHECKS = {"is_israeli_id": V.is_israeli_id, "is_israeli_company": V.is_israeli_company, "is_israeli_phone": V.is_israeli_phone, "is_israeli_iban": V.is_israeli_iban, "is_card": V.is_card, "is_ssn": V.is_ssn}


@F.pandas_udf(masking._ROW)
def mask_text(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        used, key, out = document.process(t, recognizers.found(t)) if t is not None else ([], [], None)
        rows.append(([dict(zip(("start", "end", "type", "score", "label"), s)) for s in used], [dict(zip(("placeholder", "original", "type"), k)) for k in key], out))
    return pd.DataFrame(rows, columns=["spans", "key", "anonymized"])


@F.udtf(returnType="start int, end int, type string, score double, value string")
class DetectedSpans:
    """A row for each span that the rules find in a text."""

    def eval(self, text: str):
        for a, b, kind, score, _ in document.resolved(recognizers.found(text)) if text else ():
            yield a, b, kind, score, text[a:b]


def _check(name: str):
    plain = CHECKS[name]

    @F.pandas_udf(K.BooleanType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else plain(v))

    return run


def register(spark: SparkSession, prefix: str = "qv_") -> list[str]:
    """Registers the functions; returns their names. ``qv_mask(text)`` gives spans, key and anonymized, ``qv_spans(text)`` is a table
    function, ``qv_shadow(text)`` the text as detection reads it, the others check a number."""
    spark.udf.register(f"{prefix}mask", mask_text)
    spark.udtf.register(f"{prefix}spans", DetectedSpans)
    spark.udf.register(f"{prefix}shadow", F.pandas_udf(lambda s: s.map(lambda t: None if t is None else recognizers.plain_shadow(t)[0]), K.StringType()))
    for name in CHECKS:
        spark.udf.register(f"{prefix}{name}", _check(name))
    return [f"{prefix}{n}" for n in ("mask", "spans", "shadow", *CHECKS)]

