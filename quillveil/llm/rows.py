"""Verdicts on rows, carried out on tables whose doc_ids may repeat.

A row is known by its doc_id, the 64-bit hash of its text and the text's bytes, so two texts under one doc_id are two rows. Rows
alike in all three are copies of one row; where one of them stays, it is the one whose columns come first as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

KEY = ("doc_id", "mark", "bytes")


def key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """The columns of KEY; a null text is none of the empty ones."""
    text = F.col(text_col).cast("string")
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("bytes")]


def kept_rows(docs: DataFrame, verdicts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. ``verdicts``: KEY and kept, for each row that is judged; others stay.

    The list of what goes is broadcast if its size allows; no text is shuffled then, but for copies of which one stays.
    """
    goes = verdicts.groupBy(*KEY).agg(F.count("*").alias("rows"), F.sum(F.col("kept").cast("long")).alias("stay")).where("stay < rows")
    goes = store.written(goes.select(*(F.col(c).alias(f"gone_{c}") for c in KEY), "stay"), "verdicts")
    count, halved = goes.agg(F.count("*"), F.coalesce(F.sum((F.col("stay") > 0).cast("long")), F.lit(0))).first()
    names = [f"`{c}`" for c in docs.columns]
    own = docs.select(*names, *(c.alias(f"quillveil_{n}") for n, c in zip(KEY, key(id_col, text_col))))
    same = [F.col(f"quillveil_{c}").eqNullSafe(F.col(f"gone_{c}")) for c in KEY]
    same = same[0] & same[1] & same[2]
    out = own.join(store.small(goes, count, 32), same, "left_anti").select(*names)
    if halved:
        copies = own.join(store.small(goes.where("stay > 0"), halved, 32), same, "left_semi")
        whole = F.struct(*names)
        first = copies.groupBy(*(f"quillveil_{c}" for c in KEY)).agg(F.min_by(whole, F.to_json(whole)).alias("quillveil_row"))
        out = out.unionByName(first.select("quillveil_row.*"))
    return out
