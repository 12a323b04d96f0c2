"""How well detection does against gold: recall and precision of recorded spans, and of masking on texts with values to hide and to keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import placeholders as P


def covers(detected: Column, gold: Column) -> Column:
    """Whether two surfaces of one thing: either holds the other, quotes and spaces aside."""
    d, g = P.gold_form(detected), P.gold_form(gold)
    return (F.length(g) > 0) & (F.contains(d, g) | F.contains(g, d))


def matched(left: DataFrame, right: DataFrame, *keys: str, gold_left: bool) -> DataFrame:
    """The rows of ``left`` (keys, type, surface) that a row of ``right`` with the same keys and type covers."""
    r = right.select(*(F.col(k).alias(f"r_{k}") for k in (*keys, "type")), F.col("surface").alias("r_surface"))
    on = covers(F.col("r_surface"), F.col("surface")) if gold_left else covers(F.col("surface"), F.col("r_surface"))
    for k in (*keys, "type"):
        on = (F.col(k) == F.col(f"r_{k}")) & on
    return left.join(r, on, "left_semi")


def tallies(gold: DataFrame, detected: DataFrame, *keys: str, types: Sequence[str] = ("PERSON", "ORGANIZATION", "LOCATION")) -> DataFrame:
    """Per type, and for all: gold_total, gold_matched, detected_total, detected_matched, recall, precision. Other types don't count."""
    gold, detected = (t.where(F.col("type").isin(*types)) for t in (gold, detected))
    sides = {"gold_total": gold, "gold_matched": matched(gold, detected, *keys, gold_left=True), "detected_total": detected, "detected_matched": matched(detected, gold, *keys, gold_left=False)}
    rows = None
    for name, side in sides.items():
        one = side.groupBy("type").agg(F.count("*").alias("n")).select("type", F.lit(name).alias("side"), "n")
        rows = one if rows is None else rows.unionByName(one)
    sums = [F.coalesce(F.sum(F.when(F.col("side") == name, F.col("n"))), F.lit(0)).alias(name) for name in sides]
    out = rows.rollup("type").agg(*sums).withColumn("type", F.coalesce("type", F.lit("all")))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({"recall": rate("gold_matched", "gold_total"), "precision": rate("detected_matched", "detected_total")})


def caught(masked: DataFrame, text: str = "anonymized", hide: str = "redact", keep: str = "keep") -> DataFrame:
    """Adds missed (values that still stand in the masked text) and spoiled (values that should stand and don't)."""
    body = F.col(text)
    return masked.withColumns({"missed": F.filter(hide, lambda v: F.contains(body, v)), "spoiled": F.filter(keep, lambda v: ~F.contains(body, v))})


def recall(masked: DataFrame, **columns: str) -> DataFrame:
    """One row: texts, recall (share of texts with nothing missed), clean (share with nothing spoiled)."""
    rows = caught(masked, **columns)
    share = lambda c: F.avg((F.size(c) == 0).cast("double"))
    return rows.agg(F.count("*").alias("texts"), share("missed").alias("recall"), share("spoiled").alias("clean"))


def medians(runs: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median of repeated measurements."""
    return runs.groupBy(*keys).agg(F.median(value).alias("median"), F.count("*").alias("runs"))
