"""Exact deduplication by progressive refinement, with DataFrame functions alone.

Round 1 counts texts by length (in 65,536 classes, so that what it broadcasts is bounded), round 2 counts the survivors by
length and hash of the first 64 characters, both on a narrow table; round 3 takes the full SHA-256 of the whole text for what
survives both. Groups
are counted by key and salt first, then by key, and met again by key and salt: copies that make up a third of all rows are
spread over as many tasks as there are salts.

Texts are equal when identical after all of ``[\\x20\\x09-\\x0D]`` is deleted; a null text counts as empty. Of equal texts the
row with the most code points stays, then the one with the smallest doc_id; a null doc_id loses to any other. Exactly one row of a
group stays, of rows alike in doc_id and text too; rows that repeat a doc_id with other texts are judged each. An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows as R
from . import store

LENGTH_CLASSES = 1 << 16
PREFIX = 64
_RARE = "\t\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space. Spaces and line feeds go by plain replacing; the rest is looked for only where it occurs."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    usual = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    whole, rare = usual, F.lit(False)
    for c in _RARE:
        whole, rare = F.replace(whole, F.lit(c), F.lit("")), rare | text.contains(c)
    return F.when(rare, whole).otherwise(usual)


def _keyed(docs: DataFrame, id_col: str, text_col: str, *rest: Callable[[Column], Column]) -> DataFrame:
    """The row's key, points, salt and ``k``: length, prefix hash and ``rest`` of the normalised text, which a lambda binds so that it is made once."""
    salts = max(16, store.partitions(docs.sparkSession))
    k = F.transform(F.array(normalised(F.col(text_col))), lambda x: F.struct(F.length(x).alias("n"), F.xxhash64(F.substring(x, 1, PREFIX)).alias("head"), *(f(x) for f in rest)))[0]
    doc_id = F.col(id_col).cast("long")
    return docs.select(*R.key(id_col, text_col), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).alias("points"), F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int").alias("salt"), k.alias("k"))


def _sha(norm: Column) -> Column:
    return F.sha2(norm, 256).alias("text_sha256")


def prefixes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What survives rounds 1 and 2, a row for each salt: n, head, salt."""
    rows = store.written(_keyed(docs, id_col, text_col).select("k", "salt"), "lengths").select("k.*", "salt")
    by_salt = store.written(rows.groupBy("n", "head", "salt").count(), "heads")
    kind = F.pmod(F.col("n"), F.lit(LENGTH_CLASSES))
    lengths = by_salt.groupBy(kind.alias("kind")).agg(F.sum("count").alias("total")).where("total > 1").select("kind")  # LENGTH_CLASSES rows at most
    by_salt = by_salt.join(F.broadcast(lengths), kind == F.col("kind"), "left_semi")
    found = by_salt.groupBy("n", "head").agg(F.sum("count").alias("total")).where("total > 1").select("n", "head")
    return store.written(by_salt.drop("count").join(found, ["n", "head"]), "prefixes")


def groups(rows: DataFrame) -> DataFrame:
    """Groups of two or more equal texts among rows of ``row, doc_id, points, salt, n, text_sha256``, a row for each salt: n, text_sha256, salt, keep_id, keep_row, group_size."""
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row")))
    by_salt = rows.groupBy("n", "text_sha256", "salt").agg(F.count("*").alias("rows"), best.alias("best"))
    whole = by_salt.groupBy("n", "text_sha256").agg(F.sum("rows").alias("group_size"), F.max("best").alias("best")).where("group_size > 1")
    whole = whole.select("n", "text_sha256", (-F.col("best.minus_id")).alias("keep_id"), (-F.col("best.minus_row")).alias("keep_row"), "group_size")
    return by_salt.select("n", "text_sha256", "salt").join(whole, ["n", "text_sha256"])


def _numbered(rows: DataFrame) -> DataFrame:
    """Written with a number for each row, which tells rows apart that are alike; it is fixed by the write."""
    return store.written(rows.withColumn("row", F.monotonically_increasing_id()), "hashed")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (so here every text is hashed whole, once)."""
    found = prefixes(docs, id_col=id_col, text_col=text_col)
    rows = _numbered(_keyed(docs, id_col, text_col, _sha).select("doc_id", "points", "salt", "k.*"))
    met = groups(rows.join(store.small(found, found.count(), 24), ["n", "head", "salt"], "left_semi"))
    out = rows.join(met, ["n", "text_sha256", "salt"], "left")
    alone = F.col("group_size").isNull()
    kept = (alone | (F.col("row") == F.col("keep_row"))).alias("kept")
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept, "text_sha256")


def kept_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Only texts of groups are hashed whole while the list of prefixes can be broadcast;
    beyond that every text is hashed where it lies, as to shuffle the texts of the groups would cost more."""
    found = prefixes(docs, id_col=id_col, text_col=text_col)
    count = found.count()
    if count * (24 + store.ROW_BYTES) <= store.BROADCAST_BYTES:
        rows = _keyed(docs, id_col, text_col, lambda x: x.alias("norm")).select(*R.KEY, "points", "salt", "k.*")
        rows = rows.join(F.broadcast(found), ["n", "head", "salt"], "left_semi").select(*R.KEY, "points", "salt", "n", _sha(F.col("norm")))
    else:
        rows = _keyed(docs, id_col, text_col, _sha).select(*R.KEY, "points", "salt", "k.*").join(found, ["n", "head", "salt"], "left_semi")
    rows = _numbered(rows.select(*R.KEY, "points", "salt", "n", "text_sha256"))
    verdicts = rows.join(groups(rows), ["n", "text_sha256", "salt"]).select(*R.KEY, (F.col("row") == F.col("keep_row")).alias("kept"))
    return R.kept_rows(docs, verdicts, id_col=id_col, text_col=text_col)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(x) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER (PARTITION BY norm ORDER BY length(x) DESC, doc_id) AS place FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM w
"""
