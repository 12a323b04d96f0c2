"""Quality rules: base limits, then gradient-boosted trees over document statistics.

The statistics of a batch come from numpy passes over its bytes, words and lines. The trees are fitted on the driver on at most
``MAX_LABELLED`` labelled documents (those with the smallest hash of their doc_id), scored on the executors from node arrays.
The score may only fall as symbols, repeated lines, repeated words or upper-case letters get more.

Defined results: a null or empty text has no words and fails the base limits; without labels of both classes the base limits
alone decide; rows that repeat a doc_id are judged each, and one of them (least label, then least statistics) is fitted on; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, trees

MAX_LABELLED = 20_000
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
THRESHOLD = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeated", "upper", "digits", "marks", "distinct", "line_words", "stops")
MONOTONE = {FEATURES.index(f): -1 for f in ("symbols", "dup_lines", "repeated", "upper")}
_KINDS = {"symbol": b"#*$%&|<>", "space": b" \t\n\x0b\x0c\r", "upper": bytes(range(65, 91)), "digit": b"0123456789", "mark": b"!?;:,.\"'()-", "stop": b".!?"}


def statistics(col: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts and the feature matrix of the texts (no nulls)."""
    rows = len(col)
    raw = pc.cast(col, pa.binary())
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64))])
    first = np.frombuffer(raw.buffers()[1], np.int32, rows + 1, 4 * raw.offset)[0] if rows else 0
    data = np.frombuffer(raw.buffers()[2], np.uint8, int(ends[-1]), int(first)) if ends[-1] else np.empty(0, np.uint8)

    def bytes_in(kind: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(_KINDS[kind])] = True
        return arrow.segment_sums(table[data], ends)

    points = np.diff(ends) - arrow.segment_sums((data & 0xC0) == 0x80, ends)
    flat, offsets = arrow.words(col)
    n = np.diff(offsets)
    row = arrow.row_of(offsets)
    codes = arrow.coded(flat)[0].astype(np.uint64) if len(flat) else np.empty(0, np.uint64)
    here = arrow.mixed(row.astype(np.uint64) + np.uint64(1))
    windows = arrow.rolled(codes + np.uint64(1), WINDOW)
    inside = np.flatnonzero(row[: len(windows)] == row[len(row) - len(windows) :]) if len(windows) else np.empty(0, np.int64)
    repeat = np.zeros(len(row) + 1, np.int64)
    if len(inside):
        _, which, often = np.unique(windows[inside] ^ here[inside], return_inverse=True, return_counts=True)
        again = inside[often[which] > 1]
        np.add.at(repeat, again, 1)
        np.add.at(repeat, again + WINDOW, -1)
    repeated = arrow.segment_sums(repeat.cumsum()[:-1] > 0, offsets)
    distinct = np.zeros(rows, np.int64)
    if len(flat):
        np.add.at(distinct, (np.unique(row.astype(np.uint64) << np.uint64(32) | codes) >> np.uint64(32)).astype(np.int64), 1)

    parts = pc.split_pattern(col, "\n")
    at = parts.offsets.to_numpy().astype(np.int64)
    lines = parts.values.slice(at[0], at[-1] - at[0])
    line_row = arrow.row_of(at - at[0])
    line, texts = arrow.coded(lines) if len(lines) else (np.empty(0, np.int64), pa.array([], pa.string()))
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)[line] if len(lines) else np.empty(0, bool)
    key = line_row[worded] * (len(texts) + 1) + line[worded]
    n_lines = np.bincount(line_row[worded], minlength=rows)
    dup_lines = n_lines - np.bincount(np.unique(key) // (len(texts) + 1), minlength=rows)

    counts = dict(zip(COUNTS, (n, points - bytes_in("space"), bytes_in("symbol"), dup_lines, repeated)))
    some, chars = np.maximum(n, 1), np.maximum(counts["word_chars"], 1)
    features = np.stack(
        [np.log1p(n), counts["word_chars"] / some, counts["n_symbols"] / some, dup_lines / np.maximum(n_lines, 1), repeated / some, bytes_in("upper") / chars]
        + [bytes_in("digit") / chars, bytes_in("mark") / some, distinct / some, n / np.maximum(n_lines, 1), bytes_in("stop") / some], 1
    ).astype(np.float64)
    return counts, features


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow.forget()
    for batch, col in arrow.sliced(batches, "text", 2 << 20):
        counts, x = statistics(col)
        ok = ~base_failed(counts)
        yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(pa.array(ok)) for k in (0, 1)), pa.FixedSizeListArray.from_arrays(x[ok].ravel(), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> trees.Forest | None:
    """Trees fitted on at most ``most`` labelled documents that pass the base limits; None without both classes."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna()
    own = own.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
    rows = arrow.modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(own), "doc_id")
    seen = rows.select("doc_id", "y", "text").mapInArrow(_features, "doc_id long, y int, x array<double>")
    got = seen.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("first")).select("doc_id", "first.*").toPandas()  # at most ``most`` rows of a few numbers
    got = got.sort_values("doc_id")
    y = got["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    return trees.fit(np.stack(got["x"].to_list()), (y > 0).astype(float), MONOTONE)


def verdicts(counts: dict[str, np.ndarray], x: np.ndarray, forest: trees.Forest | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, score (probability of good quality), kept."""
    failed = base_failed(counts)
    score = 1 / (1 + np.exp(-forest.margin(x))) if forest else np.ones(len(x))
    return failed, score, ~failed & (score >= threshold)


def judged(docs: DataFrame, forest: trees.Forest | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.forget()
        for batch, col in arrow.sliced(batches, "text", 2 << 20):
            counts, x = statistics(col)
            failed, score, kept = verdicts(counts, x, forest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    rows = arrow.modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")


def kept_rows(docs: DataFrame, forest: trees.Forest | None, *, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.forget()
        for batch, col in arrow.sliced(batches, text_col, 2 << 20):
            yield batch.filter(pa.array(verdicts(*statistics(col), forest)[2]))

    return arrow.modest(docs).mapInArrow(run, docs.schema)
