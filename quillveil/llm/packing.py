"""Best-fit packing by minimum bin slack.

Only the lengths of the pieces matter, and there are at most ``size`` different ones, so the bins are found on their histogram:
the longest piece left opens a bin, a subset-sum bitset over the lengths left finds the fullest combination for the rest of it,
and that combination is taken out as often as the histogram allows. The number of steps depends on the number of lengths, not
of pieces. The pieces then find their places by their rank within their length, which is counted in buckets and so never needs
one length's pieces in one task.

Defined results: null and empty texts have the end id alone; rows repeated in the input are packed each; an empty table gives
no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrow, store, tokens


def _fill(left: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The fullest combination of at most ``room``: how many pieces of each length."""
    bits, steps, mask = 1, [], (1 << room + 1) - 1
    for length in order:  # long ones first: they are the hardest to place later
        if length > room or not left[length]:
            continue
        most, k = min(left[length], room // length), 1
        while most:
            k = min(k, most)
            steps.append((length, k, bits))
            bits |= bits << k * length & mask
            most, k = most - k, 2 * k
        if bits >> room & 1:
            break
    full, out = bits.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> full & 1:
            out[length] = out.get(length, 0) + k
            full -= k * length
    return out


def plan(counts: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: columns length, first_rank, per_bin, first_bin, offset, by length and first_rank.

    Piece number r of a length, from first_rank on, lies in bin first_bin + (r - first_rank) // per_bin, at offset plus length
    times the remainder.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= size for n in left):
        raise ValueError(f"lengths must be 1 to {size}")
    order, used, rows, bins = sorted(left, reverse=True), dict.fromkeys(left, 0), [], 0
    while order:
        longest = order[0]
        left[longest] -= 1
        chosen = _fill(left, order, size - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times, at = min(left[n] // k for n, k in chosen.items()), 0
        for n in sorted(chosen, reverse=True):
            rows.append((n, used[n], chosen[n], bins, at))
            at += n * chosen[n]
            used[n] += times * chosen[n]
            left[n] -= times * chosen[n]
        bins += times
        order = [n for n in order if left[n]]
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first_rank", "per_bin", "first_bin", "offset"), table.T))


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
WITH_IDS = PIECES + ", ids binary"


def _pieces(path: str, end: int, size: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch, col in arrow.sliced(batches, "text", 4 << 20):
            ids, offsets = tokens.with_end(*enc.encode(col), end)
            n = np.diff(offsets)
            per = -(-n // size)
            row = np.repeat(np.arange(len(n)), per)
            piece = arrow.spread(np.zeros(len(n), np.int64), per).astype(np.int64)
            start = piece * size
            length = np.minimum(size, n[row] - start)
            raw = memoryview(ids.astype("<u4").tobytes())
            a = offsets[row] + start
            spans = list(zip((4 * a).tolist(), (4 * (a + length)).tolist()))
            crc = [zlib.crc32(raw[i:j]) for i, j in spans]
            out = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out, names = [*out, pa.array([bytes(raw[i:j]) for i, j in spans], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def pack(docs: DataFrame, *, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all whole texts with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids].

    Longer documents alone are cut, every ``size`` tokens. ``ids`` (uint32, little-endian) lets ``sequences`` put them together.
    """
    spark = docs.sparkSession
    rows = arrow.modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = store.written(rows.mapInArrow(_pieces(path or tokens.default_path(), end, size, keep_ids), WITH_IDS if keep_ids else PIECES), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    found = plan(counts, size)
    shift = 40  # ranks stay below 2**40, lengths below 2**23
    keys = (found["length"] << shift) + found["first_rank"]
    per, first_bin, offset = (found[c] for c in ("per_bin", "first_bin", "offset"))

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, rank))
        at = np.searchsorted(keys, (n << shift) + r, "right") - 1
        r = r - (keys[at] & (1 << shift) - 1)
        return pa.StructArray.from_arrays([pa.array(first_bin[at] + r // per[at]), pa.array(offset[at] + r % per[at] * n)], ["sequence_id", "offset"])

    buckets = 4 * store.partitions(spark)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.withColumn("place", place("length", F.col("rank") + F.col("base")))
    return ranked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "place.sequence_id", "place.offset", *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of ``pack(keep_ids=True)``: sequence_id, ids (uint32, little-endian), doc_ids in order."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))  # at most ``size`` pieces each
    return parts.select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> a || p.ids)").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
