"""Token-id output in directly addressable codes.

A segment holds the ids of consecutive documents. Each id is cut into 8-bit chunks; level k stores the k-th chunk of the ids
that have one, a bitmap that tells which of them go on at the next level, and a rank directory (ones before each 512 bits).
Token i is read by one rank per level, without decoding its neighbours.

Segment layout, little-endian: magic ``QDAC``, u32 version, u64 documents, u64 tokens, u32 levels, u32 zero; then int64 ids of
the documents, u8 null flags (padded to 8), u64 token offsets (one more than documents); then per level u64 codes, the chunks,
the bitmap, the u32 directory, each padded to 8 bytes. Every part can be mapped as it lies.

Defined results: null and empty texts have the end id alone; rows with equal doc_id stand in order of their texts; null doc_ids
come first; an empty table gives no segment; other columns of the input are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrow, store, tokens

MAGIC, VERSION, HEAD = b"QDAC", 1, struct.Struct("<4sIQQII")
#: Tokens after which a segment is closed (the last document may exceed it).
SEGMENT_TOKENS = 1 << 18
RANK_BITS = 512


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def encode(doc_ids: np.ndarray, nulls: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment."""
    parts = [doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), offsets.astype("<u8").tobytes()]
    rest, levels = ids.astype(np.uint32), 0
    while levels == 0 or len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.empty(0, np.int64)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        parts += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), directory.tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
    return HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), levels, 0) + b"".join(map(_padded, parts))


class Segment:
    """A segment over any buffer (bytes, or a memory map of a file)."""

    def __init__(self, raw) -> None:
        magic, version, docs, self.n, levels, _ = HEAD.unpack_from(raw, 0)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += -(-out.nbytes // 8) * 8
            return out

        self.doc_ids, self.nulls, self.offsets = take("<i8", docs), take("u1", docs), take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            (count,) = take("<u8", 1).tolist()
            self.levels.append((take("u1", count), take("u1", -(-count // 8)), take("<u4", -(-count // RANK_BITS) + 1)))

    def _rank(self, bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        block = i // RANK_BITS
        lo = block * RANK_BITS // 8
        ones = int(np.bitwise_count(bits[lo : i // 8]).sum()) + int(bits[i // 8] & ((1 << i % 8) - 1) if i % 8 else 0).bit_count()
        return int(directory[block]) + ones

    def token(self, i: int) -> int:
        """Id number ``i`` of the segment: one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            out |= int(chunks[i]) << 8 * k
            if not bits[i // 8] >> i % 8 & 1:
                return out
            i = self._rank(bits, directory, i)
        raise ValueError("a code goes on after the last level")

    def tokens(self) -> np.ndarray:
        """All ids."""
        above = None
        for k in reversed(range(len(self.levels))):
            chunks, bits, _ = self.levels[k]
            out = chunks.astype(np.uint32)
            if above is not None:
                more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                out[more] |= above << np.uint32(8)
            above = out
        return above

    def document(self, d: int) -> np.ndarray:
        """Ids of document number ``d``: only its own codes are read."""
        return np.fromiter(map(self.token, range(self.offsets[d], self.offsets[d + 1])), np.uint32)


def _segments(path: str, end: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, enc = TaskContext.get().partitionId(), 0, tokens.encoder(path)
        held: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nonlocal seq, held, size
            ids = np.concatenate([h[2] for h in held])
            lens = np.concatenate([h[3] for h in held])
            raw = encode(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([[0], np.cumsum(lens)]), ids)
            out = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(lens)], "n_tokens": [len(ids)], "payload": [raw]}, SEGMENT_ARROW)
            seq, held, size = seq + 1, [], 0
            return out

        for batch, col in arrow.sliced(batches, text_col):
            ids, offsets = tokens.with_end(*enc.encode(col), end)
            docs = batch.column(batch.schema.get_field_index(id_col))
            held.append((docs.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), docs.is_null().to_numpy(zero_copy_only=False), ids, np.diff(offsets)))
            size += len(ids)
            if size >= SEGMENT_TOKENS:
                yield closed()
        if held:
            yield closed()

    return run


SEGMENT_SCHEMA = "part int, seq int, n_docs long, n_tokens long, payload binary"
SEGMENT_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, out: str, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = 1) -> None:
    """Write the ids of all whole texts, in ascending ``id_col`` order, as token segments (one Parquet row each, not compressed: a token is read where it lies) to folder ``out``.

    One shuffle: the texts are dealt by ranges of ``id_col``; ``part`` ascends with it, and ``seq`` inside a part.
    """
    spark = docs.sparkSession
    rows = arrow.modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(store.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_segments(path or tokens.default_path(), end, "doc_id", "text"), SEGMENT_SCHEMA).write.option("compression", "none").parquet(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, base in zip(batch.column(0), batch.column(1).to_pylist()):
            s = Segment(raw.as_buffer())
            ids = memoryview(s.tokens().astype("<u4").tobytes())
            at = s.offsets.tolist()
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
            docs = pa.array(s.doc_ids, mask=s.nulls.astype(bool))
            yield pa.RecordBatch.from_arrays([docs, pa.array(s.offsets[:-1] + base), pa.array(np.diff(s.offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _segments_of(spark, out: str) -> tuple[DataFrame, DataFrame, int]:
    """The segments in ``out``, the place of each (part, seq, n_tokens, base: ids of all segments before it), and the number of parts."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(out)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # as many as the write had partitions
    bases = {r["part"]: b for r, b in zip(parts, np.concatenate([[0], np.cumsum([r["n"] for r in parts])]).tolist())}
    first = spark.createDataFrame(list(bases.items()), "part int, base long")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", "n_tokens").withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    starts = starts.join(store.small(first, len(parts), 12), "part").select("part", "seq", "n_tokens", (F.col("base") + F.col("inside")).alias("base"))
    return files, starts, len(parts)


def read_tokens(spark, out: str) -> DataFrame:
    """Per document of the segments in ``out``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files, starts, parts = _segments_of(spark, out)
    rows = files.select("part", "seq", "payload").join(store.small(starts.drop("n_tokens"), 64 * parts, 24), ["part", "seq"]).select("payload", "base")
    return rows.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, base, places in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            s = Segment(raw.as_buffer())
            yield pa.RecordBatch.from_pydict({"position": pa.array(places, pa.int64()), "token_id": pa.array([s.token(p - base) for p in places], pa.int64())})


def token_at(spark, out: str, positions: DataFrame, *, position_col: str = "position") -> DataFrame:
    """position, token_id of the wanted places in the whole stream of ids; places beyond its end give no row, repeated ones one.

    Places and segments meet by blocks of ``SEGMENT_TOKENS`` places; a segment is read where it is wanted, one rank a level for
    each token, and none of its neighbours is decoded.
    """
    files, starts, _ = _segments_of(spark, out)
    block = lambda c: F.floor(c / SEGMENT_TOKENS).cast("long")
    starts = starts.where("n_tokens > 0").withColumn("block", F.explode(F.sequence(block(F.col("base")), block(F.col("base") + F.col("n_tokens") - 1))))
    wanted = positions.select(F.col(position_col).cast("long").alias("position")).where("position >= 0").distinct().withColumn("block", block(F.col("position")))
    met = wanted.join(starts, "block").where("position >= base and position < base + n_tokens")
    met = met.groupBy("part", "seq", "base").agg(F.collect_list("position").alias("places"))  # a segment's tokens at most
    return files.join(met, ["part", "seq"]).select("payload", "base", "places").mapInArrow(_picked, "position long, token_id long")
