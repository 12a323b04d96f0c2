"""Vectorised work on Arrow batches of texts: slicing, words, per-row grouping."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

#: Bytes of text that are taken apart at once (a single longer text is still taken whole), that come in one Arrow batch, and that a
#: worker reads before it gives freed memory back (page faults after that cost time).
SLICE_BYTES, BATCH_BYTES, RELEASE_BYTES = 8 << 20, 8 << 20, 128 << 20
_U = np.uint64


def texts(batch: pa.RecordBatch, name: str) -> pa.Array:
    """Column ``name`` as strings, nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.string()) if col.type != pa.string() else col, "")


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives the worker's freed memory back to the machine: Spark keeps idle workers, beside which its own heap must fit."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


#: What the worker keeps between tasks of one kind; tasks of other kinds clear it.
kept: dict[str, object] = {}


def forget() -> None:
    """Drops what earlier tasks of another kind have kept in this worker."""
    if kept:
        kept.clear()
        release()


def modest(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches limited to ``BATCH_BYTES``: texts are long, and the executor and its worker each hold
    a batch that goes in and one that comes out. A lower limit of the session stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get(name).strip().lower()).groups()
    if not 0 < int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def sliced(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Zero-copy row slices with at most ``most`` bytes of text, one row at least."""
    read = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        col = texts(batch, name)
        ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at), col.slice(at, to - at)
            at = to
        read += int(ends[-1])
        if read > RELEASE_BYTES:
            release()
            read = 0
    release()


def words(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and where each text's words begin (one more entry than texts)."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(col))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pa.array(~empty))
        offsets = np.concatenate([[0], np.cumsum(~empty)])[offsets]
    return flat, offsets


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of each word and the distinct words."""
    d = flat.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each string; the same on every executor."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.cast(pa.binary()).to_pylist()), _U, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit (constants of the public splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every window of ``n`` consecutive entries (order matters); ``max(0, len - n + 1)`` of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, _U)
    out = h[:m].copy()
    for k in range(1, n):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + h[k : k + m])
    return out if n > 1 else mixed(out)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each entry of a flat array with these offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's entries; rows without any give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after the other."""
    n = int(lengths.sum())
    if not n:
        return np.empty(0, np.int64)
    kind = np.int32 if n + int(starts.max()) < 1 << 31 else np.int64
    at = np.repeat((starts - np.concatenate([[0], np.cumsum(lengths)[:-1]])).astype(kind), lengths)
    at += np.arange(n, dtype=kind)
    return at
