"""Scores of whole texts under a smoothed bigram model kept in Elias-Fano n-gram tries.

1. One pass counts the training words (64-bit hashes). The heads (words with at least 1/65,536 of all tokens, so 65,536 at most)
   go to every task; the other counts stay in a table.
2. A second pass finds which shard needs the count of which other word. These requests and the table meet by word, and each shard
   is sent the counts that it needs.
3. A third pass turns each block of texts into its distinct bigrams with the documents they occur in, and deals them to shards
   by context; contexts above a shard's share are dealt by successor too. A shard adds up its counts, builds its trie, scores
   its bigrams in the pointer ranges of their contexts, and sends each block a sum for each of its documents that it knows of.
4. The sums of a block's documents meet again by block.

With a folder ``out`` the model stays there: the counts of the words, and a row for each shard with its trie, not compressed, as it
lies in memory. ``rescored`` scores other texts with it.

Model: P(w | v) = (c(v w) + MU * P(w)) / (c(v) + MU) with P(w) = (c(w) + 1) / (N + V + 1) of each word's own count, 0 for words
that training lacks; the trie's logarithms are quantised to a byte.
Nothing is pruned. Memory is bounded by the size of a block and of a shard; the number of shards follows the tokens. What is sent is
at most one row for each block and shard, and an entry for each distinct bigram of a block.

Defined results: null and empty texts are the end token alone; the training rows are chosen by crc32 of the doc_id as text (a
null one as an empty text); rows that repeat a doc_id are scored each; without training text every score is the base score; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, store
from .eliasfano import Trie

MU = 4.0
HEAD_SHARE = 1 << 16
#: Tokens a shard is meant to hold.
SHARD_TOKENS = 2_000_000
_U = np.uint64
BEGIN, END = (xxhash.xxh3_64_intdigest(b"\x00 " + x) for x in (b"begin", b"end"))  # hold a space: no word is hashed so
#: Entries that a task gathers before it deals them out.
GATHERED = 1_000_000


def is_training(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2 for d in doc_ids], bool)


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, offsets by text, hashes of the distinct words."""
    flat, offsets = arrow.words(pc.ascii_lower(col))
    codes, distinct = arrow.coded(flat) if len(flat) else (np.empty(0, np.int64), pa.array([], pa.string()))
    return codes.astype(np.int64), offsets, arrow.hashes(distinct)


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts, docs = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, inverse = np.unique(np.concatenate(words), return_inverse=True)
        return h, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

    for batch, col in arrow.sliced(batches, "text"):
        train = is_training(batch.column(0).to_pylist())
        docs += int(train.sum())
        codes, offsets, h = _tokens(col)
        c = np.bincount(codes, train[arrow.row_of(offsets)], len(h)).astype(np.int64)
        words.append(h[c > 0])
        counts.append(c[c > 0])
        if sum(map(len, words)) > 2_000_000:
            h, c = merged()
            words, counts = [h], [c]
            if len(h) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])
                words, counts = [], []
    words.append(np.array([END], _U))
    counts.append(np.array([docs], np.int64))
    h, c = merged()
    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)[c > 0]), pa.array(c[c > 0])], ["h", "c"])


class Lower:
    """What every task knows of the lower-order model: its totals and the counts of the heads."""

    def __init__(self, heads: np.ndarray, counts: np.ndarray, n: int, v: int, docs: int, shards: int):
        order = np.argsort(heads)
        self.heads, self.counts, self.n, self.v, self.docs, self.shards = heads[order], counts[order], n, v, docs, shards
        self.total = n + v + 1
        # a context beyond half a shard's share is dealt to several shards by its successors
        self.fan = np.maximum(1, -(-2 * self.counts // max(1, n // shards))).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.heads, h), max(0, len(self.heads) - 1))
        return at, self.heads[at] == h if len(self.heads) else np.zeros(len(h), bool)

    def logs(self, h: np.ndarray, tail: np.ndarray, tail_counts: np.ndarray) -> np.ndarray:
        """Log probability of each word, given the counts of the other words (sorted by hash); words in neither are unseen."""
        counts = np.zeros(len(h))
        if len(tail):
            at = np.minimum(np.searchsorted(tail, h), len(tail) - 1)
            counts = np.where(tail[at] == h, tail_counts[at], counts)
        at, known = self.find(h)
        counts[known] = self.counts[at[known]]
        counts[h == _U(END)] = self.docs
        return np.log10((counts + 1) / self.total)

    def shard(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        at, known = self.find(contexts)
        fan = np.ones(len(contexts), np.int64)
        fan[known] = self.fan[at[known]]
        part = (words >> _U(8)).astype(np.int64) & 0xFFFFFF
        return (arrow.mixed(contexts + (part % fan).astype(_U) * _U(0x9E3779B97F4A7C15)) % _U(self.shards)).astype(np.int64)


#: Of a payload's arrays, in order; + marks those that go as differences, as they are sorted.
KINDS = ("+<u8", "<u4", "+<u8", "<u4", "<u4", "<u4", "<u2", "<u4")


def _packed(arrays: list[np.ndarray], kinds: tuple[str, ...]) -> bytes:
    """The arrays, each as its lowest bytes, then the next ones and so on, compressed."""
    out = [struct.pack(f"<{len(arrays)}Q", *map(len, arrays))]
    for a, kind in zip(arrays, kinds):
        a = np.ascontiguousarray(a, kind.lstrip("+"))
        if kind[0] == "+" and len(a):
            a = np.concatenate([a[:1], a[1:] - a[:-1]])
        out.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpacked(raw: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    lengths, at, out = struct.unpack_from(f"<{len(kinds)}Q", raw), 8 * len(kinds), []
    for n, kind in zip(lengths, kinds):
        to = np.dtype(kind.lstrip("+"))
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * to.itemsize, at).reshape(to.itemsize, n).T).reshape(-1).view(to)
        out.append(np.cumsum(a, dtype=to) if kind[0] == "+" else a)
        at += a.nbytes
    return out


ROW = "shard int, own boolean, block string, payload binary"
ROW_ARROW = pa.schema([("shard", pa.int32()), ("own", pa.bool_()), ("block", pa.string()), ("payload", pa.binary())])
OWN = ("<i8", "u1", "u1", "<i8", "<f8", "<i8")
SUMS = ("+<u2", "<f8", "<f8", "<i8")
#: Names of the rows of a shard's model.
TRIE, TOTALS = "trie", "totals"
#: Counts of the trie's contexts, in their order.
TOTAL = ("<u8",)
COUNTS = ("+<u8", "<u8")
ASK = "part int, own boolean, payload binary"
ASK_ARROW = pa.schema([("part", pa.int32()), ("own", pa.bool_()), ("payload", pa.binary())])


def _by_word(h: np.ndarray, other: np.ndarray, own: bool, parts: int) -> pa.RecordBatch:
    """Words (best sorted) and a number each, dealt by word."""
    part = (arrow.mixed(h) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, h, other = part[order], h[order], other[order]
    names, at = np.unique(part, return_index=True)
    payloads = [_packed([h[a:b], other[a:b]], COUNTS) for a, b in zip(at, np.append(at[1:], len(part)))]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([own] * len(names), pa.bool_()), pa.array(payloads, pa.binary())], schema=ASK_ARROW)


def _counted(parts: int):
    """The table of the words that aren't heads, dealt by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [], []

        def flushed() -> pa.RecordBatch:
            h, c = np.concatenate(words), np.concatenate(counts)
            words.clear()
            counts.clear()
            order = np.argsort(h)
            return _by_word(h[order], c[order], True, parts)

        for batch in batches:
            words.append(batch.column(0).to_numpy().view(_U))
            counts.append(batch.column(1).to_numpy())
            if sum(map(len, words)) > GATHERED:
                yield flushed()
        if words:
            yield flushed()

    return run


def _requests(lower: Lower):
    """Words that aren't heads and the shards that their bigrams are dealt to, dealt by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shards = [], []

        def flushed() -> pa.RecordBatch:
            h, s = np.concatenate(words), np.concatenate(shards)
            words.clear()
            shards.clear()
            order = np.lexsort((s, h))
            h, s = h[order], s[order]
            new = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))[: len(h)]
            return _by_word(h[new], s[new], False, lower.shards)

        for batch, col in arrow.sliced(batches, "text"):
            codes, offsets, h = _tokens(col)
            n = len(h)
            h = np.append(h, _U(BEGIN))
            first = np.append(n, codes)[: len(codes)]
            first[offsets[:-1][np.diff(offsets) > 0]] = n
            tail = ~lower.find(h)[1][codes]
            pair = np.unique(first[tail] * (n + 1) + codes[tail])
            ask = np.unique(lower.shard(h[pair // (n + 1)], h[pair % (n + 1)]) * (n + 1) + pair % (n + 1))
            words.append(h[ask % (n + 1)])
            shards.append(ask // (n + 1))
            if sum(map(len, words)) > GATHERED:
                yield flushed()
        if words:
            yield flushed()

    return run


def _answers(table: pa.Table) -> pa.Table:
    """For each shard the words it asked for, with their counts; words without one are left out."""
    known, asked = [], []
    for own, payload in zip(table.column("own").to_pylist(), table.column("payload").to_pylist()):
        (known if own else asked).append(_unpacked(payload, COUNTS))
    rows = []
    if known and asked:
        words, counts = map(np.concatenate, zip(*known))
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        h, s = map(np.concatenate, zip(*asked))
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        found = words[at] == h
        at, s = at[found], s[found]
        order = np.lexsort((at, s))
        at, s = at[order], s[order]
        new = np.append(True, (at[1:] != at[:-1]) | (s[1:] != s[:-1]))[: len(at)]
        at, s = at[new], s[new]
        shards, starts = np.unique(s, return_index=True)
        rows = [(int(k), False, None, _packed([words[at[a:b]], counts[at[a:b]]], COUNTS)) for k, a, b in zip(shards, starts, np.append(starts[1:], len(s)))]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(ROW_ARROW.types)], schema=ROW_ARROW)


def _blocks(lower: Lower):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch, col in arrow.sliced(batches, "text"):
            for k in range(0, len(col), 1 << 16):
                yield block(f"{part}-{number}", batch.column(0).slice(k, 1 << 16), col.slice(k, 1 << 16))
                number += 1

    def block(name: str, ids: pa.Array, col: pa.Array) -> pa.RecordBatch:
        docs, train = len(col), is_training(ids.to_pylist())
        codes, offsets, h = _tokens(col)
        n = len(h)
        h = np.concatenate([h, np.array([BEGIN, END], _U)])
        order = np.argsort(h)  # codes in the order of the hashes, so that those of a payload are sorted
        rank = np.empty(n + 2, np.int64)
        rank[order] = np.arange(n + 2)
        h, codes, (begin, end) = h[order], rank[codes], rank[n:]
        # words of heads are counted here, those of other words by the shard of their context
        at, head = lower.find(h)
        logs, known = np.zeros(n + 2), np.zeros(n + 2, np.int64)
        logs[head], known[head] = np.log10(lower.counts[at[head]] + 1), 1
        logs[begin], known[begin] = 0, 0
        logs[end], known[end] = math.log10(lower.docs + 1), lower.docs > 0
        base = arrow.segment_sums(logs[codes], offsets) + logs[end]
        sure = arrow.segment_sums(known[codes], offsets) + known[end]
        own = [ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), ~train, np.diff(offsets) + 1, base, sure]

        row = arrow.row_of(offsets)
        to = np.arange(len(codes)) + row
        first = np.full(len(codes) + docs, begin, np.int64)
        second = np.full(len(codes) + docs, end, np.int64)
        first[to + 1], second[to] = codes, codes
        row = np.repeat(np.arange(docs), np.diff(offsets) + 1)
        entries, times = np.unique(((first * (n + 2) + second) << 16) | row, return_counts=True)
        pair, doc = entries >> 16, entries & 0xFFFF
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        sizes = np.diff(np.append(starts, len(pair)))
        trained = np.add.reduceat(times * train[doc], starts)
        v, w = pair[starts] // (n + 2), pair[starts] % (n + 2)
        shard = lower.shard(h[v], h[w])
        order = np.argsort(shard, kind="stable")
        shard, v, w, trained, starts, sizes = shard[order], v[order], w[order], trained[order], starts[order], sizes[order]
        entry = arrow.spread(starts, sizes)
        doc, times = doc[entry], times[entry]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        shards, at = np.unique(shard, return_index=True)
        rows = [(zlib.crc32(name.encode()) % lower.shards, True, name, _packed(own, OWN))]
        for s, a, b in zip(shards.tolist(), at, np.append(at[1:], len(shard))):
            vs = v[a:b]
            runs = np.flatnonzero(np.concatenate([[True], vs[1:] != vs[:-1]]))
            e = slice(ends[a], ends[b])
            distinct, number = np.unique(w[a:b], return_inverse=True)
            arrays = [h[vs[runs]], np.diff(np.append(runs, b - a)), h[distinct], number, trained[a:b], sizes[a:b], doc[e], times[e]]
            rows.append((s, False, name, _packed(arrays, KINDS)))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), ROW_ARROW.types)], schema=ROW_ARROW)

    return run


def model(contexts: np.ndarray, counts: np.ndarray, owner: np.ndarray, words: np.ndarray, times: np.ndarray, low: np.ndarray) -> bytes:
    """The trie of a shard: sorted contexts with their counts, and its training bigrams, sorted, with theirs."""
    total = counts[owner] + MU
    return Trie.packed(contexts, np.log10(MU / (counts + MU)), owner, words, np.log10((times + MU * 10.0**low) / total))


def _shard(lower: Lower, keep: bool = False):
    """Scores the bigrams of a shard, with the trie that came with them or else with one built of them; with ``keep`` it goes out too."""

    def run(table: pa.Table) -> pa.Table:
        names, rows, parts, counted, model_rows = [], [], [], [[np.empty(0, _U), np.empty(0, _U)]], {}
        for own, name, payload in zip(*(table.column(c) for c in ("own", "block", "payload"))):
            own, name = own.as_py(), name.as_py()
            if own is None:
                model_rows[name] = payload.as_buffer()
            elif own:
                rows.append((0, True, name, payload.as_py()))
            elif name is None:
                counted.append(_unpacked(payload.as_py(), COUNTS))
            else:
                names.append(name)
                parts.append(_unpacked(payload.as_py(), KINDS))
        if names:
            of_block = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[6]) for p in parts])
            before = np.repeat(np.cumsum([0] + [len(p[2]) for p in parts[:-1]]), [len(p[3]) for p in parts])
            v, runs, w, number, trained, sizes, doc, times = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            contexts, which = np.unique(v, return_inverse=True)
            owner = np.repeat(which, runs)
            words, place = np.unique(w, return_inverse=True)
            number = place[before + number]
            del v, w, place, before
            tail, tail_counts = map(np.concatenate, zip(*counted))
            order = np.argsort(tail)
            word_logs = lower.logs(words, tail[order], tail_counts[order])
            pairs, pair = np.unique(owner.astype(_U) << _U(32) | number.astype(_U), return_inverse=True)
            own, word = (pairs >> _U(32)).astype(np.int64), (pairs & _U(0xFFFFFFFF)).astype(np.int64)
            lows = word_logs[word]
            at, head = lower.find(contexts)
            if model_rows:
                trie = Trie(model_rows[TRIE])
                (totals,) = _unpacked(model_rows[TOTALS].to_pybytes(), TOTAL)
                known = trie.contexts.at(np.arange(trie.contexts.n))
                place = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
                total = np.where(known[place] == contexts, totals[place], 0).astype(np.float64)
            else:
                count = np.bincount(pair, trained, len(pairs))
                total = np.bincount(own, count, len(contexts))
                total[head] = lower.counts[at[head]]
                total[contexts == _U(BEGIN)] = lower.docs
                seen = np.flatnonzero(total > 0)
                back = np.full(len(contexts), -1)
                back[seen] = np.arange(len(seen))
                use = np.flatnonzero(count > 0)
                raw = model(contexts[seen], total[seen], back[own[use]], words[word[use]], count[use], lows[use])
                trie = Trie(raw)
                if keep and len(seen):
                    shard = table.column("shard")[0].as_py()
                    rows += [(shard, None, TRIE, raw), (shard, None, TOTALS, _packed([total[seen]], TOTAL))]
            logs = trie.score_pairs(contexts, own, words, word, lows)
            base = np.where(head | (contexts == _U(BEGIN)), 0, np.log10(total + 1))
            known = (base > 0).astype(np.int64)
            entry = np.repeat(np.arange(len(pair)), sizes)
            docs, place = np.unique(of_block.astype(np.int64) << 16 | doc, return_inverse=True)  # those that have entries here
            of = owner[entry]
            sums = [np.bincount(place, x, len(docs)) for x in (logs[pair[entry]] * times, base[of] * times, known[of] * times)]
            ends = np.searchsorted(docs, np.arange(len(names) + 1) << 16)
            for k, name in enumerate(names):
                e = slice(ends[k], ends[k + 1])
                rows.append((0, False, name, _packed([docs[e] & 0xFFFF, *(x[e] for x in sums)], SUMS)))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), ROW_ARROW.types)] if rows else [pa.array([], t) for t in ROW_ARROW.types], schema=ROW_ARROW)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _together(lower: Lower):
    def run(table: pa.Table) -> pa.Table:
        own = next(p for o, p in zip(table.column("own").to_pylist(), table.column("payload").to_pylist()) if o)
        ids, null, held, n, base, known = _unpacked(own, OWN)
        score, base, known = np.zeros(len(ids)), base.copy(), known.copy()
        for o, p in zip(table.column("own").to_pylist(), table.column("payload").to_pylist()):
            if not o:
                at, s, b, k = _unpacked(p, SUMS)
                score[at] += s
                base[at] += b
                known[at] += k
        base -= n * math.log10(lower.total)
        columns = [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(n), pa.array(known), pa.array(np.full(len(ids), lower.n)), pa.array(base), pa.array(score if lower.n else base)]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _lower(words: DataFrame, n: int, v: int, ends: int) -> Lower:
    """The lower-order model of a table of counts."""
    heads = words.where(F.col("c") * HEAD_SHARE >= n).toPandas()  # HEAD_SHARE rows at most
    return Lower(heads["h"].to_numpy(np.int64).view(_U), heads["c"].to_numpy(np.int64), n, v, ends, max(8, math.ceil(n * 7 / 6 / SHARD_TOKENS)))


def _dealt(rows: DataFrame, words: DataFrame, lower: Lower) -> DataFrame:
    """The bigrams of the texts and the counts that their scores need, by shard."""
    asked = words.where(F.col("c") * HEAD_SHARE < lower.n).mapInArrow(_counted(lower.shards), ASK).unionByName(rows.mapInArrow(_requests(lower), ASK))
    counts = asked.groupBy("part").applyInArrow(_answers, ROW)
    return rows.mapInArrow(_blocks(lower), ROW).unionByName(counts)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return arrow.modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. With ``out`` the model is written to that folder."""
    rows = _texts(docs, id_col, text_col)
    words = store.written(rows.mapInArrow(_unigrams, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "unigrams", f"{out}/words" if out else None)
    end = int(np.array([END], _U).view(np.int64)[0])
    n, v, ends = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("h") == end, F.col("c"))), F.lit(0))).first()
    lower = _lower(words, n, v, ends)
    dealt = _dealt(rows, words, lower).groupBy("shard").applyInArrow(_shard(lower, out is not None), ROW)
    if out:
        docs.sparkSession.createDataFrame([(n, v, ends)], "n long, v long, ends long").write.parquet(f"{out}/totals")
        dealt.write.option("compression", "none").parquet(f"{out}/shards")
        dealt = docs.sparkSession.read.schema(ROW).parquet(f"{out}/shards").where("own is not null")
    return dealt.groupBy("block").applyInArrow(_together(lower), SCORES)


def rescored(docs: DataFrame, out: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``scored``, with the model that ``scored`` has written to ``out``; nothing is learned from ``docs``."""
    spark = docs.sparkSession
    rows, words = _texts(docs, id_col, text_col), spark.read.schema("h long, c long").parquet(f"{out}/words")
    lower = _lower(words, *spark.read.schema("n long, v long, ends long").parquet(f"{out}/totals").first())
    tries = spark.read.schema(ROW).parquet(f"{out}/shards").where("own is null")
    dealt = _dealt(rows, words, lower).unionByName(tries).groupBy("shard").applyInArrow(_shard(lower), ROW)
    return dealt.groupBy("block").applyInArrow(_together(lower), SCORES)
