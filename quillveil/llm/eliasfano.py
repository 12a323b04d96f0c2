"""Elias-Fano sequences and a two-level n-gram trie on them, in one buffer that can be memory-mapped."""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


class EliasFano:
    """A sorted sequence of distinct integers below ``universe``: low bits packed, high parts in unary.

    ``find`` is a batch successor search: two selects of zeros give the entries that share a value's high part, and a binary
    search over their low bits finds the first that isn't smaller.
    """

    HEAD = struct.Struct("<QQ")

    def __init__(self, raw, at: int = 0):
        self.n, self.low_bits = self.HEAD.unpack_from(raw, at)
        at += self.HEAD.size
        low_bytes = -(-(self.n * self.low_bits // 8 + 9) // 8) * 8
        self.low = np.ndarray((low_bytes - 7,), "<u8", raw, at, (1,))
        at += low_bytes
        (words,) = struct.unpack_from("<Q", raw, at)
        self.high = np.frombuffer(raw, "<u8", words, at + 8)
        self.end = at + 8 + 8 * words
        self.zeros = np.cumsum(64 - np.bitwise_count(self.high).astype(np.int64))  # rank directory

    @classmethod
    def packed(cls, values: np.ndarray, universe: int) -> bytes:
        values = values.astype(_U)
        n = len(values)
        bits = max(0, min(56, (universe // n).bit_length() - 1)) if n else 0
        if n and universe >> bits > 1 << 40:
            raise ValueError("too few values for this universe")
        low = (values & _U((1 << bits) - 1))[:, None] >> np.arange(bits, dtype=_U) & _U(1)
        packed = np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes() if bits else b""
        packed += bytes(-(-(n * bits // 8 + 9) // 8) * 8 - len(packed))
        top = (values >> _U(bits)).astype(np.int64)
        high = np.zeros(-(-(n + (universe >> bits) + 2) // 64) * 64, np.uint8)
        high[top + np.arange(n)] = 1
        unary = np.packbits(high, bitorder="little")
        return cls.HEAD.pack(n, bits) + packed + struct.pack("<Q", len(unary) // 8) + unary.tobytes()

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        at = i * self.low_bits
        return self.low[at >> 3] >> (at & 7).astype(_U) & _U((1 << self.low_bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of zero number k."""
        word = np.searchsorted(self.zeros, k, "right")
        left = k - np.where(word > 0, self.zeros[np.maximum(word, 1) - 1], 0)
        bits, at = ~self.high[word], np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(bits & _U((1 << step) - 1)).astype(np.int64)
            skip = left >= ones
            left -= np.where(skip, ones, 0)
            at += np.where(skip, step, 0)
            bits = np.where(skip, bits >> _U(step), bits)
        return 64 * word + at

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of each value's successor, and whether it is the value itself; looked for among entries ``first`` to ``last`` - 1 if these are given."""
        if not self.n or not len(values):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        top = (values >> _U(self.low_bits)).astype(np.int64)
        low = values & _U((1 << self.low_bits) - 1)
        a = np.where(top > 0, self._zero(np.maximum(top, 1) - 1) - top + 1, 0)
        b = self._zero(top) - top
        if first is not None:
            a, b = np.maximum(a, first), np.minimum(b, last)
        end = b.copy()
        while True:
            todo = np.flatnonzero(a < b)
            if not len(todo):
                break
            mid = (a[todo] + b[todo]) >> 1
            less = self._low(mid) < low[todo]
            a[todo] = np.where(less, mid + 1, a[todo])
            b[todo] = np.where(less, b[todo], mid)
        inside = a < end
        same = np.zeros(len(a), bool)
        same[inside] = self._low(a[inside]) == low[inside]
        return a, same

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values by index."""
        ones = np.cumsum(np.bitwise_count(self.high).astype(np.int64))
        word = np.searchsorted(ones, i, "right")
        left = i - np.where(word > 0, ones[np.maximum(word, 1) - 1], 0)
        bits, pos = self.high[word], np.zeros(len(i), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & _U((1 << step) - 1)).astype(np.int64)
            skip = left >= count
            left -= np.where(skip, count, 0)
            pos += np.where(skip, step, 0)
            bits = np.where(skip, bits >> _U(step), bits)
        return (64 * word + pos - i).astype(_U) << _U(self.low_bits) | self._low(i)


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-byte codes and the 256 levels they stand for (means of classes of equal size)."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(256, np.float32)
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, 256)[1:-1], method="lower"))
    codes = np.searchsorted(cuts, values, "left")
    count = np.bincount(codes, minlength=256)
    return codes.astype(np.uint8), (np.bincount(codes, values, 256) / np.maximum(count, 1)).astype(np.float32)


class Trie:
    """Contexts (64-bit), and under each its successors (64-bit) with a quantised log probability.

    Level 1: contexts. Vocabulary: all successors. Pointers: where each context's successors begin (shifted by the context's
    number, so that they are distinct). Level 2: a successor's number in the vocabulary plus the context's number times the
    size of the vocabulary, one monotone sequence, searched relative to the context.
    """

    HEAD = struct.Struct("<4sIQ")
    MAGIC = b"QEFT"

    def __init__(self, raw):
        magic, _, vocabulary = self.HEAD.unpack_from(raw, 0)
        if magic != self.MAGIC:
            raise ValueError("not an n-gram trie")
        self.size, at = vocabulary, self.HEAD.size
        parts = []
        for _ in range(4):
            parts.append(EliasFano(raw, at))
            at = parts[-1].end
        self.contexts, self.words, self.pointers, self.pairs = parts
        self.levels = np.frombuffer(raw, "<f4", 512, at).reshape(2, 256)
        at += 2048
        self.back = np.frombuffer(raw, np.uint8, self.contexts.n, at)
        self.codes = np.frombuffer(raw, np.uint8, self.pairs.n, at + -(-self.contexts.n // 8) * 8)

    @classmethod
    def packed(cls, contexts: np.ndarray, back: np.ndarray, owner: np.ndarray, words: np.ndarray, logs: np.ndarray) -> bytes:
        """contexts: sorted, distinct; back: log weight of each one's unseen successors; owner (number of the context), words, logs: the pairs, sorted."""
        vocabulary, number = np.unique(words, return_inverse=True)
        size = max(1, len(vocabulary))
        starts = np.searchsorted(owner, np.arange(len(contexts))) + np.arange(len(contexts))
        back_codes, back_levels = quantised(back)
        codes, levels = quantised(logs)
        parts = [
            EliasFano.packed(contexts, 1 << 64),
            EliasFano.packed(vocabulary, 1 << 64),
            EliasFano.packed(starts, len(words) + len(contexts) + 1),
            EliasFano.packed(owner.astype(_U) * _U(size) + number.astype(_U), max(1, len(contexts)) * size),
            np.concatenate([back_levels, levels]).astype("<f4").tobytes(),
            back_codes.tobytes(),
            codes.tobytes(),
        ]
        return cls.HEAD.pack(cls.MAGIC, 1, size) + b"".join(map(_padded, parts))

    def ranges(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs of these contexts (by number) begin and end in level 2: two neighbouring pointers each."""
        if not self.pointers.n:
            return np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        after = np.minimum(which + 1, self.pointers.n - 1)
        first, last = self.pointers.at(which).astype(np.int64) - which, self.pointers.at(after).astype(np.int64) - after
        return first, np.where(which + 1 < self.pointers.n, last, self.pairs.n)

    def successors(self, context: int) -> tuple[int, int]:
        """Range of a context's pairs in level 2."""
        first, last = self.ranges(np.array([context]))
        return int(first[0]), int(last[0])

    def score_pairs(self, contexts: np.ndarray, owner: np.ndarray, words: np.ndarray, number: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Log probability of word ``words[number[i]]`` after ``contexts[owner[i]]`` (both distinct); ``lower``: of the word alone.

        Each context and word is looked up once; a pair is then searched for in the pointer range of its context.
        """
        which, known = self.contexts.find(contexts.astype(_U))
        first, last = self.ranges(np.where(known, which, 0))
        at, word_known = self.words.find(words.astype(_U))
        back = np.zeros(len(contexts))
        back[known] = self.levels[0][self.back[which[known]]]
        out = lower + back[owner]
        both = np.flatnonzero(known[owner] & word_known[number])
        own = owner[both]
        place, seen = self.pairs.find(which[own].astype(_U) * _U(self.size) + at[number[both]].astype(_U), first[own], last[own])
        out[both[seen]] = self.levels[1][self.codes[place[seen]]]
        return out

    def score(self, contexts: np.ndarray, words: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Log probability of each word after each context; ``lower``: log probability of the word alone."""
        distinct, owner = np.unique(contexts.astype(_U), return_inverse=True)
        vocabulary, number = np.unique(words.astype(_U), return_inverse=True)
        return self.score_pairs(distinct, owner, vocabulary, number, lower.astype(np.float64))
