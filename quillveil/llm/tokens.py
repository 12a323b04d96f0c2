"""Token ids of whole texts with a public vocabulary file and the tokenizers library.

The word-BPE vocabulary drops white space before anything else looks at the text, so a text's ids are those of its
white-space separated chunks, one after the other. Each distinct chunk of a slice of texts is encoded once: chunks of plain
letters, digits and punctuation are taken apart in Arrow with the vocabulary's own pre-token pattern, and their distinct
pre-tokens go through the library's BPE model in bulk; any other chunk goes through the library's whole encoder. Nothing is kept
from one slice to the next, so a worker holds one slice and the vocabulary.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import arrow

# The pre-token pattern of the vocabulary file, and characters whose case and class no Unicode version disputes.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = r"[!-~À-ÖØ-öø-įı-ňŊ-ž]+"
#: Pre-tokens that go to the model as one line.
LINE = 512


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, flat."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)  # the same model, not a second one in memory
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that close a pre-token
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.bytes_as = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest) if b != 32}
        arrow.release()

    def _pretokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens and where each begins (one more entry)."""
        lines = [" ".join(pieces[i : i + LINE]) for i in range(0, len(pieces), LINE)]
        lines = [x if x.isascii() else x.encode().decode("latin-1").translate(self.bytes_as) for x in lines]
        got = self.model.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in got]) if got else np.empty(0, np.uint32)
        bounds = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(bounds) != len(pieces) + 1:
            raise RuntimeError("the vocabulary doesn't mark the ends of its pre-tokens")
        return ids, bounds

    def _chunks(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, and where each chunk's ids begin and how many they are."""
        plain = pc.and_not(pc.match_substring_regex(distinct, f"^{PLAIN}$"), pc.match_substring(distinct, "<|")).to_numpy(zero_copy_only=False)
        starts, lens = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        # matches by number: a group in the pattern would take six times as long
        spaced = pc.replace_substring_regex(pc.utf8_lower(distinct.filter(pa.array(plain))), PRETOKEN, r" \0")
        pretokens, offsets = arrow.words(spaced)
        flat = np.empty(0, np.uint32)
        if len(pretokens):
            codes, own = arrow.coded(pretokens)
            ids, bounds = self._pretokens(own.to_pylist())
            sizes = np.diff(bounds)[codes]
            flat = ids[arrow.spread(bounds[codes], sizes)]
            at = np.concatenate([[0], np.cumsum(sizes)])[offsets]
            starts[plain], lens[plain] = at[:-1], np.diff(at)
        odd = np.flatnonzero(~plain)
        if len(odd):
            tail = [np.asarray(e.ids, np.uint32) for e in self.whole.encode_batch_fast(distinct.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            lens[odd] = [len(x) for x in tail]
            starts[odd] = len(flat) + np.concatenate([[0], np.cumsum(lens[odd])[:-1]])
            flat = np.concatenate([flat, *tail])
        return flat, starts, lens

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts and where each text's ids begin (one more entry than texts)."""
        flat, offsets = arrow.words(col)
        if not len(flat):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        codes, distinct = arrow.coded(flat)
        ids, starts, lens = self._chunks(distinct)
        sizes = lens[codes]
        return ids[arrow.spread(starts[codes], sizes)], np.concatenate([[0], np.cumsum(sizes)])[offsets]


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file; workers keep it over tasks, until one of another kind comes."""
    if path not in arrow.kept:
        arrow.forget()
        arrow.kept[path] = Encoder(path)
    return arrow.kept[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with id ``end`` after each text."""
    to = offsets + np.arange(len(offsets))
    out = np.full(to[-1], end, np.uint32)
    own = np.ones(to[-1], bool)
    own[to[1:] - 1] = False
    out[own] = ids
    return out, to
