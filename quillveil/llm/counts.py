"""Token counts by trie-shared dynamic programming.

The tokenizer is a unigram model over the pieces of a public vocabulary file: piece number r of it has score -ln(r + 1), a
character that no piece covers is written as its UTF-8 bytes. The distinct pre-tokens of a batch go into a trie; walking it in
order, the best score and count up to each character are worked out once for all pre-tokens that share that prefix, and the
count at a pre-token's last character is kept in the worker (bounded). Among equal scores the fewer tokens count.

Defined results: null and empty texts have no tokens; rows that repeat a doc_id are counted each; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow

#: Distinct pre-tokens that a worker keeps before it starts afresh.
CACHE_WORDS = 600_000
#: Score of one byte of a character that no piece covers.
BYTE_SCORE = -30.0
MARK = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> dict[str, float]:
    """Score of each ordinary piece, in the file's order of merit."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.get_score(i) < -1e6)]
    return {model.id_to_piece(i): -math.log(r + 1) for r, i in enumerate(usual, 1)}


class Counter:
    """Best segmentation of pre-tokens, shared along a trie."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest: dict[str, int] = {}  # of the pieces that end in a character
        for p in scores:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))
        self.known: dict[str, tuple[int, float]] = {}

    def learn(self, words: list[str]) -> None:
        """Words in order are a trie walked depth first: what the last word's prefix gave stands until it differs."""
        scores, longest, known = self.scores, self.longest, self.known
        best, count, last = [0.0], [0], ""
        for word in sorted(MARK + w for w in words):
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            del best[same + 1 :], count[same + 1 :]
            for d in range(same + 1, len(word) + 1):
                c = word[d - 1]
                n = len(c.encode("utf-8", "surrogatepass"))
                top, few = best[d - 1] + n * BYTE_SCORE, count[d - 1] + n
                for j in range(max(0, d - longest.get(c, 0)), d):
                    s = scores.get(word[j:d])
                    if s is not None:
                        s += best[j]
                        if s > top or s == top and count[j] + 1 < few:
                            top, few = s, count[j] + 1
                best.append(top)
                count.append(few)
            last = word
            known[word[1:]] = (count[-1], best[-1])

    def counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {}
        self.learn([w for w in words if w not in self.known])
        got = [self.known[w] for w in words]
        return np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.float64)


def counter(path: str) -> Counter:
    """The worker's counter for this file; workers keep it over tasks, until one of another kind comes."""
    if path not in arrow.kept:
        arrow.forget()
        arrow.kept[path] = Counter(pieces(path))
    return arrow.kept[path]


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens, score (log score of the best segmentation)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch, col in arrow.sliced(batches, "text"):
            flat, offsets = arrow.words(col)
            codes, distinct = arrow.coded(flat)
            n, score = own.counts(distinct.to_pylist())
            out = [np.diff(offsets), arrow.segment_sums(n[codes], offsets), arrow.segment_sums(score[codes], offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0]), pa.array(out[1].astype(np.int64)), pa.array(out[2].astype(np.float64))], ["doc_id", "n_words", "n_tokens", "score"])

    rows = arrow.modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, score double")
