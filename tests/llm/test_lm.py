"""The language model against a plain bigram model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quillveil.llm import lm


@pytest.mark.parametrize("head_share", [lm.HEAD_SHARE, 12])
def test_language_model_scores_with_each_words_own_count(spark, monkeypatch, tmp_path, head_share):
    rng = random.Random(8)
    lexicon = [f"w{k}" for k in range(100)]
    texts = {d: " ".join(rng.choice(lexicon[: 3 + rng.randint(0, 97)]) for _ in range(rng.randint(0, 20))) for d in range(80)}  # few pairs a shard: a byte holds each log
    texts |= {1000: "w1 new w1 other new", 1001: None, 1002: "w7 " * 50}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "HEAD_SHARE", head_share)
    out = f"file://{tmp_path}/lm"
    first = lm.scored(rows, out=out).collect()
    got = {r.doc_id: r.score for r in first}
    key = lambda r: (r.doc_id, *r[1:5], round(r.base_score, 9), round(r.score, 9))
    assert sorted(map(key, lm.rescored(rows.repartition(2), out).collect())) == sorted(map(key, first)) == sorted(map(key, lm.scored(rows).collect()))
    other = spark.createDataFrame([(5000, "w1 w2 never seen"), (5001, None)], "doc_id long, text string")
    new = {r.doc_id: r for r in lm.rescored(other, out).collect()}
    assert new[5000].n_known == 3 and new[5000].n_tokens == 5 and new[5001].n_tokens == 1
    toks = {d: ["<s>", *(t or "").split(), "</s>"] for d, t in texts.items()}
    train = [d for d in toks if zlib.crc32(str(d).encode()) % 7 != 2]
    one = Counter(w for d in train for w in toks[d][1:])
    two = Counter(p for d in train for p in zip(toks[d], toks[d][1:]))
    first = Counter(v for d in train for v in toks[d][:-1])
    n = sum(one.values())
    low = {w: (one[w] + 1) / (n + len(one) + 1) for ws in toks.values() for w in ws}
    assert any(one[w] * 12 < n for w in one) and any(one[w] * 12 < n and one[w] > 5 for w in one) and len(train) < len(toks)
    for d, ws in toks.items():
        want = sum(math.log10((two[v, w] + lm.MU * low[w]) / (first[v] + lm.MU)) for v, w in zip(ws, ws[1:]))
        assert abs(got[d] - want) < 1e-4 * len(ws), (d, got[d], want)


def test_payloads_keep_their_arrays_and_sorted_hashes_take_less_room():
    rng = np.random.default_rng(5)
    h = np.sort(rng.integers(0, 1 << 64, 20_000, np.uint64))
    for arrays, kinds in (([h, np.arange(20_000)], lm.COUNTS), ([np.array([7, 3, 3, 65535, 0]), np.array([-1.5, 0, 1e300, 2, 3]), np.zeros(5), np.array([-1, 2, 3, 4, 5])], lm.SUMS), ([h[:0]] * 8, lm.KINDS)):
        back = lm._unpacked(lm._packed(arrays, kinds), kinds)
        assert all(np.array_equal(a, b) and b.dtype == k.lstrip("+") for a, b, k in zip(arrays, back, kinds, strict=True))
    assert len(lm._packed([h, np.ones(len(h), np.int64)], lm.COUNTS)) < 7 * len(h)  # 8 bytes each when they go as they are
