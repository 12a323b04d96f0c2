"""Verdicts of the trees against a plain walk, and the sample they are fitted on."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillveil.llm import quality, queries, trees

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    return quality.fitted(queries.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"))


def walk(forest, x):
    """The margin of one row, tree by tree, node by node."""
    out = forest.base
    for root in forest.roots.tolist():
        node = root
        while forest.left[node] != node:
            node = int(forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node])
        out += forest.value[node]
    return out


def test_verdicts_match_a_plain_walk(spark, fitted):
    docs = queries.documents(spark, SF).collect()
    counts, x = quality.statistics(pa.array([d.text or "" for d in docs]))
    want = {}
    for k, d in enumerate(docs):
        n, repeat = int(counts["n_words"][k]), int(counts["n_repeat_words"][k])
        failed = n < 10 or 100 * repeat > 20 * n
        score = 1 / (1 + np.exp(-walk(fitted, x[k])))
        want[d.doc_id] = (failed, not failed and score >= quality.THRESHOLD, round(float(score), 9))
    got = {r.doc_id: (r.base_failed, r.kept, round(r.score, 9)) for r in queries.op4_boosted_quality(spark, SF).collect()}
    assert got == want and len({k for _, k, _ in want.values()}) == 2


def test_the_trees_tell_good_from_bad(spark):
    """Fitted on half of the labels, held against the other half."""
    docs, labels = queries.documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    forest = quality.fitted(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    counts, x = quality.statistics(pa.array([r.text or "" for r in rows]))
    _, _, kept = quality.verdicts(counts, x, forest)
    y = np.array([r.quality for r in rows]) > 0
    assert len(y) > 1000 and (kept == y).mean() > 0.9


def test_the_score_only_falls_with_the_constrained_statistics(fitted):
    rng = np.random.default_rng(3)
    x = rng.random((300, len(quality.FEATURES)))
    for f in quality.MONOTONE:
        more = x.copy()
        more[:, f] += rng.random(300)
        assert (fitted.margin(more) <= fitted.margin(x) + 1e-12).all()


def test_the_fit_does_not_hang_on_the_order_of_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), " ".join(f"w{rng.integers(0, 50 + 5 * k)}" for _ in range(30 + k)) + ("!#$" * (k % 3)), 0) for k in range(120)]
    rows += [(3, rows[3][1], 0), (3, "another text under the same id, long enough for the base limits to pass", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    a, b = (quality.fitted(docs.repartition(n), labels.repartition(n)) for n in (1, 5))
    probe = np.random.default_rng(2).random((50, len(quality.FEATURES)))
    assert (a.margin(probe) == b.margin(probe)).all()
    assert quality.fitted(docs, labels.where("quality = 1")) is None


def test_no_window_across_texts():
    texts = ["a b c d e", "a b c d e", "a b c d e f a b c d e"]
    got, _ = quality.statistics(pa.array(texts))
    assert got["n_repeat_words"].tolist() == [0, 0, 10] and got["n_words"].tolist() == [5, 5, 11]
    assert Counter(re.findall(r"\S+", texts[2]))["a"] == 2 and trees.Forest
