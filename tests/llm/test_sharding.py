"""Resharding: equal texts together, sizes near equal, fewest bytes moved; the files of affected shards."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillveil.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def cheapest(supply, capacity):
    """Fewest units moved, by trying every way to fill the capacities."""
    best = None

    def go(i, room, cost):
        nonlocal best
        if i == len(supply):
            best = cost if best is None else min(best, cost)
            return
        for give in itertools.product(*(range(min(supply[i], r) + 1) for r in room)):
            if sum(give) == supply[i]:
                go(i + 1, [r - g for r, g in zip(room, give)], cost + sum(g for j, g in enumerate(give) if j != i))

    go(0, capacity, 0)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_the_flow_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 3), rng.randint(1, 4)
    supply = [rng.randint(0, 6) for _ in range(n)]
    capacity = sharding._level([rng.randint(0, 4) for _ in range(m)], sum(supply))
    flow = sharding.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    assert sum(f for (i, j), f in flow.items() if i != j) == cheapest(supply, capacity)
    assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(n)] == supply
    assert all(sum(f for (_, j), f in flow.items() if j == k) <= capacity[k] for k in range(m))


def rows():
    rng = random.Random(4)
    out = [(k, "t" * rng.randint(1, 900) + str(k % 97), rng.randint(0, 5)) for k in range(1500)]
    out += [(2000 + k, "a small group", k % 6) for k in range(9)]
    out += [(3000 + k, "hot " * 20, k % 6) for k in range(900)]  # far more than a sixteenth of a shard
    out += [(5000 + k, chr(97 + k) * 40_000, k) for k in range(3)]  # heavy, one by one
    out += [(5000, "a" * 40_000, 0), (7, None, 2), (7, "", 3), (None, None, 1), (None, "null id", 1), (None, "null id", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 1, "x") for r in rows()], "doc_id long, text string, home int, unit string, size int, shard string").repartition(5)


@pytest.fixture(scope="module")
def placed(docs):
    return sharding.reshard(docs, F.col("home"), shards=7, old_shards=6, carry=("text",)).collect()


def test_every_row_has_a_place(placed):
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.old_shard) for r in placed) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), h) for d, t, h in rows())
    for s in range(7):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))


def test_sizes_are_near_equal_and_equal_texts_together(placed):
    load, whole, at = Counter(), Counter(), defaultdict(set)
    for r in placed:
        load[r.shard] += r["size"]
        whole[r.text or ""] += r["size"]
        at[r.text or ""].add(r.shard)
    mean = sum(load.values()) / 7
    assert len(load) == 7 and max(load.values()) - min(load.values()) < 4 * mean / sharding.HEAVY
    together = [t for t, b in whole.items() if b <= mean / sharding.HEAVY]
    assert all(len(at[t]) == 1 for t in together) and "a small group" in together and "" in together
    assert len(at["hot " * 20]) > 1


def test_balanced_shards_stay_where_they_are(spark):
    docs = spark.createDataFrame([(k, f"{k:04}", k % 4) for k in range(400)], "doc_id long, text string, home int")
    assert all(r.shard == r.old_shard for r in sharding.reshard(docs, F.col("home"), shards=4, old_shards=4).collect())


def test_an_empty_table(docs):
    assert sharding.reshard(docs.limit(0), F.col("home"), shards=3, old_shards=6).count() == 0


@pytest.mark.parametrize("repeats", [False, True])
def test_shards_are_written_and_read_back(spark, tmp_path, repeats):
    rows = [(k, "é" * (k % 37) + str(k), k % 4) for k in range(200)] + [(None, "none", 3), (900, None, 1)]
    rows += [(7, rows[7][1], 3), (7, "other", 3), (None, "none", 3), (None, "none", 3)] if repeats else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, home int").repartition(3)
    out = f"file://{tmp_path}/s"
    got = sharding.resharded(docs, F.col("home"), out, shards=3, old_shards=4).collect()
    want = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), h) for d, t, h in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.old_shard) for r in got) == want
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    files = spark.read.schema(sharding.WRITTEN).parquet(out).collect()
    assert Counter((r.doc_id, r.text, r.old_shard) for r in files) == Counter(rows)
    assert spark.read.parquet(f"{out}/shard=3").count() == 0  # all its rows have left


def test_registered_resharding_writes_its_shards(spark, monkeypatch):
    outs, rewrite = [], sharding.rewrite
    monkeypatch.setattr(sharding, "rewrite", lambda docs, old, placed, out: (outs.append(out), rewrite(docs, old, placed, out))[1])
    got = queries.op9_flow_reshard(spark, SF).collect()
    texts = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    files = spark.read.schema(sharding.WRITTEN).parquet(outs[0]).collect()
    assert {r.doc_id: r.text for r in files} == texts and len(got) == len(files) == len(texts)
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in files}
