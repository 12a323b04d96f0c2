"""Near duplicates: what the bands and the sketches let through, and all documents of a table against counting shared shingles."""

import re
from collections import defaultdict

import numpy as np
import pytest

from quillveil.llm import arrow, near, queries

SF = "/root/testdata/sf0.01"


def pairs(n, percent, seed, count=60):
    """Pairs of sets of about ``n`` shingles each whose similarity is ``percent`` or a little more."""
    rng = np.random.default_rng(seed)
    for _ in range(count):
        x = np.unique(arrow.mixed(rng.integers(0, 1 << 62, n + 8).astype(np.uint64)))[:n]
        rng.shuffle(x)
        common = -(-n * percent // 100)
        yield np.sort(x), np.sort(x[:common])


@pytest.mark.parametrize("n", [5, 20, 100, 1000, 10_000])
def test_bands_and_sketches_let_links_through(n):
    signer, lost = near.Signer(near.BANDS * near.ROWS), 0
    own = arrow.mixed(np.arange(1, near.BANDS * near.ROWS + 1, dtype=np.uint64))
    for a, b in pairs(n, 80, n):
        sa, sb = signer.sign(a), signer.sign(b)
        band = (sa == sb).reshape(near.BANDS, near.ROWS).all(1).any()
        bits = [arrow.mixed(s.astype(np.uint64) + own)[: 64 * near.SKETCH] >> np.uint64(32) & np.uint64(1) for s in (sa, sb)]
        unlike = int(np.bitwise_count((near.parity(a) ^ near.parity(b)).view(np.uint64)).sum())
        lost += not (band and (bits[0] != bits[1]).sum() <= near.sketch_bound(80) and unlike * 180 <= (len(a) + len(b)) * 20)
    assert lost == 0


def test_fingerprints_tell_sets_apart():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [1, 2, 4], [], [1, 2, 3], [0, 1, 2, 3])]
    keys = [tuple(r) for r in near.fingerprints(sets).tolist()]
    assert keys[0] == keys[3] and len(set(keys)) == 4


def test_whole_table_matches_counting(spark):
    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, SF).collect()}
    sets, where = {}, defaultdict(list)
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} - {()}
        for s in sets[d]:
            where[s].append(d)
    own = {d: d for d in texts}

    def root(d):
        while own[d] != d:
            d = own[d]
        return d

    shared = defaultdict(int)
    for d in texts:
        shared.clear()
        for s in sets[d]:
            for o in where[s]:
                if o < d:
                    shared[o] += 1
        for o, n in shared.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[o]) - n):
                a, b = root(d), root(o)
                own[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op6_circulant_minhash(spark, SF).collect()}
    assert got == {d: (len(sets[d]), root(d), root(d) == d) for d in texts}
