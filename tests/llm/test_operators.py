import mmap
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillveil.llm import arrow, counts, dac, eliasfano, exact, lm, mixing, near, packing, quality, queries, sharding, tagpaths, tokens, trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    rng = random.Random(3)
    lexicon = ["the", "and", "naïve", "straße", "re-do", "x1", "don't", "AA", "¿qué", "日本", "ét", "<|endoftext|>", "a\x0bb"]
    base = [" ".join(rng.choice(lexicon) + str(rng.randint(0, 30)) * (rng.random() < 0.5) for _ in range(rng.randint(12, 90))) for _ in range(30)]
    near_copies = [t + " tail" for t in base[:10]]
    edges = [None, "", " \n\t", "one", "One", "a\nb\na\nb\n", "the " * 5000, "Σ İ İx"]
    return base + near_copies + base[:7] * 2 + [base[3].replace(" ", "\n")] + edges


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, "en", ["a", "b", None][i % 3] if i % 4 else "hot", 0, 1, "clash") for i, t in enumerate(_texts())] + [(None, "no id at all", "en", "a", 0, 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, kept string").repartition(3)


@pytest.fixture(scope="module")
def plain():
    return {i * 3 + 1: t or "" for i, t in enumerate(_texts())} | {None: "no id at all"}


@pytest.fixture(scope="module")
def encoded(plain):
    tok = Tokenizer.from_file(tokens.default_path())
    return {d: tok.encode(t, add_special_tokens=False).ids for d, t in plain.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_codes(spark, docs, encoded, tmp_path):
    dac.write_tokens(docs, f"file://{tmp_path}/t")
    got = dac.read_tokens(spark, f"file://{tmp_path}/t").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {d: (len(i) + 1, crc(i + [1])) for d, i in encoded.items()}
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        assert r.start == at
        at += r.n_tokens


def test_segment_gives_any_token(tmp_path):
    ids = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32)
    raw = dac.encode(np.arange(2), np.zeros(2), np.array([0, 4000, 5000]), ids)
    (tmp_path / "s").write_bytes(raw)
    with open(tmp_path / "s", "rb") as f:
        s = dac.Segment(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        assert (s.tokens() == ids).all() and [s.token(i) for i in (0, 511, 512, 4999)] == ids[[0, 511, 512, 4999]].tolist()
        assert (s.document(1) == ids[4000:]).all()


def test_any_token_of_the_stream(spark, docs, encoded, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_TOKENS", 500)
    dac.write_tokens(docs, f"file://{tmp_path}/t")
    stream = [t for d in sorted(encoded, key=lambda d: (d is not None, d or 0)) for t in [*encoded[d], 1]]
    places = [*range(0, len(stream), 97), len(stream) - 1, 0, 0, -1, len(stream), None]
    got = dac.token_at(spark, f"file://{tmp_path}/t", spark.createDataFrame([(p,) for p in places], "position long")).collect()
    assert sorted(map(tuple, got)) == sorted({(p, stream[p]) for p in places if p is not None and 0 <= p < len(stream)})


def test_token_codes_of_an_empty_table(spark, docs, tmp_path):
    dac.write_tokens(docs.limit(0), f"file://{tmp_path}/t")
    assert dac.read_tokens(spark, f"file://{tmp_path}/t").count() == 0


def test_token_codes_of_repeated_rows(spark, tmp_path):
    rows = [(5, "one two"), (5, "one two"), (5, "another"), (None, None), (None, "x")]
    dac.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/t")
    got = dac.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 5, 5, 5] and got[3].ids_crc32 == got[4].ids_crc32 != got[2].ids_crc32


def test_packing(docs, encoded):
    got = packing.pack(docs, size=64, keep_ids=True).collect()
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got} == {(d, k // 64): crc((i + [0])[k : k + 64]) for d, i in encoded.items() for k in range(0, len(i) + 1, 64)}
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(b)])[:-1]]).tolist() and sum(n for _, n in b) <= 64
    assert len(bins) <= 1.05 * -(-sum(r.length for r in got) // 64) + 1


def test_bin_slack_plan_places_every_piece_once():
    rng = np.random.default_rng(2)
    c = {int(n): int(k) for n, k in zip(rng.choice(np.arange(1, 101), 40, replace=False), rng.integers(1, 500, 40))}
    p = packing.plan(c, 100)
    total = sum(n * k for n, k in c.items())
    assert p["first_bin"].max() + 1 <= 1.05 * total / 100 + 2
    for n in set(p["length"].tolist()):
        ranks = p["first_rank"][p["length"] == n]
        assert ranks[0] == 0 and (np.diff(ranks) > 0).all() and ranks[-1] < c[n]
    assert not len(packing.plan({}, 100)["length"])


def fewest(lengths, size):
    """Fewest bins, by trying all ways to deal the pieces."""
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= size and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(20))
def test_small_packings_take_nearly_the_fewest_bins(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
    counts = {n: lengths.count(n) for n in lengths}
    assert packing.plan(counts, 20)["first_bin"].max() + 1 <= fewest(lengths, 20) + 1


def test_exact_dedup(docs, plain):
    got = {r.doc_id: r for r in exact.exact_dedup(docs).collect()}
    groups = {}
    for d, t in plain.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(d)
    for g in groups.values():
        keep = min(g, key=lambda d: (-len(plain[d]), d if d is not None else 1 << 60))
        assert all((got[d].keep_id, got[d].group_size, got[d].kept) == (keep, len(g), d == keep) for d in g)


def _linked(plain, size=2):
    sets = {}
    for d, t in plain.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    own = {d: d for d in sets}
    ids = [d for d in sets if d is not None and sets[d]]
    for _ in ids:
        for a in ids:
            for b in ids:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    own[a] = own[b] = min(own[a], own[b])
    return sets, own


def test_near_dedup(docs, plain):
    small = {d: t for d, t in plain.items()}
    sets, own = _linked(small)
    got = near.near_dedup(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), own[d], own[d] == d) for d in small}


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    both, signer = arrow.mixed(rng.integers(0, 1 << 62, 1200).astype(np.uint64)), near.Signer(336)
    a, b = signer.sign(np.sort(both[:1000])), signer.sign(np.sort(both[200:]))
    assert abs((a == b).mean() - 800 / 1200) < 0.1


@pytest.mark.parametrize("n", [1, 9, 150, 5000])
def test_parity_sketch_drops_no_link(n):
    rng = np.random.default_rng(n)
    for _ in range(50):
        x = np.unique(arrow.mixed(rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)))
        a, b = x[: n + rng.integers(0, n + 1)], x[rng.integers(0, n + 1) :]
        unlike = int(np.bitwise_count((near.parity(a) ^ near.parity(b)).view(np.uint64)).sum())
        common = len(np.intersect1d(a, b))
        assert unlike <= len(a) + len(b) - 2 * common
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert unlike * 180 <= (len(a) + len(b)) * 20


def _oracle(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.execute(sql).df()


def test_mixing(docs):
    got, want = mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken").toPandas(), _oracle(mixing.ORACLE, docs)
    order = lambda df: df.sort_values("doc_id").reset_index(drop=True)[["size", "source_size", "target", "taken"]].astype(float)
    assert np.allclose(order(got), order(want))
    assert (got.taken <= 2 * got["size"]).all()


def test_resharding(docs, plain, spark):
    from pyspark.sql import functions as F

    got = sharding.reshard(docs, F.coalesce(F.pmod("doc_id", F.lit(4)).cast("int"), F.lit(0)), shards=5, old_shards=4).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in plain.items()}
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_min_cost_flow_moves_least():
    assert sharding.min_cost_flow([5, 1], [3, 3], lambda i, j: int(i != j)) == {(0, 0): 3, (0, 1): 2, (1, 1): 1}
    assert sum(sharding._level([9, 0, 0], 7)) == 7


def test_quality_statistics(plain):
    texts = [t for t in plain.values()]
    got, _ = quality.statistics(pa.array(texts))
    for k, t in enumerate(texts):
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)} if len(w) < 500 else set(range(len(w)))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert tuple(int(got[c][k]) for c in quality.COUNTS) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_trees_learn_and_keep_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    f = trees.fit(x, (x[:, 0] + 0.3 * rng.random(2000) < 0.6).astype(float), {0: -1})
    grid = np.column_stack([np.linspace(0, 1, 200), np.full((200, 2), 0.5)])
    assert (np.diff(f.margin(grid)) <= 1e-12).all() and ((f.margin(x) > 0) == (x[:, 0] < 0.45)).mean() > 0.85


def test_token_counts_match_brute_force(docs, plain):
    scores = counts.pieces(counts.default_path())

    def best(word):
        top = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            n = len(word[d - 1].encode())
            top.append(max([(top[d - 1][0] + n * counts.BYTE_SCORE, top[d - 1][1] - n)] + [(top[j][0] + scores[word[j:d]], top[j][1] - 1) for j in range(d) if word[j:d] in scores]))
        return -top[-1][1]

    known = {w: best("▁" + w) for t in plain.values() for w in WORD.findall(t)}
    assert {r.doc_id: r.n_tokens for r in counts.token_counts(docs).collect()} == {d: sum(known[w] for w in WORD.findall(t)) for d, t in plain.items()}


def test_elias_fano_and_trie():
    rng = np.random.default_rng(7)
    v = np.unique(rng.integers(0, 1 << 40, 3000).astype(np.uint64))
    e = eliasfano.EliasFano(eliasfano.EliasFano.packed(v, 1 << 40))
    q = np.concatenate([v[::7], rng.integers(0, 1 << 40, 500).astype(np.uint64)])
    at, same = e.find(q)
    assert (at == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all() and (e.at(np.arange(len(v))) == v).all()
    contexts, owner, words = np.array([5, 9, 1 << 60], np.uint64), np.array([0, 0, 2]), np.array([3, 8, 8])
    t = eliasfano.Trie(eliasfano.Trie.packed(contexts, np.array([-1.0, -2, -3]), owner, words, np.array([-0.5, -0.25, -0.125])))
    got = t.score(np.array([5, 5, 9, 7, 1 << 60], np.uint64), np.array([3, 4, 8, 8, 8], np.uint64), np.full(5, -4.0))
    assert np.allclose(got, [-0.5, -5, -6, -4, -0.125]) and t.successors(0) == (0, 2) and t.successors(1) == (2, 2) and t.successors(2) == (2, 3)


def test_a_pair_is_found_in_the_range_of_its_context():
    rng = np.random.default_rng(9)
    contexts, words = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64) << np.uint64(1)) for k in (300, 400))
    pairs = np.unique(rng.integers(0, 300 * 400, 3000))
    owner, logs = pairs // 400, -rng.random(len(pairs))
    back = -rng.random(300)
    t = eliasfano.Trie(eliasfano.Trie.packed(contexts, back, owner, words[pairs % 400], logs))
    for c in range(300):
        assert t.successors(c) == (np.searchsorted(owner, c), np.searchsorted(owner, c, "right"))
    c, w, low = rng.integers(0, 300, 5000), rng.integers(0, 400, 5000), -rng.random(5000)
    got = t.score(contexts[c], words[w], low)
    known = dict(zip(pairs.tolist(), logs))
    want = np.array([known.get(a * 400 + b, l + back[a]) for a, b, l in zip(c.tolist(), w.tolist(), low)])
    assert np.abs(got - want).max() < 0.02 and (t.score(np.array([1, 3], np.uint64), words[:2], low[:2]) == low[:2]).all()


def test_language_model(docs, plain):
    got = {r.doc_id: r for r in lm.scored(docs).collect()}
    toks = {d: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for d, t in plain.items()}
    train = [d for d in toks if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    c = {}
    for d in train:
        for w in toks[d]:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    for d, ws in toks.items():
        base = sum(np.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in ws)
        assert (got[d].held_out, got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (d not in train, len(ws), sum(w in c for w in ws), n)
        assert abs(got[d].base_score - base) < 1e-6 * max(1, abs(base)) and got[d].score < 0


def test_main_text():
    page = """<html><head><title>t</title><script>x='</p>'</script></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>A &amp; B</h1><p>First, a   sentence.<br>Second<b> bold</b>!<p>Third &lt;one&gt;.<aside>Related</aside><section id="comments"><p>Nice post, thanks.</p></section></article><footer>&copy;</footer></body></html>"""
    assert tagpaths.main_text(page) == "A & B\nFirst, a sentence.\nSecond bold!\nThird <one>."
    assert tagpaths.main_text(None) == tagpaths.main_text("") == tagpaths.main_text("<p></p>") == ""


def test_empty_tables(spark, docs):
    empty = docs.limit(0)
    for run in (exact.exact_dedup, near.near_dedup, mixing.mixed, counts.token_counts, packing.pack, lm.scored):
        assert run(empty).count() == 0
    assert quality.judged(empty, None).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf, documents = "/root/testdata/sf0.001", queries.documents(spark, "/root/testdata/sf0.001")
    before = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == documents.columns and (name == "mix_sources" or 0 < after.count() <= before.count())
        before = after
