"""Each pipeline stage, and its operator, against a plain version on rows with repeated ids, repeated texts, nulls and extra columns."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillveil.llm import exact, mixing, near, store, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, node string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(k, n=30):
    return " ".join(f"w{(k * 37 + j * j * 11 + j) % 997}" for j in range(n))


ROWS = [(d, t, "en", s, 0, 1, "clash", "x", 2) for d, t, s in [
    *((k, sentence(k), ["a", "b", None][k % 3]) for k in range(40)),
    (5, sentence(1), "a"),  # another text under a known id: a copy of document 1
    (5, "  " + sentence(1) + "\n", "b"),
    (6, sentence(106), "a"),  # and one that occurs nowhere else
    (7, sentence(7), "b"), (7, sentence(7), "b"), (7, sentence(7), "b"),  # rows alike
    (300, sentence(8).replace("w", "w", 1) + " end", "a"), (301, sentence(8) + " fin", "b"),  # near copies of 8
    (9, sentence(10) + " more", "a"),  # a near copy of 10 under the id of 9
    (None, sentence(3), "a"), (None, sentence(3), "a"), (None, "nobody's text", None),
    (400, None, "a"), (400, None, "a"), (401, "", "a"), (402, " \n", "a"), (400, "", "a"),
    (500, "ß É " * 30_000, "b"), (501, "one", "a"), (502, "one", "b"),
]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(params=["small tables are broadcast", "nothing is broadcast"])
def limit(request, monkeypatch):
    if request.param.startswith("nothing"):
        monkeypatch.setattr(store, "BROADCAST_BYTES", 0)


def counted(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def plain(rows):
    return Counter((r[0], r[1]) for r in rows)


def least(d):
    return d if d is not None else 1 << 60


def test_exact_dedup_keeps_one_row_of_each_group(docs, limit):
    groups = defaultdict(list)
    for r in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    want = Counter()
    for g in groups.values():
        best = min(g, key=lambda r: (-len(r[1] or ""), least(r[0])))
        want[best[0], len(best[1] or "")] += 1
    got = corpus_pipeline.exact_dedup(docs.sparkSession, docs, SF)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, len(r.text or "")) for r in got.collect()) == want
    rows = exact.exact_dedup(docs).collect()
    assert len(rows) == len(ROWS) and sum(r.kept for r in rows) == len(groups)
    assert Counter((r.keep_id, r.group_size) for r in rows if r.kept) == Counter((min(g, key=lambda r: (-len(r[1] or ""), least(r[0])))[0], len(g)) for g in groups.values())


def near_groups(rows, size, percent=80):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    own = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = own[a], own[b]
                own = [min(x, y) if o in (x, y) else o for o in own]
    return sets, own


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_keeps_one_row_of_each_group(docs, size, limit):
    sets, own = near_groups(ROWS, size)
    groups = defaultdict(list)
    for r, s, o in zip(ROWS, sets, own):
        groups[o].append((r, len(s)))
    want_rows, want_kept = Counter(), Counter()
    for g in groups.values():
        head = min((r[0] for r, _ in g), key=least)
        for r, n in g:
            want_rows[r[0], n, head] += 1
        want_kept[head] += 1
    got = near.near_dedup(docs, size=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want_rows
    assert Counter(r.component_id for r in got if r.kept) == want_kept and all(r.doc_id == r.component_id for r in got if r.kept)
    stay = near.kept_rows(docs, size=size)
    assert stay.columns == docs.columns and Counter(r.doc_id for r in stay.collect()) == want_kept
    texts = counted(stay)
    for g in groups.values():  # of each group exactly one text, so no text that stands alone is lost
        assert sum(texts[k] for k in {(r[0], r[1]) for r, _ in g}) >= 1


def queue(rows):
    """Copies of each row that a plain weighted fair queue takes."""
    sizes = [len(WORD.findall(r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(sizes, rows) if r[3] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    open_, budget, target = set(sources), mixing.SHARE * sum(sizes), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        budget -= sum(2 * total[s] for s in full)
        open_ -= full
    return sizes, total, target


def test_mix_gives_each_row_its_share(docs, limit):
    sizes, total, target = queue(ROWS)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(ROWS)
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got) == Counter((r[0], n, total[r[3]], round(target[r[3]], 6)) for r, n in zip(ROWS, sizes))
    assert all(r.taken == r.copies * r["size"] and r.copies <= 2 for r in got)
    by = defaultdict(int)
    for r in got:
        by[r.source] += r.taken
    longest = {s: max(n for n, r in zip(sizes, ROWS) if r[3] == s) for s in total}
    assert all(abs(by[s] - target[s]) <= 2 * max(longest.values()) for s in total)
    taken = corpus_pipeline.mix_sources(docs.sparkSession, docs, SF)
    assert taken.columns == docs.columns
    want = Counter()
    for r in got:
        want[r.doc_id, r.source, r["size"]] += r.copies
    rows = taken.collect()
    assert Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in rows) == Counter({k: n for k, n in want.items() if n})
    each = Counter((r.doc_id, r.text, r.source) for r in rows)
    times = Counter((r[0], r[1], r[3]) for r in ROWS)
    assert all(n <= 2 * times[k] for k, n in each.items())


def test_a_group_at_the_cut_is_shared_out(spark):
    """Rows alike of which the mix takes some: whole parts for each, the rest for the first."""
    rows = [(1, "a b c", "s")] * 7 + [(2, "d e", "t")] * 2 + [(3, "f", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    total = defaultdict(int)
    for r in mixing.mixed(docs).collect():
        total[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.taken_rows(docs).collect()) == Counter({k: n for k, n in total.items() if n}) and 0 < total[1] % 7


def test_quality_stage_keeps_whole_rows(spark, docs):
    got = corpus_pipeline.quality_rules(spark, docs, SF)
    assert got.columns == docs.columns
    kept, all_rows = counted(got), plain(ROWS)
    assert kept and not kept - all_rows
    for r in ROWS:  # the base limits; rows alike are judged alike
        w = WORD.findall(r[1] or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        if len(w) < 10 or 100 * len(covered) > 20 * len(w):
            assert (r[0], r[1]) not in kept
        assert kept[r[0], r[1]] in (0, all_rows[r[0], r[1]])


def test_packing_stage(docs):
    tok = Tokenizer.from_file(tokens.default_path())
    want = Counter()
    for r in ROWS:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[r[0], k // 2048, zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    got = corpus_pipeline.best_fit_packing(docs.sparkSession, docs, SF).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in got) == want


def test_all_stages_on_empty_and_on_given_tables(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    got = corpus_pipeline.run(spark, SF).collect()
    offsets = defaultdict(list)
    for r in got:
        offsets[r.sequence_id].append((r.offset, r.length))
    for b in offsets.values():
        assert sum(n for _, n in b) <= 2048 and [o for o, _ in sorted(b)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(b)])[:-1]]).tolist()
