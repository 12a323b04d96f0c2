"""Near-duplicate documents by circulant MinHash.

A document's set is its distinct word shingles. One permutation scatters the shingles over positions (a bijective mix of their
64-bit hashes, cut to ``BITS`` bits); a second one, a table, gives each position its rank, and coordinate k of the signature is
the least rank after a circular shift by k. All coordinates of a shingle are one contiguous slice of the table. Bands of the
signature name candidates; each link is confirmed on the full sets.

Documents with equal sets are one class and go on as one representative. Each representative is held against one leader of its
buckets first; while a bucket still falls into several components, its members are held against its own leader, then a second
one, and at last every pair across components is checked. Before full sets meet, two sketches of them do: one bit of each
coordinate, and the parity of the shingles that fall on each of ``64 * PARITY`` places. Places of unlike parity can't outnumber
the shingles that only one set has, so the latter drops no link. Components are found by label propagation with pointer jumping
in tables.

Equal sets are told by their sizes and by 128 bits of BLAKE2b over the whole sorted set.

Defined results: texts without words have an empty set and link with nothing; a null doc_id links with nothing and is its own,
null, component; rows that repeat a doc_id are nodes of their own, so other texts under that id aren't touched, and exactly one
row of a component stays; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow, store
from . import rows as R

#: Chance that a link of exactly the least similarity, 0.8, shares no band: (1 - 0.8 ** 7) ** 48 = 1e-5.
BANDS, ROWS, BITS, SEED = 48, 7, 20, 11
#: 64-bit words of the one-bit sketch (a bit of each of 320 coordinates). Sets of similarity s differ in (1 - s) / 2 of the bits;
#: candidates that differ in more than the mean at the least similarity and six standard deviations are not held against each other.
SKETCH = 5
#: 64-bit words of the parity sketch. It tells sets of up to some 1,300 shingles apart; larger ones are left to the other sketch.
PARITY = 16
#: Members of a bucket that one task compares with the rest of it; larger buckets are salted.
BUCKET_ROWS, SALTS = 512, 64
_U = np.uint64


def sketch_bound(percent: int) -> int:
    bits, p = 64 * SKETCH, (100 - percent) / 200
    return int(bits * p + 6 * (bits * p * (1 - p)) ** 0.5)


def alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches (columns a_n, a_s0.., a_p0.., and b's) leave room for the similarity."""
    unlike = {k: " + ".join(f"bit_count({a}_{k}{i} ^ {b}_{k}{i})" for i in range(n)) for k, n in (("s", SKETCH), ("p", PARITY))}
    own = f"({unlike['p']}) * {100 + percent} <= ({a}_n + {b}_n) * {100 - percent}"
    return similar_sizes(F.col(f"{a}_n"), F.col(f"{b}_n"), percent) & F.expr(own) & F.expr(f"({unlike['s']}) <= {sketch_bound(percent)}")


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bit k: whether an odd number of shingles falls on place k."""
    at = (arrow.mixed(shingles ^ _U(0x165667B19E3779F9)) % _U(64 * PARITY)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * PARITY) & 1).astype(np.uint8)).view(np.int64)


def shingle_sets(col: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    flat, offsets = arrow.words(pc.ascii_lower(col))
    if not len(flat):
        yield from (np.empty(0, _U) for _ in range(len(offsets) - 1))
        return
    codes, distinct = arrow.coded(flat)
    h = arrow.hashes(distinct)[codes]
    shingles = arrow.rolled(h, size)
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        if b - a >= size:
            yield np.unique(shingles[a : b - size + 1])
        else:  # the whole sequence is one shingle
            yield arrow.rolled(h[a:b], b - a) ^ _U(b - a) if b > a else np.empty(0, _U)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each whole set."""
    return np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)


class Signer:
    """Signatures from two permutations."""

    def __init__(self, coordinates: int, bits: int = BITS, seed: int = SEED):
        self.bits, self.coordinates = bits, coordinates
        ranks = np.random.default_rng(seed).permutation(1 << bits).astype(np.int32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: coordinates - 1]]), coordinates)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        at = (arrow.mixed(shingles) >> _U(64 - self.bits)).astype(np.int64)
        out = np.full(self.coordinates, 1 << 30, np.int32)
        for k in range(0, len(at), 2048):
            np.minimum(out, self.shifted[at[k : k + 2048]].min(axis=0), out=out)
        return out


SKETCHES = [*(f"s{k}" for k in range(SKETCH)), *(f"p{k}" for k in range(PARITY))]
SIGNED = "doc_id long, mark long, bytes int, n long, fp1 long, fp2 long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCHES)


def _signed(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.forget()
        signer = Signer(bands * rows)
        own = arrow.mixed(np.arange(1, bands * rows + 1, dtype=_U))
        for batch, col in arrow.sliced(batches, "text", 4 << 20):
            sets = list(shingle_sets(col, size))
            n = np.array([len(s) for s in sets], np.int64)
            prints = fingerprints(sets)
            signatures = np.stack([signer.sign(s) for s in sets]).astype(_U)
            scattered = arrow.mixed(signatures + own)
            keys = arrow.mixed(scattered.reshape(-1, bands, rows).sum(2, dtype=_U)).view(np.int64)
            sketches = np.packbits((scattered[:, : 64 * SKETCH] >> _U(32) & _U(1)).astype(np.uint8), axis=1).view(np.int64)
            sketches = np.hstack([sketches, np.stack([parity(s) for s in sets])])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists, *(pa.array(sketches[:, k]) for k in range(len(SKETCHES)))], ["doc_id", "mark", "bytes", "n", "fp1", "fp2", "bands", *SKETCHES])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in arrow.sliced(batches, "text", 4 << 20):
            sets = list(shingle_sets(col, size))
            n, prints = np.array([len(s) for s in sets], np.int64), fingerprints(sets)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists], ["doc_id", "n", "fp1", "fp2", "shingles"])

    return run


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    """Sets of other sizes can't reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def on_component(rows: DataFrame, found: DataFrame, spread: str) -> DataFrame:
    """``rows`` joined with ``found``, which has one row for each component: broadcast if its size allows, else salted by the column
    ``spread``, as a component may hold a third of all rows."""
    found = store.written(found, "by-component")
    count = found.count()
    if count * (24 + store.ROW_BYTES) <= store.BROADCAST_BYTES:
        return rows.join(F.broadcast(found), "component", "left")
    salts = max(16, store.partitions(rows.sparkSession) // 8)
    rows = rows.withColumn("salt_of", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    found = found.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(found, ["component", "salt_of"], "left").drop("salt_of")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge."""
    both = store.written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = store.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")) if both.head(1) else both.select(F.col("a").alias("node"), F.col("b").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = store.written(labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "labels")
        names = new.select("component").distinct()  # a component's name is one of its nodes
        tops = names.join(new.select(F.col("node").alias("component"), F.col("component").alias("top")), "component")
        new = store.written(on_component(new, tops, "node").select("node", "old", F.least("component", "top").alias("component")), "labels")
        if not new.where("component <> old").head(1):
            return new.select("node", "component")
        labels = new.select("node", "component")


def judged(docs: DataFrame, *, size: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, mark, bytes, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    texts = arrow.modest(docs).select(*R.key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    salt = F.pmod(F.xxhash64("node"), F.lit(max(16, store.partitions(spark)))).cast("int").alias("salt")
    # the write fixes the number of each row, its node
    signed = store.written(texts.mapInArrow(_signed(size, bands, rows), SIGNED).withColumn("node", F.monotonically_increasing_id()), "signed").select("*", salt)
    linkable = signed.where("n > 0 and doc_id is not null")
    key = ["fp1", "fp2", "n"]
    by_salt = linkable.groupBy(*key, "salt").agg(F.min(F.struct("doc_id", "node")).alias("least"), F.count("*").alias("c"))
    classes = store.written(by_salt.groupBy(*key).agg(F.min("least").alias("rep"), F.sum("c").alias("c")).where("c > 1").drop("c"), "classes")
    salted = by_salt.select(*key, "salt").join(classes, key)
    alone = linkable.join(salted, [*key, "salt"], "left").where("rep is null or rep.node = node")

    flat = alone.select("node", F.explode("bands").alias("bucket"))
    shared = flat.groupBy("bucket").agg(F.count("*").alias("met")).where("met > 1")
    places = store.written(flat.join(shared, "bucket"), "places")
    # whoever meets most others leads: the text that a group's copies were made from is nearer to each than they are to each other
    order = F.xxhash64("node").alias("order")
    placed = places.drop("met").join(places.groupBy("node").agg(F.sum("met").alias("meets")), "node")
    lead = F.min(F.struct((-F.col("meets")).alias("lead_order"), order, F.col("node").alias("lead"))).alias("first")
    leaders = placed.groupBy("bucket").agg(lead).select("bucket", "first.lead", "first.lead_order")
    members = store.written(placed.drop("meets").join(leaders, "bucket"), "members")
    sketches = store.written(alone.select("node", "doc_id", *key, *SKETCHES).join(members.select("node").distinct(), "node", "left_semi"), "sketches")
    n_wanted = sketches.count()
    own = sketches.select(F.col("doc_id").alias("wanted")).distinct()
    sets = texts.join(store.small(own, n_wanted, 8), F.col("doc_id") == F.col("wanted"), "left_semi").select("doc_id", "text")
    sets = sets.mapInArrow(_sets(size), "doc_id long, n long, fp1 long, fp2 long, shingles array<long>").dropDuplicates(["doc_id", *key])
    sets = store.written(sets.join(store.small(sketches.select("node", "doc_id", *key), n_wanted, 40), ["doc_id", *key]).select("node", "shingles"), "sets")

    def sketched(df: DataFrame, side: str) -> DataFrame:
        named = sketches.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", *SKETCHES)))
        return df.join(store.small(named, n_wanted, 16 + 8 * len(SKETCHES)), side)

    def plausible(pairs: DataFrame) -> DataFrame:
        return sketched(sketched(pairs, "a"), "b").where(alike("a", "b", percent)).select(*pairs.columns)

    led = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"), "lead_order").distinct()
    led = store.written(plausible(led), "led")
    first = led.groupBy("b").agg(F.min(F.struct("lead_order", "a")).alias("first"))  # one leader a document, the same for most of a group
    links = store.written(linked(first.select("first.a", "b"), sets, percent), "links")
    found = components(links)
    for step in ("leaders", "second leaders", "rest"):

        def within(df: DataFrame, node: str, component: str) -> DataFrame:
            own = found.select(F.col("node").alias(node), F.col("component").alias(component))
            return df.join(own, node, "left").withColumn(component, F.coalesce(component, node))

        if step == "leaders":
            more = within(within(led, "a", "core"), "b", "own").where("own <> core").select("a", "b")
        else:
            named = within(within(members, "node", "own"), "lead", "core")
            outer, others = named.where("own <> core"), named.where("node <> lead")
        if step == "second leaders":
            second = F.min(F.struct(order, F.col("node").alias("a"), F.col("own").alias("a_own"))).alias("second")
            more = others.join(outer.groupBy("bucket").agg(second).select("bucket", "second.a", "second.a_own"), "bucket").where("own <> a_own")
            more = plausible(more.select("a", F.col("node").alias("b")).distinct())
        elif step == "rest":  # all pairs across components that are left; a large bucket is dealt to several tasks
            wide = outer.groupBy("bucket").agg(F.least(F.lit(SALTS), F.ceil(F.count("*") / BUCKET_ROWS)).cast("int").alias("wide"))
            x = outer.join(wide, "bucket").select("bucket", F.col("node").alias("x"), F.col("own").alias("x_own"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("part"))
            y = others.join(wide, "bucket").select("bucket", F.col("node").alias("y"), F.col("own").alias("y_own"), F.pmod(F.xxhash64("node"), F.col("wide")).cast("int").alias("part"))
            more = sketched(y, "y").join(sketched(x, "x"), ["bucket", "part"]).where((F.col("x_own") != F.col("y_own")) & alike("x", "y", percent))
            more = more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        more = store.written(linked(more, sets, percent), "links")
        if more.head(1):
            links = links.unionByName(more)
            found = components(links)

    # each class of equal sets gets the first row (by doc_id) of its component
    tied = alone.select("doc_id", "node", *key).join(found, "node")
    heads = tied.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("head"))
    tied = on_component(tied, heads, "node").select(*key, "head")
    equal = classes.join(found, F.col("rep.node") == F.col("node"), "left_anti").select(*key, F.col("rep").alias("head"))
    named = by_salt.select(*key, "salt").join(tied.unionByName(equal), key)
    out = signed.select("doc_id", "mark", "bytes", "node", *key, "salt").join(named, [*key, "salt"], "left")
    alone = F.col("head").isNull() | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id")
    return out.select("doc_id", "mark", "bytes", F.col("n").alias("n_shingles"), component, (alone | (F.col("node") == F.col("head.node"))).alias("kept"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept. Options as of ``judged``."""
    return judged(docs, **options).select("doc_id", "n_shingles", "component_id", "kept")


def kept_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns: one of each group of near duplicates."""
    verdicts = judged(docs, id_col=id_col, text_col=text_col, **options)
    return R.kept_rows(docs, verdicts.select(*R.KEY, "kept"), id_col=id_col, text_col=text_col)
