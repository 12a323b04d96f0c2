"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest bytes moved.

Law ``bytes``: shard sizes come out near equal. What moves is a unit: all rows of one text, which lie in the old shard that holds
most of their bytes, and go to one new shard together. Only a text whose rows together exceed a sixteenth of a new shard is split
into its rows, as no law of near-equal sizes could hold otherwise; single documents above that (16 times the number of shards at
most) are placed one by one, longest first, and stay where they are if they can. All other units are a flow from old shards to
new capacities, of which a byte costs 1 when it moves and 0 when it stays; each arc of the flow becomes one run of units of its
old shard. The flow moves the fewest bytes for the capacities that the heavy documents leave; these are placed greedily. Places
along an old shard and slots in a new one are counted in buckets, so no shard needs one task.

Defined results: a null text has no bytes and is one with the empty text; rows that repeat a doc_id are placed each; null doc_ids
are placed like others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

SHARDS, OLD_SHARDS, OVERHEAD, HEAVY = 40, 32, 16, 16


def min_cost_flow(supply: list[int], capacity: list[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Cheapest flow that sends all supply to the capacities, by successive shortest paths; amounts by (from, to)."""
    if sum(supply) > sum(capacity):
        raise ValueError("supply exceeds capacity")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    room = [dict() for _ in range(n + m + 2)]
    price: dict[tuple[int, int], int] = {}

    def arc(a: int, b: int, most: int, c: int) -> None:
        room[a][b], price[a, b] = most, c
        room[b].setdefault(a, 0)
        price[b, a] = -c

    for i, x in enumerate(supply):
        arc(source, i, x, 0)
        for j in range(m):
            arc(i, n + j, x, cost(i, j))
    for j, x in enumerate(capacity):
        arc(n + j, sink, x, 0)
    while True:
        best, via, todo, waiting = {source: 0}, {}, deque([source]), {source}
        while todo:
            a = todo.popleft()
            waiting.discard(a)
            for b, most in room[a].items():
                if most and (b not in best or best[a] + price[a, b] < best[b]):
                    best[b], via[b] = best[a] + price[a, b], a
                    if b not in waiting:
                        waiting.add(b)
                        todo.append(b)
        if sink not in best:
            break
        path, b = [], sink
        while b != source:
            path.append((via[b], b))
            b = via[b]
        push = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= push
            room[b][a] += push
    return {(i, j): room[n + j][i] for i in range(n) for j in range(m) if room[n + j].get(i)}


def _level(load: list[int], total: int) -> list[int]:
    """Capacities beside the loads that hold ``total`` and make the sums as equal as can be."""
    order, rest, room = sorted(range(len(load)), key=lambda j: load[j]), total, [0] * len(load)
    for k in range(len(load), 0, -1):
        level = (rest + sum(load[j] for j in order[:k])) // k
        if level >= load[order[k - 1]]:
            extra = rest + sum(load[j] for j in order[:k]) - level * k
            for r, j in enumerate(order[:k]):
                room[j] = level - load[j] + (r < extra)
            return room
    return room


def transfers(old_sizes: list[int], heavy: list[tuple[int, int]], shards: int) -> tuple[list[int], dict[tuple[int, int], int]]:
    """New shard of each heavy document (old shard, bytes), and the flow of all other bytes."""
    total = sum(old_sizes) + sum(b for _, b in heavy)
    load, placed = [0] * shards, [0] * len(heavy)
    for k in sorted(range(len(heavy)), key=lambda k: -heavy[k][1]):
        old, size = heavy[k]
        j = old if old < shards and load[old] + size <= total // shards else min(range(shards), key=lambda j: load[j])
        placed[k], load[j] = j, load[j] + size
    return placed, min_cost_flow(old_sizes, _level(load, sum(old_sizes)), lambda i, j: int(i != j))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def mark_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: What tells texts apart: 64 bits of hash, 32 of checksum, and the length.
TEXT = ("text_mark", "text_crc32", "size")


def reshard(docs: DataFrame, old_shard: Column, *, shards: int = SHARDS, old_shards: int = OLD_SHARDS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's place: doc_id, size, text_crc32, old_shard, shard, slot [, carried columns]. ``old_shard``: 0 to old_shards - 1."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size_of(text).alias("size"), crc_of(text).alias("text_crc32"), mark_of(text).alias("text_mark"), old_shard.cast("int").alias("old_shard"), *carry)
    buckets = 4 * store.partitions(spark)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_mark"), F.lit(buckets)).cast("int"))
    rows = store.written(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")  # the write fixes the numbers
    limit = (rows.agg(F.sum("size")).first()[0] or 0) / shards / HEAVY
    whole = rows.groupBy(*TEXT, "old_shard").agg(F.sum("size").alias("part"), F.min("row").alias("row")).groupBy(*TEXT)
    whole = whole.agg(F.sum("part").alias("bytes"), F.max(F.struct("part", (-F.col("old_shard")).alias("minus"))).alias("home"), F.min("row").alias("unit"))
    whole = store.written(whole.select(*TEXT, "bytes", (-F.col("home.minus")).alias("home"), "unit"), "texts")
    split = F.broadcast(whole.where(F.col("bytes") > limit).select(*TEXT))  # shards * HEAVY rows at most
    alone = store.written(rows.join(split, list(TEXT), "left_semi"), "alone")
    heavy = alone.where(F.col("size") > limit).select("row", "size", "old_shard").orderBy("size", "doc_id", "text_mark", "old_shard").collect()  # under shards * HEAVY rows

    bucket = F.pmod(F.col("text_mark"), F.lit(buckets)).cast("int").alias("bucket")
    units = whole.where(F.col("bytes") <= limit).select("home", "bytes", "unit", *TEXT, F.lit(None).cast("long").alias("doc_id"), bucket)
    units = units.unionByName(alone.where(F.col("size") <= limit).select(F.col("old_shard").alias("home"), F.col("size").alias("bytes"), F.col("row").alias("unit"), *TEXT, "doc_id", "bucket"))
    sizes = {r["home"]: r["s"] for r in units.groupBy("home").agg(F.sum("bytes").alias("s")).collect()}  # old_shards rows
    placed, flow = transfers([sizes.get(i, 0) for i in range(old_shards)], [(r["old_shard"], r["size"]) for r in heavy], shards)
    runs, at = [], dict.fromkeys(range(old_shards), 0)
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        runs.append((i, at[i], at[i] + amount, j))
        at[i] += amount
    runs = spark.createDataFrame(runs, "from_shard int, low long, high long, shard int")  # old_shards + shards rows at most
    singles = spark.createDataFrame([(r["row"], j) for r, j in zip(heavy, placed)], "unit long, shard int")

    before = Window.partitionBy("home").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = units.groupBy("home", "bucket").agg(F.sum("bytes").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inside = Window.partitionBy("home", "bucket").orderBy("text_mark", "text_crc32", "size", "doc_id", "unit").rowsBetween(Window.unboundedPreceding, 0)
    light = units.withColumn("upto", F.sum("bytes").over(inside)).join(bases, ["home", "bucket"])
    light = light.withColumn("middle", F.col("base") + F.col("upto") - F.expr("bytes div 2 + 1"))
    light = light.join(F.broadcast(runs), (F.col("home") == F.col("from_shard")) & (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high")))
    to = store.written(light.select("unit", *TEXT, "shard"), "units")

    # rows of a unit follow it by text, rows of split texts by number
    names = [*rows.columns, "shard"]
    grouped = rows.join(split, list(TEXT), "left_anti")
    known = to.join(split, list(TEXT), "left_anti").select(*TEXT, "shard")
    out = grouped.join(store.small(known, whole.count(), 24), list(TEXT)).select(*names)
    own = to.select(F.col("unit").alias("row"), "shard").unionByName(singles.select(F.col("unit").alias("row"), "shard"))
    out = out.unionByName(alone.join(own, "row").select(*names))
    out = store.written(out, "shards")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = out.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    slot = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    out = out.withColumn("slot", slot).join(bases, ["shard", "bucket"]).withColumn("slot", F.col("slot") + F.col("base"))
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", F.col("slot").cast("long").alias("slot"), *carry)


#: Known of a row before and after it is placed; no nulls, so that rows dealt by it are joined where they lie.
KEY = ("id", "no_id", "size", "text_crc32", "old_shard")
WRITTEN = "doc_id long, text string, old_shard int, slot long, shard int"
#: Bytes of texts that a file is meant to hold.
FILE_BYTES = 32 << 20


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()})


def _with_text(rows: DataFrame, placed: DataFrame, parts: int) -> DataFrame:
    """``rows`` (KEY, doc_id and text) at their places, dealt by KEY; of rows with the same key each takes one place."""
    groups = placed.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("shard", "slot")).alias("place"))
    groups = store.written(groups.select(*KEY, "n", "place.*"), "places")
    # the texts are shuffled once, whatever the size of the places: what is broadcast here would grow with the documents
    out = rows.repartition(parts, *KEY).join(groups.where("n = 1").drop("n").hint("shuffle_hash"), list(KEY))
    many = groups.where("n > 1").select(*KEY)
    if many.head(1):
        copy = lambda *by: F.row_number().over(Window.partitionBy(*KEY).orderBy(*by)).alias("copy")
        places = placed.select(*KEY, "shard", "slot").join(many, list(KEY), "left_semi").select("*", copy("shard", "slot"))
        again = rows.join(many, list(KEY), "left_semi").select("*", copy("text"))
        out = out.unionByName(again.join(places, [*KEY, "copy"]).drop("copy"))
    return out


def rewrite(docs: DataFrame, old_shard: Column, placed: DataFrame, out: str, *, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Write the affected shards (those that a row enters or leaves) to ``out``, a folder each, an empty one for a shard that all
    rows leave; the others' files stay as they are. ``placed``: what ``reshard`` gave for the same rows.

    Texts are shuffled once, to their places, and each task writes a file for each shard: there are as many tasks as the cluster has
    cores, or as many as keep files at ``FILE_BYTES`` if those are more.
    """
    moved = placed.where("shard <> old_shard")
    affected = sorted({r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect()})  # old and new shards at most
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), size_of(text).alias("size"), crc_of(text).alias("text_crc32"), old_shard.cast("int").alias("old_shard"))
    placed = placed.where(F.col("shard").isin(affected)) if affected else placed.limit(0)
    load = {r["shard"]: r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()}  # new shards at most
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-sum(load.values()) // (FILE_BYTES * max(1, len(load)))))
    rows = _with_text(_keyed(rows), _keyed(placed), parts)
    rows.select("doc_id", "text", "old_shard", "slot", "shard").write.option("compression", "zstd").partitionBy("shard").parquet(out)
    for k in set(affected) - set(load):
        docs.sparkSession.createDataFrame([], WRITTEN).drop("shard").write.parquet(f"{out}/shard={k}")
    return affected


def resharded(docs: DataFrame, old_shard: Column, out: str, **options) -> DataFrame:
    """As ``reshard``, with the affected shards written to ``out`` and their rows' sizes, checksums and places taken from the files."""
    placed = store.written(reshard(docs, old_shard, **options), "placed")
    affected = rewrite(docs, old_shard, placed, out)
    read = docs.sparkSession.read.schema(WRITTEN).parquet(out)
    read = read.select("doc_id", size_of(F.col("text")).alias("size"), crc_of(F.col("text")).alias("text_crc32"), "old_shard", "shard", "slot")
    return read.unionByName(placed.where(~F.col("shard").isin(affected)) if affected else placed)
