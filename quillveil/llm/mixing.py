"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words of its source up to and with it, in shuffled order, divided by
the source's target. Sorted by finish time over all sources, the copies are taken until the total budget is used up. Sums along
a source and along the whole queue are taken in buckets of the sort key, so neither a source nor the queue needs one task.

Sources are few (labels, not hosts or pages): their targets are worked out in one task, a row for each source.

Defined results: a null text has 0 words; a null source is a source of its own, last in order; a source without words has
target 0; rows that repeat a doc_id are documents of their own, which share a place in the queue, so which of those of equal
source and size is taken more often isn't told; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix"
#: Finish times are compared as whole multiples of 2**-40.
UNIT = 1 << 40
#: Copies at the cut that are put in order one by one.
CUT_ROWS = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target. ``sizes``: source, source_size, a row for each source.

    With all sources in order of cap / weight, the level is the largest of (budget - caps before) / (weights from here on);
    a target is level times weight, or the cap.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    left = F.sum("source_size").over(whole) * share - (F.sum("cap").over(upto) - F.col("cap"))
    weights_left = F.sum("weight").over(whole) - (F.sum("weight").over(upto) - F.col("weight"))
    t = t.withColumn("level", left / weights_left).withColumn("level", F.max("level").over(whole))
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _cut(copies: DataFrame, budget: float) -> tuple[int, int, float]:
    """Key range [low, high) in which the queue reaches the budget, and the words before it; by histograms of 1,024 classes."""
    low, shift, before = 0, 52, 0.0
    while True:
        inside = copies.where((F.col("key") >= low) & (F.col("key") < low + (1 << shift + 10)))
        classes = inside.groupBy(F.expr(f"shiftright(key - {low}L, {shift})").alias("c")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).orderBy("c").collect()
        for r in classes:
            if before + r["s"] > budget:
                low += r["c"] << shift
                if r["n"] <= CUT_ROWS or shift == 0:
                    return low, low + (1 << shift), before
                shift = max(0, shift - 10)
                break
            before += r["s"]
        else:
            return 1 << 62, 1 << 62, before  # all fits


def queue(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """All copies with their finish time and whether the mix takes them: row (numbers the input's rows), doc_id, source, size, source_size, target, epoch, key, taken."""
    spark = docs.sparkSession
    buckets = min(1 << 16, 4 * store.partitions(spark))
    rows = store.written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    sources = store.written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs), "targets")
    budget, known = sources.agg(F.sum("source_size"), F.count("*")).first()
    budget = share * (budget or 0)
    copies = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.withColumn("place", F.md5(F.concat_ws("|", F.lit(seed), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    copies = copies.withColumn("bucket", F.expr(f"cast(conv(substring(place, 1, 4), 16, 10) as int) * {buckets} div 65536").cast("int"))
    before = Window.partitionBy("source").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = copies.groupBy("source", "epoch", "bucket").agg(F.sum("size").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("place", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    copies = copies.withColumn("inside", F.sum("size").over(inside)).alias("c")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("source", "epoch", "bucket")]
    copies = copies.join(bases.alias("b"), same[0] & same[1] & same[2]).select("c.*", (F.col("base") + F.col("inside")).alias("words")).alias("c")
    copies = copies.join(store.small(sources, known, 64).alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.*", "s.source_size", "s.target")
    finish = F.when(F.col("target") > 0, F.least(F.floor(F.col("words") / F.col("target") * UNIT), F.lit((1 << 62) - 1))).otherwise((1 << 62) - 1)
    copies = store.written(copies.select("row", "doc_id", "source", "size", "source_size", "target", "epoch", finish.cast("long").alias("key")), "queue")
    low, high, words = _cut(copies, budget)
    near = Window.orderBy("key", F.col("source").asc_nulls_last(), "epoch", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = copies.where((F.col("key") >= low) & (F.col("key") < high)).withColumn("taken", F.sum("size").over(near) + words <= budget)
    rest = copies.where((F.col("key") < low) | (F.col("key") >= high)).withColumn("taken", F.col("key") < low)
    return rest.unionByName(edge)


def in_order(copies: DataFrame) -> DataFrame:
    """The taken copies, range-sorted by finish time: the order in which a trainer reads the mix."""
    return copies.where("taken").repartitionByRange(store.partitions(copies.sparkSession), "key", "doc_id").sortWithinPartitions("key", "doc_id", "epoch")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (how often the mix takes it), taken (words)."""
    taken = F.col("taken").cast("long")
    out = queue(docs, **options).groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(F.sum(taken).alias("copies"), F.sum(taken * F.col("size")).alias("taken"))
    return out.drop("row")


def taken_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it.

    Rows alike in doc_id, source and size share what the mix takes of them: each gets the whole part, and the first of them one
    more until the rest is used up. Only at the cut is there a rest, so for a group or two of a source.
    """
    known = ("doc_id", "source", "size")
    taken = queue(docs, id_col=id_col, text_col=text_col, source_col=source_col, epochs=epochs, **options).groupBy(*known)
    taken = taken.agg(F.sum(F.col("taken").cast("long")).alias("all"), F.sum((F.col("epoch") == 0).cast("long")).alias("alike")).where("all > 0")
    taken = store.written(taken.select(*(F.col(c).alias(f"mix_{c}") for c in known), F.expr("all div alike").cast("int").alias("mix_copies"), (F.col("all") % F.col("alike")).alias("mix_rest")), "taken")
    count, rests = taken.agg(F.count("*"), F.coalesce(F.sum((F.col("mix_rest") > 0).cast("long")), F.lit(0))).first()
    names = [f"`{c}`" for c in docs.columns]
    own = docs.select(*names, F.col(id_col).cast("long").alias("quillveil_id"), F.col(source_col).cast("string").alias("quillveil_source"), n_words(F.col(text_col)).alias("quillveil_size"))
    same = F.col("quillveil_id").eqNullSafe(F.col("mix_doc_id")) & F.col("quillveil_source").eqNullSafe(F.col("mix_source")) & (F.col("quillveil_size") == F.col("mix_size"))
    copied = lambda rows, n: rows.where(n > 0).withColumn("quillveil_copy", F.explode(F.sequence(F.lit(1), n))).select(*names)
    out = copied(own.join(store.small(taken.where("mix_rest = 0"), count, 64), same), F.col("mix_copies"))
    if rests:
        part = own.join(store.small(taken.where("mix_rest > 0"), rests, 64), same).withColumn("quillveil_row", F.monotonically_increasing_id())
        part = store.written(part.withColumn("quillveil_part", F.spark_partition_id()), "rests")  # the write fixes the numbers
        group = ["mix_doc_id", "mix_source", "mix_size"]
        before = Window.partitionBy(*group).orderBy("quillveil_part").rowsBetween(Window.unboundedPreceding, -1)
        bases = part.groupBy(*group, "quillveil_part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        bases = bases.select(*(F.col(c).alias(f"b_{c}") for c in [*group, "quillveil_part"]), "base")
        inside = F.row_number().over(Window.partitionBy(*group, "quillveil_part").orderBy("quillveil_row"))
        met = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in [*group, "quillveil_part"]]
        part = part.withColumn("nth", inside).join(bases, met[0] & met[1] & met[2] & met[3])
        out = out.unionByName(copied(part, F.col("mix_copies") + (F.col("base") + F.col("nth") <= F.col("mix_rest")).cast("int")))
    return out


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([{', '.join(map(str, WEIGHTS))}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)] AS weight, source_size * {EPOCHS} AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level FROM w
      WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM l),
c AS (SELECT d.*, e.epoch, md5('{SEED}|' || e.epoch || '|' || coalesce(doc_id::VARCHAR, '')) AS place FROM d, (SELECT unnest(range(0, {EPOCHS})) AS epoch) e),
k AS (SELECT c.*, t.source_size, t.target, CASE WHEN t.target > 0 THEN floor(sum(c.size) OVER (PARTITION BY c.source ORDER BY c.epoch, c.place, c.doc_id, c.size, c.row ROWS UNBOUNDED PRECEDING)::DOUBLE
             / t.target * {UNIT})::BIGINT ELSE {(1 << 62) - 1} END AS key FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, sum(size) OVER (ORDER BY key, source NULLS LAST, epoch, doc_id, size, row ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size) * {SHARE}::DOUBLE FROM d) AS taken FROM k)
SELECT doc_id, size, source_size, target, sum(CASE WHEN taken THEN size ELSE 0 END)::BIGINT AS taken FROM q GROUP BY row, doc_id, source, size, source_size, target
"""
