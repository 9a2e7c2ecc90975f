"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

A source's documents are shuffled by a hash of doc_id.  Each copy of a document gets a virtual
finish time, the cumulative words of its source divided by the source's target; all copies are
range-sorted by that time and the sequence is cut where the total budget is spent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canticle.llm.storage import Scratch

#: A word is a maximal run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Slots of a source's shuffled order; each is summed on its own, so no source is one task's work.
SLOT_DIGITS = 3
#: Copies of documents in a range of the global order.
RANGE_ROWS = 1 << 17


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the shuffle key of each row; other columns are ignored."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target of each source (one row a source).

    target = min(most * source_size, level * weight), where the level spends share * all words.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNotNull().desc(), "source")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights)))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    left_words = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("at", F.row_number().over(fill)).withColumn("level", left_words / left_weight)
    full = F.col("level") * F.col("weight") >= F.col("cap")
    level = F.min_by(F.when(~full, F.col("level")), F.when(~full, F.col("at"))).over(every)
    return per.select("source", "source_size", "budget", F.when(full, F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def parts_of(copies: int) -> int:
    """Ranges of the global order: the one where the budget ends is summed row by row, so none may grow."""
    return max(1, math.ceil(copies / RANGE_ROWS))


def _finish(epoch: int) -> Column:
    return F.when(F.col("target") > 0, (F.lit(epoch) * F.col("source_size") + F.col("cum")) / F.col("target")).otherwise(F.lit(0.0))


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source of each row of docs.

    docs: doc_id, source, text.  The mix takes whole documents, at most ceil(most) times each.
    Ties in the shuffled order go by doc_id and size, so reruns agree.  A null text has size 0; a
    null source is a source of its own, the last; a null doc_id is shuffled as an empty text.
    Repeated rows are mixed one by one.  Documents without words cost nothing and come along where
    their place in the order is reached.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "mixing")
    sizes = scratch.table(sized(docs), "sizes")
    targets = scratch.table(source_targets(sizes, weights, share, most), "targets")
    slotted = sizes.withColumn("slot", F.substring("key", 1, SLOT_DIGITS))
    slots = slotted.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    up_to = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(F.col("source").alias("s"), F.col("slot").alias("p"), F.coalesce(F.sum("slot_size").over(up_to), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = slotted.withColumn("run", F.sum("size").over(inside))
    placed = placed.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("p")))
    placed = placed.select("doc_id", "source", "size", "key", (F.col("base") + F.col("run")).alias("cum"))
    known = targets.select(F.col("source").alias("t"), "source_size", "target")
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("t"))).drop("t")
    placed = scratch.table(placed, "placed")

    epochs = range(max(1, math.ceil(most)))
    n = placed.count() * len(epochs)
    copies = placed.select("size", "key", "doc_id", F.explode(F.array(*(F.struct(_finish(e).alias("finish"), F.lit(e).alias("epoch")) for e in epochs))).alias("c"))
    place = F.struct("c.finish", "key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "c.epoch")
    ordered = copies.select(place.alias("place"), "size").repartitionByRange(parts_of(n), "place").withColumn("part", F.spark_partition_id())
    ordered = scratch.table(ordered, "ordered")
    parts = ordered.groupBy("part").agg(F.sum("size").alias("part_size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("base"), "part_size")
    budget = (targets.agg(F.max("budget")).first()[0]) or 0.0
    # Only the range where the budget ends is summed row by row; it is one range-sorted part.
    crossing = parts.where((F.col("base") <= F.lit(budget)) & (F.col("base") + F.col("part_size") > F.lit(budget)))
    inner = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    crossed = ordered.join(F.broadcast(crossing), "part").withColumn("total", F.col("base") + F.sum("size").over(inner))
    cut = crossed.where(F.col("total") > F.lit(budget)).agg(F.min("place").alias("p")).first()["p"]

    taken = F.lit(0)
    for e in epochs:
        here = F.struct(_finish(e), F.col("key"), F.coalesce("doc_id", F.lit(-(1 << 63))), F.lit(e))
        inside_mix = F.lit(True) if cut is None else here < F.struct(F.lit(cut.finish), F.lit(cut.key), F.lit(cut.doc_id).cast("long"), F.lit(cut.epoch))
        taken = taken + F.when(inside_mix, 1).otherwise(0)
    return placed.withColumn("copies", taken).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"), "source"
    )


def row_hash(docs: DataFrame) -> Column:
    """A hash of a whole row, but for columns of maps, which have no order to hash."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))


def apply_mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs as the mix takes them: rows left out are gone, rows taken twice come twice, columns as they were.

    Of rows with one doc_id, source and size the mix takes the first by a hash of the whole row less
    often, so reruns agree on the texts too, however the rows are dealt.
    """
    decided = mix(spark, docs, weights, share, most).select("doc_id", "source", "size", "copies")
    same = Window.partitionBy("_doc", "_source", "_size").orderBy("_copies")
    decided = decided.select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    decided = decided.withColumn("_n", F.row_number().over(same)).where("_copies > 0")
    columns = docs.columns
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_from"), size.alias("_words"), row_hash(docs).alias("_hash"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_from", "_words").orderBy("_hash")))
    match = F.col("_id").eqNullSafe(F.col("_doc")) & F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")) & (F.col("_nth") == F.col("_n"))
    rows = rows.join(decided, match).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select("_row.*")
