"""Packing with a carry that is reset: each pack begins where the one before it ended, which depends on all before.

A sequence lies in blocks of bounded length. Within a block packs are walked off from a given entry; in the first block
that is its first item. For longer sequences every item gets a link to where the next pack would begin if one began
there: the first item whose running total reaches the need, found in cells of the total's range, never by going through
the sequence. Links are doubled inside each block until they leave it, and then from block to block, so after as many
rounds as the number of blocks has binary digits the entries of all blocks are known. No task holds a whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import materialised

#: Items of a sequence that are walked in one task.
BLOCK = 4096


def pack(items: DataFrame, key: str, order: str, size: Column | None, need: float, total: str | None = None, block: int = BLOCK) -> DataFrame:
    """``items`` with ``pack``, counted from 0 in each sequence: a pack ends with the item that brings it to ``need``.

    Sizes must not be negative; or ``total`` names a column of running totals, of which the largest so far counts and nulls
    count as no change. Items of a sequence need distinct values of ``order``.
    """
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    reached = F.sum(F.coalesce(size, F.lit(0)).cast("double")).over(so_far) if total is None else F.coalesce(F.max(F.greatest(F.col(total).cast("double"), F.lit(0.0))).over(so_far), F.lit(0.0))
    placed = items.withColumn("__i", F.row_number().over(w) - 1).withColumn("__at", reached)
    placed = materialised(placed.withColumn("__before", F.lag("__at", 1, 0.0).over(w)).withColumn("__block", F.floor(F.col("__i") / block).cast("int")))
    thin = placed.select(F.col(key).alias("k"), F.col("__i").alias("i"), F.col("__before").alias("before"), F.col("__at").alias("at"), F.col("__block").alias("b"))
    walked = thin.groupBy("k", "b").agg(F.sort_array(F.collect_list(F.struct("i", "before", "at"))).alias("x"))
    if thin.where("b > 0").limit(1).count():
        walked = _same(walked, _entries(thin, need, block), ["k", "b"], "left")
    else:
        walked = walked.withColumn("entry", F.lit(None).cast("int"))
    entry = F.coalesce("entry", F.when(F.col("b") == 0, 0))
    zero = F.struct(F.lit(True).alias("open"), F.lit(0.0).alias("base"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        begins = (x["i"] == entry) | ((x["i"] > entry) & a["open"])
        base = F.when(begins, x["before"]).otherwise(a["base"])
        return F.struct(((x["i"] >= entry) & (x["at"] - base >= need)).alias("open"), base.alias("base"), F.when(begins, F.concat(a["starts"], F.array(x["i"]))).otherwise(a["starts"]).alias("starts"))

    starts = walked.where(entry.isNotNull()).select("k", F.explode(F.aggregate("x", zero, step, lambda a: a["starts"])).alias("i"))
    starts = starts.select(F.col("k").alias("__k"), F.col("i").alias("__s"))
    found = placed.join(starts, placed[key].eqNullSafe(starts["__k"]) & (F.col("__i") == F.col("__s")), "left")
    numbered = found.withColumn("pack", (F.count("__s").over(Window.partitionBy(key).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return numbered.select(*items.columns, "pack")


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which null is one."""
    named = b.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in b.columns])
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return a.join(named, on, how).drop(*[f"__{c}" for c in keys])  # a semi join has none of them


def _links(items: DataFrame, need: float) -> DataFrame:
    """k, b, i, next: where the next pack begins if one begins at i; the number of items if there is none."""
    cell = lambda x: F.floor(x / need).cast("long")
    points = items.select("k", cell(F.col("at")).alias("c"), F.col("at").alias("v"), F.lit(1).alias("point"), "i", "b")
    sought = F.col("before") + need
    asked = items.select("k", cell(sought).alias("c"), sought.alias("v"), F.lit(0).alias("point"), "i", "b")
    down = Window.partitionBy("k", "c").orderBy(F.desc("v"), F.desc("point"), F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    met = points.union(asked).withColumn("end", F.last(F.when(F.col("point") == 1, F.col("i")), ignorenulls=True).over(down))
    # a place that lies behind all items of its cell: the first item of the next cell that has any
    cells = met.groupBy("k", "c").agg(F.min(F.when(F.col("point") == 1, F.col("i"))).alias("first"))
    later = Window.partitionBy("k").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("behind", F.last("first", ignorenulls=True).over(later)).select("k", "c", "behind")
    n = items.groupBy("k").agg((F.max("i") + 1).alias("n"))
    asked = _same(_same(met.where("point = 0"), cells, ["k", "c"]), n, ["k"])
    return asked.select("k", "b", "i", F.coalesce(F.coalesce("end", "behind") + 1, "n").alias("next"))


def _entries(thin: DataFrame, need: float, block: int) -> DataFrame:
    """k, b, entry for sequences of several blocks: the first item of each block at which a pack begins, null if none does."""
    long = thin.where("b > 0").select("k").distinct()
    links = _links(_same(thin, long, ["k"], "left_semi"), need)
    lists = links.groupBy("k", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "next"))), lambda x: x["next"]).alias("x"))
    base = F.col("b") * block
    for _ in range(block.bit_length()):
        lists = lists.withColumn("x", F.transform("x", lambda t: F.when(t < base + block, F.coalesce(F.get("x", (t - base).cast("int")), t)).otherwise(t)))
    leave = lists.select("k", F.posexplode("x").alias("p", "next"), base.alias("base")).select("k", (F.col("base") + F.col("p")).alias("i"), "next")
    leave = materialised(leave)
    # only items at which some pack leaves a block, and the first ones, can be entries
    able = leave.select("k", F.col("next").alias("i")).union(leave.select("k", F.lit(0).alias("i"))).distinct()
    jump = materialised(_same(leave, able, ["k", "i"]))
    known = materialised(long.select("k", F.lit(0).alias("i")))
    while True:
        more = _same(known, jump, ["k", "i"]).select("k", F.col("next").alias("i"))
        grown = materialised(known.union(more).distinct())
        if grown.count() == known.count():
            break
        known = grown
        on = jump.select("k", F.col("i").alias("next"), F.col("next").alias("far"))
        jump = materialised(_same(jump, on, ["k", "next"], "left").select("k", "i", F.coalesce("far", "next").alias("next")))
    return known.groupBy("k", F.floor(F.col("i") / block).cast("int").alias("b")).agg(F.min("i").alias("entry"))
