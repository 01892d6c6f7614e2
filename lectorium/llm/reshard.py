"""Resharding by minimum-cost flow: move the fewest bytes from the old shards into evenly filled new ones.

Old shard i and new shard i are the same place, so a row that stays costs nothing and a row that moves costs its
bytes. The law is ``rows``: new shards differ by at most one row. Within an old shard the smallest rows are the
ones to move, so the cost of sending n rows away is the sum of its n smallest sizes. The flow problem has one node
per shard (a parameter, not the data) and is solved on the driver; ranks and slots come from a range-partitioned
sort, so no shard, however hot, meets in one task.

Defined results: a null text has size 16 and the checksum of the empty text; a very long text only
counts by its bytes and never moves before the rewrite; equal texts are not kept together
(copies beyond a shard's capacity could not be); ties in size go by id, then checksum. Repeated rows each get a slot of
their own. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

OVERHEAD = 16
#: Rows of a shard that one task writes, as one file.
FILE_ROWS = 100_000


@dataclass(frozen=True)
class Arc:
    """``rows`` rows from an old to a new shard."""

    old: int
    new: int
    rows: int


class FlowNetwork:
    """Successive shortest paths over a small network with integer capacities and costs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def _cheapest(self, source: int) -> tuple[list[float], list[int]]:
        far, via = [float("inf")] * len(self.out), [-1] * len(self.out)
        far[source], queue, queued = 0, deque([source]), {source}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in self.out[x]:
                y = self.to[e]
                if self.room[e] and far[x] + self.cost[e] < far[y]:
                    far[y], via[y] = far[x] + self.cost[e], e
                    if y not in queued:
                        queued.add(y)
                        queue.append(y)
        return far, via

    def solve(self, source: int, sink: int) -> int:
        total = 0
        while True:
            far, via = self._cheapest(source)
            if via[sink] < 0:
                return total
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            total += push * int(far[sink])


def plan_transfers(rows: dict[int, int], marginal: dict[int, int], n_new: int) -> list[Arc]:
    """Arcs that fill the new shards evenly and move the fewest bytes.

    rows: rows of each old shard. marginal: the bytes that are saved if an overfull old shard may keep one row
    above the even share. The even share is a node capacity; the remainder is given out, one row to a shard.
    """
    total = sum(rows.values())
    share, extra = divmod(total, n_new)
    olds = sorted(rows)
    node = {("old", s): 2 + i for i, s in enumerate(olds)} | {("new", t): 2 + len(olds) + t for t in range(n_new)}
    spare = 2 + len(olds) + n_new
    net = FlowNetwork(spare + 1)
    move = 1 + max([0, *marginal.values()])  # moving any row costs more than a marginal row saves
    arcs = {}
    for s in olds:
        net.arc(0, node["old", s], rows[s], 0)
        for t in range(n_new):
            arcs[s, t] = [net.arc(node["old", s], node["new", t], rows[s], 0 if s == t else move)]
        if s < n_new and s in marginal:
            arcs[s, s].append(net.arc(node["old", s], node["new", s], 1, -marginal[s]))
    for t in range(n_new):
        net.arc(node["new", t], 1, share, 0)
        net.arc(node["new", t], spare, 1, 0)
    net.arc(spare, 1, extra, 0)
    net.solve(0, 1)
    flows = {st: sum(net.room[e ^ 1] for e in es) for st, es in arcs.items()}
    return [Arc(s, t, n) for (s, t), n in sorted(flows.items()) if n]


def measured(docs: DataFrame, old: Column) -> DataFrame:
    """The thin table that everything below works on: no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        old.cast("int").alias("old_shard"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def ranked(thin: DataFrame) -> DataFrame:
    """Adds ``rank``: the place (from 0) of a row in its old shard by (size, id, checksum).

    Rows are sorted by range over all partitions; a partition's rows of a shard start where the partitions before
    it end. The sorted table is written once, since partition numbers must not change between its two uses.
    """
    spark = thin.sparkSession
    order = ["old_shard", "size", "doc_id", "text_crc32"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(thin.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("old_shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    # at most partitions + shards rows
    before = counts.select(
        "old_shard", "__part",
        F.coalesce(F.sum("__n").over(Window.partitionBy("old_shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    place = F.row_number().over(Window.partitionBy("__part", "old_shard").orderBy(*order[1:])) - 1
    here = dealt.withColumn("__place", place)
    return here.join(F.broadcast(before), ["old_shard", "__part"]).select(
        "doc_id", "old_shard", "size", "text_crc32", (F.col("__place") + F.col("__before")).cast("long").alias("rank")
    )


def reshard(docs: DataFrame, old: Column, n_new: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot for every row; ``old`` gives a row's old shard number."""
    spark = docs.sparkSession
    rows = ranked(measured(docs, old))
    rows = cut(rows)
    supply = {r.old_shard: r.n for r in rows.groupBy("old_shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per old shard
    share = sum(supply.values()) // n_new
    over = {s: n - share - 1 for s, n in supply.items() if n > share and s < n_new}  # rank of the row that one more place would keep
    wanted = spark.createDataFrame([(s, r) for s, r in over.items()] or [(-1, -1)], "old_shard int, rank long")
    marginal = {r.old_shard: r.size for r in rows.join(F.broadcast(wanted), ["old_shard", "rank"]).collect()}
    arcs = plan_transfers(supply, marginal, n_new)

    # pieces of old shards by rank: what moves comes first (the smallest rows), what stays comes last
    pieces, filled = [], {}
    for s in sorted(supply):
        own = sorted((a for a in arcs if a.old == s), key=lambda a: (a.new == s, a.new))
        at = 0
        for a in own:
            pieces.append((s, at, at + a.rows, a.new))
            at += a.rows
    placed = []
    for s, lo, hi, t in sorted(pieces, key=lambda p: (p[3], p[0] != p[3], p[0])):  # rows that stay keep the first slots
        placed.append((s, lo, hi, t, filled.get(t, 0)))
        filled[t] = filled.get(t, 0) + hi - lo
    plan = spark.createDataFrame(placed or [(-1, 0, 0, 0, 0)], "p_old int, lo long, hi long, shard int, first_slot long")
    plan = F.broadcast(plan)  # old shards + new shards rows at most
    inside = (F.col("old_shard") == F.col("p_old")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return rows.join(plan, inside).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot")
    )


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str, file_rows: int = FILE_ROWS) -> list[int]:
    """Write, under ``path``, the files of those new shards that gain or lose a row; gives their numbers.

    ``docs`` must have unique ids. Shards that keep exactly their rows are left alone. A shard is written in runs of
    ``file_rows`` slots, each of which is dealt on its own, so a large shard is not one task's work.
    """
    moved = placed.where("shard <> old_shard")
    touched = moved.select(F.col("shard").alias("s")).union(moved.select(F.col("old_shard").alias("s"))).distinct()
    numbers = sorted(r.s for r in touched.collect())  # at most as many as shards
    wanted = placed.where(F.col("shard").isin(numbers)).select("doc_id", "shard", "slot")
    run = F.floor(F.col("slot") / file_rows)
    out = docs.join(wanted, "doc_id").repartition("shard", run).sortWithinPartitions("shard", "slot")
    out.write.option("maxRecordsPerFile", file_rows).mode("overwrite").partitionBy("shard").parquet(path)
    return numbers


def reshard_query(docs: DataFrame, n_new: int = 40) -> DataFrame:
    """The documents lie in one old shard for each hash of their source, of very unequal size."""
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(n_new))
    return reshard(docs, old, n_new).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )
