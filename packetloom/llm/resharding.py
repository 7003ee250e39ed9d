"""Resharding by minimum-cost flow: which bytes of which old shard go to which new shard so that the fewest bytes move."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import stage

#: Bytes of a block of an old shard, on average; blocks are ordered and cut independently of each other.
BLOCK = 4 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow of every old shard (row) into every new one that moves all supply within the capacities at least cost.

    Successive shortest augmenting paths on the bipartite network; its size is the number of shards, never that of the data.
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        dist: list[float] = [0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        back = [-1] * (n + m)
        queue = deque(i for i in range(n) if left[i])
        while queue:
            u = queue.popleft()
            if u < n:
                edges = [(n + j, cost[u][j]) for j in range(m)]
            else:
                edges = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in edges:
                if dist[u] + c < dist[v]:
                    dist[v], back[v] = dist[u] + c, u
                    queue.append(v)
        sink = min((n + j for j in range(m) if room[j]), key=lambda v: dist[v], default=None)
        if sink is None or dist[sink] == float("inf"):
            raise ValueError("the new shards cannot hold what the old ones have")
        path = [sink]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        push = min(left[path[0]], room[sink - n], *(flow[v][u - n] for u, v in zip(path, path[1:]) if u >= n))
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u][v - n] += push
            else:
                flow[v][u - n] -= push
        left[path[0]] -= push
        room[sink - n] -= push
    return flow


def shares(total: int, weights: list[float]) -> list[int]:
    """Whole capacities in proportion to the weights that add up to the total."""
    whole, ends = sum(weights), [0]
    for k in range(1, len(weights) + 1):
        ends.append(round(total * (sum(weights[:k]) / whole)))
    return [b - a for a, b in zip(ends, ends[1:])]


def reshard(rows: DataFrame, old: Column, size: Column, order: list[str], weights: list[float], block_bytes: int = BLOCK) -> DataFrame:
    """Every row with its old shard `old`, its `size`, its new `shard` and its `slot` there (gapless from 0).

    old is the number of the shard a row is in, order its columns that fix its place in there. Old shards are dealt into blocks by
    hash; block sums give each block's place, and running sums inside a block each row's place, so a shard that holds most rows is
    spread over many tasks. The flow cuts the bytes of each old shard into runs, one per new shard, and a row goes where the middle
    of its bytes lies, so each cut is met to within one row. A second flow evens out what the cuts left over or short with the
    smallest rows at the end of a block. Repeated rows are placed like any others and may stand in any order. Rows whose old shard
    is null count as shard 0. Columns named like the added ones are replaced. An empty table gives an empty result.
    """
    names = [c for c in rows.columns if c not in ("old", "size", "block", "shard", "slot", "first", "_less")]
    sized = stage(rows.select(*names, F.coalesce(old.cast("int"), F.lit(0)).alias("first"), size.cast("bigint").alias("size")).withColumn("_less", -F.col("size")))
    total = sized.agg(F.sum("size")).first()[0] or 0
    capacity = shares(total, weights)
    cut = _flow(sized.withColumn("old", F.col("first")), order, capacity, block_bytes)
    evened = _flow(cut.withColumn("old", F.col("shard")).drop("shard"), ["_less", *order], capacity, block_bytes)
    return _slots(evened, order).select(*names, F.col("first").alias("old"), "size", "shard", "slot")


def _flow(sized: DataFrame, order: list[str], capacity: list[int], block_bytes: int) -> DataFrame:
    """The rows with `shard` and `block` after one minimum-cost flow from their shards `old` into the capacities."""
    held = {r.old: r.n for r in sized.groupBy("old").agg(F.sum("size").alias("n")).collect()}
    supply = [held.get(i, 0) for i in range(max(held, default=-1) + 1)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(len(capacity))] for i in range(len(supply))])
    runs = []
    for i, out in enumerate(flow):
        at, mine = 0, []
        for j in sorted(range(len(out)), key=lambda j: (j != i, j)):
            if out[j]:
                at += out[j]
                mine.append((at, j))
        runs.append((i, mine or [(0, i if i < len(capacity) else 0)]))
    cuts = sized.sparkSession.createDataFrame(runs or [(0, [(0, 0)])], "old int, runs array<struct<upto: bigint, shard: int>>")
    n_blocks = max(1, -(-max(supply, default=0) // block_bytes))
    names = [c for c in sized.columns if c not in ("old", "block")]
    blocked = sized.select(*names, "old").withColumn("block", F.pmod(F.xxhash64(*order), F.lit(n_blocks)))
    sums = blocked.groupBy("old", "block").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("old", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("old", "block").orderBy(*order, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["old", "block"]).join(cuts, "old")
    placed = placed.withColumn("middle", F.col("ahead") + F.col("inside") + F.floor(F.col("size") / 2))
    into = F.expr("coalesce(get(filter(runs, r -> middle < r.upto), 0).shard, element_at(runs, -1).shard)")
    return stage(placed.select(*names, "old", "block", into.alias("shard")))


def _slots(placed: DataFrame, order: list[str]) -> DataFrame:
    """Gapless slots per shard: ranks inside the blocks of a shard, after the counts of the blocks ahead."""
    by = ["shard", "old", "block"]
    counts = placed.groupBy(*by).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order, "size"))
    return placed.withColumn("rank", rank).join(counts, by).withColumn("slot", F.col("ahead") + F.col("rank") - 1)


def rewrite_affected(resharded: DataFrame, path: str) -> list[int]:
    """Writes anew the files of the shards that gain or lose rows, under path/shard=N in slot order; the others are left alone.

    Returns their numbers, at most as many as there are shards.
    """
    change = resharded.where("old <> shard").select(F.explode(F.array("old", "shard")).alias("shard")).distinct()
    affected = sorted(r.shard for r in change.collect())
    rows = resharded.where(F.col("shard").isin(affected)) if affected else resharded.limit(0)
    spread = rows.withColumn("_part", F.floor(F.col("slot") / 1_000_000)).repartition("shard", "_part").sortWithinPartitions("shard", "slot").drop("_part")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return affected
