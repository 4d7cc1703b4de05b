"""Operator 13: resharding by minimum-cost flow.

Old shards are sources of bytes, new shards take bytes up to their capacity; a
byte costs nothing where it lies and one unit where it moves (or what the
caller's costs say). The flow of least cost says how many bytes each old shard
keeps and which blocks go where: a block is a range of the old shard's line of
rows. Distributed prefix sums place every row on that line, so that a row finds
its block, and its slot in the new shard, by arithmetic. Only the sizes of
shards and the blocks, at most one for each pair of an old and a new shard,
pass through the driver. :func:`rewrite` then writes the affected files anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import KEY, Table, keyed, prefix_sums

#: Parameters of the query: shards that the documents' ids put them in before, and shards after.
OLD, NEW = 12, 16


def unit_cost(old: int, new: int) -> int:
    """A byte that changes its shard is moved."""
    return int(old != new)


def least_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Callable[[int, int], int] = unit_cost) -> dict[tuple[int, int], int]:
    """Bytes for each pair (old, new) that ship all ``supply`` within ``capacity`` at the least cost.

    Successive shortest paths: each round sends as much as possible along the
    cheapest path from an old shard with bytes left to a new one with room;
    paths may take earlier blocks back. Of equal paths the shorter goes first,
    then the smaller numbers, so that the result is one of its kind.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards don't hold what the old ones have")
    left, room, flow = list(supply), list(capacity), {}
    n, m = len(left), len(room)
    potential = [0] * (n + m)
    prices = [[cost(i, j) for j in range(m)] for i in range(n)]
    for j in range(m):
        potential[n + j] = min((prices[i][j] for i in range(n)), default=0)
    while any(left):
        best: dict[int, tuple] = {}
        queue = [(0, 0, i, -1) for i in range(n) if left[i]]
        heapq.heapify(queue)
        while queue:
            at, hops, node, via = heapq.heappop(queue)
            if node in best:
                continue
            best[node] = (at, hops, via)
            if node < n:
                steps = [(n + j, prices[node][j]) for j in range(m)]
            else:
                steps = [(i, -prices[i][node - n]) for i in range(n) if flow.get((i, node - n))]
            for to, price in steps:
                if to not in best:
                    heapq.heappush(queue, (at + price + potential[node] - potential[to], hops + 1, to, node))
        goals = [(best[n + j][0] + potential[n + j], best[n + j][1], j) for j in range(m) if room[j] and n + j in best]
        end = min(goals)[2]
        path, node = [], n + end
        while node != -1:
            path.append(node)
            node = best[node][2]
        path.reverse()
        taken = [flow[b, a - n] for a, b in zip(path[1::2], path[2::2], strict=False)]
        amount = min(left[path[0]], room[end], *taken)
        for a, b in zip(path[::2], path[1::2], strict=True):
            flow[a, b - n] = flow.get((a, b - n), 0) + amount
        for a, b in zip(path[1::2], path[2::2], strict=False):
            flow[b, a - n] -= amount
        left[path[0]] -= amount
        room[end] -= amount
        far = max(b[0] for b in best.values())
        for node in range(n + m):
            potential[node] += best[node][0] if node in best else far
    return {pair: amount for pair, amount in sorted(flow.items()) if amount}


def equal_capacities(total: int, shards: int) -> list[int]:
    """``total`` bytes in ``shards`` parts that differ by at most one."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def blocks(sizes: Sequence[int], capacities: Sequence[int], cost: Callable[[int, int], int] = unit_cost) -> list[tuple[int, int, int, int]]:
    """(old, new, low, high): the ranges of each old shard's line, what stays first, then by new shard."""
    out, at = [], [0] * len(sizes)
    for (old, new), amount in sorted(least_cost_flow(sizes, capacities, cost).items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        out.append((old, new, at[old], at[old] + amount))
        at[old] += amount
    return out


def reshard(docs: DataFrame, old: Column, capacities: int | Sequence[int] = NEW, cost: Callable[[int, int], int] = unit_cost) -> DataFrame:
    """Rows (_file, _row: the key of :func:`keyed`, doc_id, size, text_crc32, old_shard, shard, slot) for each row of ``docs`` (doc_id, text).

    ``old`` is the present shard, 0 or more (null: 0); ``capacities`` are the new shards'
    bytes, or their number, for equal ones. Size is the text's UTF-8 bytes and
    one more; a null or empty text has size 1. An old shard's largest rows come
    first, ties by doc_id and stored row, so that blocks end among small rows:
    a row goes where its middle byte lies, and a shard's size misses its
    capacity by at most half a row for each block's end. Slots count each new
    shard's rows from 0: by old shard, then along its line. Equal texts may part; repeated
    rows are placed one by one. An empty table gives no rows.
    """
    rows = docs if set(KEY) <= set(docs.columns) else keyed(docs)
    text = F.coalesce("text", F.lit(""))
    light = rows.select(*KEY, "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(old.cast("int"), F.lit(0)).alias("old_shard"), F.lit(1).cast("long").alias("_one"))
    light = light.withColumn("_down", -F.col("size"))
    placed = Table(prefix_sums(light, ["old_shard"], ["_down", "doc_id", *KEY], "size", "_at", _one="_index"), "lines")
    held = dict(placed.read().groupBy("old_shard").agg(F.sum("size")).collect())  # one number for each old shard
    sizes = [held.get(i, 0) for i in range(max(held, default=-1) + 1)]
    if isinstance(capacities, int):
        capacities = equal_capacities(sum(sizes), capacities)
    spans = docs.sparkSession.createDataFrame(blocks(sizes, capacities, cost), "_old int, shard int, _low long, _high long")
    middle = F.expr("_at + size div 2")
    found = placed.read().join(F.broadcast(spans), (F.col("old_shard") == F.col("_old")) & (middle >= F.col("_low")) & (middle < F.col("_high")))
    first = found.groupBy("_old", "shard").agg(F.min("_index").alias("_first"), F.count("*").alias("_n"))  # a row for each block
    first = first.withColumn("_base", F.expr("coalesce(sum(_n) over (partition by shard order by _old rows between unbounded preceding and 1 preceding), 0)")).drop("_n")
    out = found.join(F.broadcast(first.withColumnRenamed("_old", "_from").withColumnRenamed("shard", "_to")), (F.col("_old") == F.col("_from")) & (F.col("shard") == F.col("_to")))
    return out.select(*KEY, "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("_index") - F.col("_first") + F.col("_base")).cast("long").alias("slot"))


def hashed_shard(shards: int = OLD, key: str = "doc_id") -> Column:
    """The shard that a row's id puts it in: the first 32 bits of its MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % shards).cast("int")


def rewrite(spark: SparkSession, path: str, capacities: int | Sequence[int], cost: Callable[[int, int], int] = unit_cost) -> list[int]:
    """Reshards documents stored under ``path`` in folders shard=N, and writes those folders anew whose rows change; returns their numbers.

    A shard that keeps all its rows and takes none is not touched. What the
    others will hold is written to the shared folder first, and only then put
    in their place, so a lost executor re-reads files that nothing has replaced.
    A folder that loses all its rows becomes empty.
    """
    docs = spark.read.parquet(path)
    plan = Table(reshard(docs, F.col("shard"), capacities, cost), "plan")
    moved = plan.read().where("old_shard <> shard").select("old_shard", F.col("shard").alias("new_shard")).distinct().collect()  # at most one row for each block
    affected = sorted({s for pair in moved for s in pair})
    if not affected:
        return []
    rows = keyed(docs)
    targets = plan.read().where(F.col("shard").isin(affected)).select(*[F.col(k).alias(f"_p{k}") for k in KEY], F.col("shard").alias("_to"))
    new = rows.where(F.col("shard").isin(affected)).join(targets, (rows[KEY[0]] == targets[f"_p{KEY[0]}"]) & (rows[KEY[1]] == targets[f"_p{KEY[1]}"]))
    staged = Table(new.select(*[c for c in docs.columns if c != "shard"], F.col("_to").alias("shard")), "staged")
    staged.read().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    filled = {s for (s,) in staged.read().select("shard").distinct().collect()}
    for shard in set(affected) - filled:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    staged.drop()
    plan.drop()
    return affected
