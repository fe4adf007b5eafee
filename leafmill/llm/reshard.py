"""Resharding by minimum-cost flow.

Old shards hold bytes; new shards have capacities (all bytes, shared equally).
A flow from old to new shards at the least cost says how many bytes of each
old shard go where; a byte that stays where it is costs nothing, so the fewest
bytes move. Each old shard is a line of blocks; the flow cuts the line into
intervals, whole blocks and the rows of a block that a cut crosses go by the
middle of their bytes. Then rows are moved again to even out what the cuts'
roundings left over: of each shard and size class (powers of two) up to SPARE
rows may move, the largest first, so that what is left is about the size of
the smallest rows, whatever the sizes at the cuts. rewrite() writes the shards
that changed.

Rows go to blocks by a hash. Rows that are alike in all columns are counted
first and dealt CHUNK copies at a time, so that no block holds a hot group.
The driver sees one number for each old shard and at most SPARE rows for each
shard and size class; block sizes and offsets are tables. All steps are
DataFrame operations.

A row's size is its text's UTF-8 bytes (null: none) plus 8. Rows with a null
doc_id and repeated rows are placed like any other, one slot each; a null
source is an old shard's key like any other. Extra columns are only hashed,
to tell rows apart. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows in a block, about; copies of a row dealt at once; rows of a shard and size class that may be moved to even out the roundings.
BLOCK_ROWS, CHUNK, SPARE = 50_000, 1_000, 32


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow from each source i to each sink j that ships all supply at the least sum of cost(i, j) * flow.

    Successive shortest paths with potentials over the bipartite graph; sum(supply) must not exceed sum(capacity).
    """
    if sum(supply) > sum(capacity):
        raise ValueError("more bytes than capacity")
    n, m = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    price = [0] * (n + m)
    while any(left):
        dist: list[float] = [float("inf")] * (n + m)
        back = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heapq.heappush(heap, (0, i))
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < n:
                steps = [(n + j, cost(u, j)) for j in range(m)]
            else:
                steps = [(i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n), 0)]
            for v, c in steps:
                if (e := d + c + price[u] - price[v]) < dist[v]:
                    dist[v], back[v] = e, u
                    heapq.heappush(heap, (e, v))
        end = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j] + price[n + j])
        price = [p + (d if d < float("inf") else 0) for p, d in zip(price, dist, strict=True)]
        path = [n + end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end], *(flow[b, a - n] for a, b in zip(path, path[1:], strict=False) if a >= n))
        for a, b in zip(path, path[1:], strict=False):
            key, sign = ((a, b - n), 1) if a < n else ((b, a - n), -1)
            flow[key] = flow.get(key, 0) + sign * amount
        left[path[0]] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def capacities(total: int, shards: int) -> list[int]:
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def cuts(flow: dict[tuple[int, int], int]) -> dict[int, list[tuple[int, int]]]:
    """For each old shard the ends of its intervals and the new shards they go to, what stays first."""
    out: dict[int, list[tuple[int, int]]] = {}
    for i in sorted({i for i, _ in flow}):
        at = 0
        for j in sorted((j for k, j in flow if k == i), key=lambda j: (j != i, j)):
            at += flow[i, j]
            out.setdefault(i, []).append((at, j))
    return out


def _target(old: Column, middle: Column, plan: dict[int, list[tuple[int, int]]]) -> Column:
    out = F.lit(None).cast("int")
    for i, ends in plan.items():
        inner = F.lit(ends[-1][1])
        for end, j in reversed(ends[:-1]):
            inner = F.when(middle < 2 * end, j).otherwise(inner)
        out = F.when(old == i, inner).otherwise(out)
    return out


def settle(totals: list[int], goal: list[int], spare: list[tuple[tuple, int, int]]) -> dict[tuple, int]:
    """Moves of spare rows (key, shard, size), the largest first, that bring totals nearer to goal."""
    over = [t - g for t, g in zip(totals, goal, strict=True)]
    moves: dict[tuple, int] = {}
    for key, shard, size in sorted(spare, key=lambda x: (-x[2], x[0])):
        to = min(range(len(over)), key=lambda j: (over[j], j))
        before, after = over[shard] ** 2 + over[to] ** 2, (over[shard] - size) ** 2 + (over[to] + size) ** 2
        if to != shard and after < before:
            over[shard] -= size
            over[to] += size
            moves[key] = to
    return moves


def reshard(df: DataFrame, old: Column, old_shards: int, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_hash (of all columns), old_shard, shard and slot of every row of df; old is the old shard's number, below old_shards."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(*df.columns).alias("row_hash"), old.cast("int").alias("old_shard"))
    alike = written(rows.groupBy("doc_id", "size", "text_crc32", "row_hash", "old_shard").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    blocks = max(8, -(-(alike.agg(F.sum("copies").alias("n")).first().n or 0) // BLOCK_ROWS))
    chunks = alike.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK).cast("int"))))
    chunks = chunks.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "row_hash", "chunk"), F.lit(blocks)).cast("int"))
    rows = chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("chunk") * CHUNK + CHUNK, F.col("copies").cast("int")) - 1))).drop("chunk", "copies")
    sums = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"))
    held = {r.old_shard: r.bytes for r in sums.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}
    goal = capacities(sum(held.values()), shards)
    plan = cuts(min_cost_flow([held.get(i, 0) for i in range(old_shards)], goal, lambda i, j: int(i != j)))
    line = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("old_shard", "block", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size", "row_hash", "copy")
    placed = (
        rows.withColumn("nth", F.row_number().over(inside))
        .withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) * 2 - F.col("size"))
        .join(offsets, ["old_shard", "block"])
        .withColumn("shard", _target(F.col("old_shard"), F.col("offset") * 2 + F.col("before"), plan))
        .select("doc_id", "size", "text_crc32", "row_hash", "old_shard", "block", "nth", "shard")
    )
    placed = written(placed, "placed")
    totals = {r.shard: r.bytes for r in placed.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    # of each shard and size class the first rows; Spark keeps no more of them before the shuffle
    of_class = Window.partitionBy("shard", "class").orderBy("old_shard", "block", "nth")
    classes = placed.select("old_shard", "block", "nth", "shard", "size", F.floor(F.log2("size")).cast("int").alias("class"))
    spare = classes.withColumn("k", F.row_number().over(of_class)).filter(F.col("k") <= SPARE).collect()
    moves = settle([totals.get(j, 0) for j in range(shards)], goal, [((r.old_shard, r.block, r.nth), r.shard, r.size) for r in spare])
    # no more rows than spare has
    again = placed.sparkSession.createDataFrame([(*k, j) for k, j in moves.items()], "old_shard int, block int, nth int, moved int")
    final = placed.join(F.broadcast(again), ["old_shard", "block", "nth"], "left").withColumn("shard", F.coalesce("moved", "shard")).drop("moved")
    of_block = Window.partitionBy("shard", "old_shard", "block").orderBy("nth")
    counts = final.groupBy("shard", "old_shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    in_shard = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "old_shard", "block", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("first"))
    return final.withColumn("within", F.row_number().over(of_block)).join(first, ["shard", "old_shard", "block"]).select(
        "doc_id", "size", "text_crc32", "row_hash", "old_shard", "shard", (F.col("first") + F.col("within") - 1).cast("long").alias("slot")
    )


def affected(placed: DataFrame) -> DataFrame:
    """The shards that gain or lose rows, with the bytes they gain and lose."""
    moved = placed.filter("old_shard <> shard")
    gain = moved.groupBy("shard").agg(F.sum("size").alias("gained"))
    lose = moved.groupBy(F.col("old_shard").alias("shard")).agg(F.sum("size").alias("lost"))
    return gain.join(lose, "shard", "full").fillna(0, ["gained", "lost"])


def rewrite(df: DataFrame, placed: DataFrame, path: str) -> None:
    """Writes the rows of df that belong to affected shards below path, a folder for each shard; placed: what reshard() gave for df."""
    shards = affected(placed).select("shard")
    rows = placed.join(F.broadcast(shards), "shard").select(F.col("row_hash").alias("__hash"), "shard", "slot")
    # rows that are alike are one, which then goes to the place of each copy
    own = df.withColumn("__hash", F.xxhash64(*df.columns)).drop("shard", "slot").dropDuplicates(["__hash"])
    out = own.join(rows, "__hash").drop("__hash")
    out.repartition("shard", F.floor(F.col("slot") / BLOCK_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
