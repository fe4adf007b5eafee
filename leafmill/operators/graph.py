"""Reachability, references, and merging of equal objects over tables of objects and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.storage import settled

#: Passes of dedupe_fixpoint() at most.
PASSES = 8


def reachable(edges: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc, id: all that roots (doc, id) lead to along edges (doc, src, dst), roots included.

    A frontier is joined with the edges, and what was seen is taken out, until nothing new comes; cycles end by that.
    Each round's frontier is written to shared storage; the driver sees whether it is empty.
    """
    seen = settled(roots.select("doc", "id").distinct())
    frontier, n = seen, 0
    while not frontier.isEmpty() and (rounds is None or n < rounds):
        step = edges.join(frontier.withColumnRenamed("id", "src"), ["doc", "src"]).select("doc", F.col("dst").alias("id")).distinct()
        frontier = settled(step.join(seen, ["doc", "id"], "left_anti"))
        seen = seen.union(frontier)
        n += 1
        if n % 8 == 0:
            seen = settled(seen)
    return seen


def dangling(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges whose end no object (doc, id) is."""
    ends = objects.select("doc", F.col("id").alias("dst"))
    return edges.join(ends, ["doc", "dst"], "left_anti").select(edges.columns)


def without_dangling(edges: DataFrame, objects: DataFrame) -> DataFrame:
    ends = objects.select("doc", F.col("id").alias("dst"))
    return edges.join(ends, ["doc", "dst"], "left_semi").select(edges.columns)


def prune(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects that roots lead to, with new: dense numbers from 1 in the old order."""
    from pyspark.sql import Window

    kept = objects.join(reachable(edges, roots), ["doc", "id"], "left_semi")
    return kept.withColumn("new", F.row_number().over(Window.partitionBy("doc").orderBy("id")))


def survivors(objects: DataFrame, key: str = "body") -> DataFrame:
    """doc, id, keep: the least id with the same body; only where that is another."""
    least = objects.groupBy("doc", key).agg(F.min("id").alias("keep"))
    return objects.join(least, ["doc", key]).filter("keep <> id").select("doc", "id", "keep")


def repoint(edges: DataFrame, remap: DataFrame, end: str = "dst") -> DataFrame:
    """edges with ends replaced by the remap (doc, id, keep)."""
    to = remap.select("doc", F.col("id").alias(end), F.col("keep").alias("__keep"))
    return edges.join(to, ["doc", end], "left").withColumn(end, F.coalesce("__keep", end)).select(edges.columns)


def dedupe_fixpoint(objects: DataFrame, edges: DataFrame, passes: int = PASSES) -> DataFrame:
    """doc, id, keep after merging equal objects until none is equal: bodies, and the ends of edges in order of slot, count.

    objects: doc, id, body; edges: doc, src, slot, dst. Every id is returned; keep is id for those that stay.
    """
    remap = objects.select("doc", "id", F.col("id").alias("keep"))
    for _ in range(passes):
        here = repoint(edges.select("doc", F.col("src"), "slot", "dst"), remap)
        ends = here.groupBy("doc", F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("slot", "dst"))).alias("ends"))
        alive = objects.join(remap.filter("id = keep").select("doc", "id"), ["doc", "id"], "left_semi").join(ends, ["doc", "id"], "left")
        body = F.sha2(F.concat_ws("|", "body", F.to_json("ends")), 256)
        step = settled(survivors(alive.select("doc", "id", F.when(F.col("body").isNotNull(), body).alias("key")), "key"))
        if step.isEmpty():
            break
        up = step.select("doc", F.col("id").alias("keep"), F.col("keep").alias("__up"))
        remap = settled(remap.join(up, ["doc", "keep"], "left").select("doc", "id", F.coalesce("__up", "keep").alias("keep")))
    return remap


def integrity(parents: DataFrame, children: DataFrame, key: str, group: str) -> DataFrame:
    """group, intact: whether the key of every row of parents is found among children."""
    known = children.select(key).distinct().withColumn("__known", F.lit(True))
    return parents.join(known, key, "left").groupBy(group).agg(F.bool_and(F.coalesce("__known", F.lit(False))).alias("intact"))
