"""Connected components by contraction, on tables alone.

Each round every node looks at its neighbours and itself and takes the one of
least priority, a hash that changes with the round, as its parent; edges move
to the parents, loops and repeats go. A constant share of the nodes vanishes
in a round, whatever the shape, so there are few rounds; the maps of the
rounds, joined from the last to the first, give each node its root. Each
round's tables are written to the shared folder. The driver sees one count a
round. Minima and distinct rows are reduced before the shuffle, so a hub costs
no more than its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a table of a round in one file, about.
FILE_ROWS = 250_000


def roots(edges: DataFrame) -> DataFrame:
    """node, root: one root for each component of the edges (a, b: long); nodes without an edge are absent.

    Loops and repeated edges don't matter; edges with a null end are left out.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).filter("a < b").distinct(), "edges")
    maps = []
    while n := now.count():
        files = -(-n // FILE_ROWS)  # what a round writes has 2 n rows at most
        rank = lambda c, salt=len(maps): F.xxhash64(F.lit(salt), c)
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", rank(F.col("b"))).alias("near"))
        parent = F.when(rank(F.col("near")) < rank(F.col("node")), F.col("near")).otherwise(F.col("node"))
        step = written(least.select("node", parent.alias("root")).coalesce(2 * files), "parents")
        maps.append(step)
        a, b = step.toDF("a", "x"), step.toDF("b", "y")
        now = now.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()
        now = written(now.coalesce(files), "edges")
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    out = maps[-1]
    for step in reversed(maps[:-1]):
        up = out.toDF("root", "top")
        out = step.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out
