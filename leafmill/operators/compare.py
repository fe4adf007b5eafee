"""Before and after: regressions, pages, scores, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.color import block_similarity


def regressions(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """key, was, now: where now counts more than before; what before lacks was 0."""
    a = now.groupBy(key).agg(F.count(F.lit(1)).alias("now"))
    b = before.groupBy(key).agg(F.count(F.lit(1)).alias("was"))
    return a.join(b, key, "left").withColumn("was", F.coalesce("was", F.lit(0))).filter("now > was").select(key, "was", "now")


def pages(a: DataFrame, b: DataFrame, key: str, score: Column) -> DataFrame:
    """key, score: every page of either side; a page that one side lacks scores 0."""
    left, right = a.select(key, F.struct("*").alias("a")), b.select(key, F.struct("*").alias("b"))
    return left.join(right, key, "full").select(key, F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(score).alias("score"))


def least_score(score: str = "score") -> Column:
    """Aggregate: the least score, 1 without any; a score that isn't a number counts for nothing."""
    return F.coalesce(F.min(F.when(~F.isnan(score), F.col(score))), F.lit(1.0))


def similarity(a: DataFrame, b: DataFrame, keys: list[str], x: str = "x", y: str = "y", value: str = "v", block: int = 8) -> DataFrame:
    """keys, score: the mean over blocks of pixels of two images' structural similarity; pixels must match one to one."""
    both = a.join(b.withColumnRenamed(value, "__b"), [*keys, x, y])
    p, q = F.col(value).cast("double"), F.col("__b").cast("double")
    cells = both.groupBy(*keys, F.floor(F.col(x) / block).alias("bx"), F.floor(F.col(y) / block).alias("by"))
    sums = cells.agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(n) for n, v in (("a", p), ("b", q), ("aa", p * p), ("bb", q * q), ("ab", p * q))))
    return sums.groupBy(*keys).agg(F.avg(block_similarity(*map(F.col, ("n", "a", "b", "aa", "bb", "ab")))).alias("score"))


def score_totals(rows: DataFrame, references: list[str]) -> DataFrame:
    """One row of totals: of input, of ours where there is any, the least similarity; for each reference its total, ours on the same files, and how many it has."""
    out = [F.sum("input").alias("input"), F.sum("ours").alias("ours"), F.sum(F.when(F.col("ours").isNotNull(), F.col("input"))).alias("input_with_ours"), F.min("ssim").alias("least_ssim"), F.count(F.lit(1)).alias("files")]
    for r in references:
        both = F.col(r).isNotNull() & F.col("ours").isNotNull()
        out += [F.sum(F.when(both, F.col(r))).alias(f"{r}_total"), F.sum(F.when(both, F.col("ours"))).alias(f"ours_on_{r}"), F.count_if(both).alias(f"{r}_files")]
    return rows.agg(*out)
