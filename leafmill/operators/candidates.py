"""Choosing among candidates under a rule that nothing grows, and the ledger of what was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smallest(df: DataFrame, keys: list[str], size: str, rank: str, carry: list[str]) -> DataFrame:
    """For each key the candidate of least size; of equal ones that of least rank; one without a size only if no other has one. One shuffle, reduced before it."""
    best = F.min(F.struct(F.col(size).isNull().alias("none"), size, rank, *carry)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*").drop("none")


def never_grow(df: DataFrame, size: Column, limit: Column) -> Column:
    """Whether a candidate is taken: it must be smaller than what is there; null candidates never are."""
    return F.coalesce(size < limit, F.lit(False))


def ledger(df: DataFrame, keys: list[str], order: list[str], after: str, first: Column) -> DataFrame:
    """df with before: the previous stage's after, or first."""
    steps = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("before", F.coalesce(F.lag(after).over(steps), first))


def action(steps: dict[str, Column], done: str = "recoded") -> Column:
    """Names of the steps that were taken, joined by +; done if none was."""
    label = F.concat_ws("+", *(F.when(F.coalesce(on, F.lit(False)), name) for name, on in steps.items()))
    return F.when(label == "", done).otherwise(label)


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
