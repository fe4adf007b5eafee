"""Scans in order: running codes, differences, offsets and neighbouring tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_code(df: DataFrame, keys: list[str], order: list[str], start: Column) -> Column:
    """A number where one is given (start), else one more for each row since."""
    steps = Window.partitionBy(*keys).orderBy(*order)
    since = steps.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.row_number().over(steps)
    base = F.last(F.when(start.isNotNull(), F.struct(start.cast("bigint").alias("code"), at.alias("at"))), ignorenulls=True).over(since)
    return base["code"] + at - base["at"]


def deltas(df: DataFrame, keys: list[str], order: list[str], value: str) -> Column:
    """Each value less the one before; the first as it is."""
    return F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0))


def offsets(df: DataFrame, keys: list[str], order: list[str], length: Column, unit: int = 1, first: int = 0) -> Column:
    """Where each row starts if each is filled up to a multiple of unit."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.ceil(length / unit).cast("bigint") * unit
    return F.coalesce(F.sum(filled).over(before), F.lit(0)) + first


#: More tokens than an array holds; slice() overflows near 2^31.
MOST = 2**30


def appearance_fonts(text: Column) -> Column:
    """Names that stand two tokens before Tf, with a name's slash, in a default appearance; tokens part at every white space byte.

    The text is parted twice, whatever its length: each token meets the one two further on in zip_with().
    """
    tokens = F.split(text, "[ \t\n\r\f\\x00]", -1)
    names = F.zip_with(tokens, F.slice(tokens, 3, MOST), lambda name, last: F.when((last == "Tf") & name.startswith("/"), F.substring(name, 2, 2**31 - 1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda name: name.isNotNull())))


def stack_depth(df: DataFrame, keys: list[str], order: list[str], operator: str = "operator") -> DataFrame:
    """df with depth: how many q are open after each row; a Q too many closes nothing."""
    step = F.when(F.col(operator) == "q", 1).when(F.col(operator) == "Q", -1).otherwise(0)
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = df.withColumn("__total", F.sum(step).over(rows))
    return total.withColumn("depth", F.col("__total") - F.least(F.lit(0), F.min("__total").over(rows))).drop("__total")
