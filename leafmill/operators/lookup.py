"""Lookups with precedence: scopes, ranges, and groups of which one lack fails all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(uses: DataFrame, entries: DataFrame, on: list[str], use: str, depth: str, carry: list[str]) -> DataFrame:
    """For each use the entry of the innermost scope (least depth) that has its name; uses without any have nulls."""
    found = uses.join(entries, on, "left").groupBy(use).agg(F.min(F.when(F.col(depth).isNotNull(), F.struct(depth, *carry))).alias("hit"))
    return found.select(use, *(F.col(f"hit.{c}").alias(c) for c in (depth, *carry)))


def by_range(rows: DataFrame, value: Column, ranges: list[tuple], default=None) -> Column:
    """What the first of ranges (low, high, result), both ends included, that holds the value gives."""
    out = F.lit(default)
    for low, high, result in reversed(ranges):
        out = F.when(value.between(low, high), F.lit(result)).otherwise(out)
    return out


def range_join(rows: DataFrame, value: str, ranges: DataFrame, width: int) -> DataFrame:
    """rows with the columns of the first range (ordinal, low, high, ...) that holds value; rows without one are kept.

    Ranges are cut into cells of width; a cell lists its ranges in order, and rows are joined to their one cell, so no
    row is multiplied and none meets a range of another cell.
    """
    cell = lambda c: F.floor(c / width).cast("bigint")
    extra = [c for c in ranges.columns if c not in ("ordinal", "low", "high")]
    cells = ranges.withColumn("__cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    cells = cells.groupBy("__cell").agg(F.sort_array(F.collect_list(F.struct("ordinal", "low", "high", *extra))).alias("__ranges"))
    met = rows.withColumn("__cell", cell(F.col(value))).join(cells, "__cell", "left")
    hit = met.withColumn("__hit", F.get(F.filter("__ranges", lambda r: F.col(value).between(r["low"], r["high"])), F.lit(0)))
    return hit.select(*rows.columns, *(F.col(f"__hit.{c}").alias(c) for c in ("low", "high", *extra)))


def all_or_none(rows: DataFrame, usage: DataFrame, on: str, group: str, value: str) -> DataFrame:
    """group, covered, and the sorted distinct values of its rows' usage; none at all where one row has no usage."""
    both = rows.join(usage, on, "left")
    covered = F.bool_and(F.col(value).isNotNull())
    return both.groupBy(group).agg(covered.alias("covered"), F.when(covered, F.array_sort(F.collect_set(value))).alias("values"))
