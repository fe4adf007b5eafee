"""Where and how objects are used: resolution, visible boxes, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points in an inch.
INCH = 72.0
INFINITY = float("inf")


def _over(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(INFINITY))


def min_resolution(w: Column, h: Column, w_points: Column, h_points: Column) -> Column:
    """Aggregate: the least dots per inch over all placements, the lesser axis of each; null without any."""
    return F.min(F.least(_over(w.cast("double"), w_points / INCH), _over(h.cast("double"), h_points / INCH)))


def union_box(box: Column) -> Column:
    """Aggregate: the box around all boxes; null as soon as one is null."""
    around = F.struct(F.min(box["x0"]).alias("x0"), F.min(box["y0"]).alias("y0"), F.max(box["x1"]).alias("x1"), F.max(box["y1"]).alias("y1"))
    return F.when(F.bool_and(box.isNotNull()), around)


def distinct_sorted(value: Column) -> Column:
    """Aggregate: the distinct values in order."""
    return F.array_sort(F.collect_set(value))


def removable(entries: DataFrame, used: DataFrame, owner: list[str], name: str, whole: str) -> DataFrame:
    """Entries (owner, name) that no use names; an owner of which one use keeps the whole (whole) loses none; owners without uses lose none."""
    keep = used.groupBy(*owner).agg(F.bool_or(F.coalesce(F.col(whole), F.lit(False))).alias("__whole"))
    known = entries.join(keep.filter("not __whole").select(*owner), owner, "left_semi")
    return known.join(used.filter(F.col(name).isNotNull()).select(*owner, name).distinct(), [*owner, name], "left_anti")


def resource_category(operator: Column) -> Column:
    """The kind of resource that an operator of a content stream names; null if it names none."""
    # Operators by the kind of resource they name.
    kinds = {"XObject": ("Do",), "Font": ("Tf",), "ExtGState": ("gs",), "ColorSpace": ("cs", "CS"), "Pattern": ("scn", "SCN"), "Shading": ("sh",), "Properties": ("BDC", "DP")}
    out = F.lit(None).cast("string")
    for kind, names in kinds.items():
        out = F.when(operator.isin(*names), kind).otherwise(out)
    return out
