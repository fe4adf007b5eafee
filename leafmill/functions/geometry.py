"""Matrices and rectangles as structs of columns.

A matrix is a struct a, b, c, d, e, f that takes (x, y) to (ax + cy + e,
bx + dy + f); a rectangle is a struct x0, y0, x1, y1 with x0 <= x1, y0 <= y1.
"""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this size a determinant counts as zero; and the slack of covers().
SINGULAR, SLACK = 1e-12, 1e-4
SIDES = ("x0", "y0", "x1", "y1")
#: Expressions whose text is longer than this are evaluated once and bound.
LONG = 150


def bound(f):
    """Evaluates long arguments of f once each, not wherever f names them: nested calls would else grow as a power."""

    @wraps(f)
    def run(*args):
        composed = [i for i, a in enumerate(args) if isinstance(a, Column) and len(str(a)) > LONG]
        if not composed:
            return f(*args)
        values = F.struct(*(args[i].alias(f"v{i}") for i in composed))
        return F.transform(F.array(values), lambda v: f(*(v[f"v{i}"] if i in composed else a for i, a in enumerate(args))))[0]

    return run


def matrix(a, b, c, d, e, f) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f), strict=True)))


IDENTITY = (1, 0, 0, 1, 0, 0)


@bound
def then(m: Column, n: Column) -> Column:
    """First m, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


@bound
def invert(m: Column) -> Column:
    """Null if the matrix is singular or not finite."""
    det = determinant(m)
    bad = F.isnan(det) | (F.abs(det) == float("inf")) | (F.abs(det) < SINGULAR)
    safe = F.when(bad, F.lit(None)).otherwise(det)
    a, b, c, d = m["d"] / safe, -m["b"] / safe, -m["c"] / safe, m["a"] / safe
    return F.when(~bad, matrix(a, b, c, d, -(m["e"] * a + m["f"] * c), -(m["e"] * b + m["f"] * d)))


def unit_extent(m: Column) -> tuple[Column, Column]:
    """Lengths of the images of the unit vectors."""
    return F.hypot(m["a"], m["b"]), F.hypot(m["c"], m["d"])


def rect(x0, y0, x1, y1) -> Column:
    """The rectangle with these opposite corners."""
    if not any(isinstance(v, Column) for v in (x0, y0, x1, y1)):
        x0, y0, x1, y1 = min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)
        return _struct(*(F.lit(float(v)) for v in (x0, y0, x1, y1)))
    x0, y0, x1, y1 = (v if isinstance(v, Column) else F.lit(v) for v in (x0, y0, x1, y1))
    at = (F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
    return F.struct(*(v.cast("double").alias(n) for n, v in zip(SIDES, at, strict=True)))


def _struct(*sides: Column) -> Column:
    return F.struct(*(v.alias(n) for n, v in zip(SIDES, sides, strict=True)))


def bounds(points: list[tuple[Column, Column]]) -> Column:
    xs, ys = zip(*points, strict=True)
    return _struct(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


@bound
def intersect(a: Column, b: Column) -> Column:
    """Empty where the two don't meet."""
    x0, y0 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"])
    return _struct(x0, y0, F.greatest(x0, F.least(a["x1"], b["x1"])), F.greatest(y0, F.least(a["y1"], b["y1"])))


@bound
def union(a: Column, b: Column) -> Column:
    return _struct(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def is_empty(r: Column) -> Column:
    return (width(r) <= 0) | (height(r) <= 0)


@bound
def covers(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"] + SLACK) & (a["y0"] <= b["y0"] + SLACK) & (a["x1"] >= b["x1"] - SLACK) & (a["y1"] >= b["y1"] - SLACK)


@bound
def transformed(r: Column, m: Column) -> Column:
    """Bounds of the images of the four corners."""
    return bounds([apply(m, r[x], r[y]) for x in ("x0", "x1") for y in ("y0", "y1")])


@bound
def unit_square(m: Column) -> Column:
    return bounds([(m["e"], m["f"]), (m["a"] + m["e"], m["b"] + m["f"]), (m["c"] + m["e"], m["d"] + m["f"]), (m["a"] + m["c"] + m["e"], m["b"] + m["d"] + m["f"])])


@bound
def visible_part(m: Column, clip: Column) -> Column:
    """What of the unit square shows through clip, in unit coordinates: null if all of it, or if m is singular; zeros if none."""
    box = unit_square(m)
    seen = intersect(box, clip)
    back = transformed(seen, invert(m))
    within = intersect(back, rect(0.0, 0.0, 1.0, 1.0))
    none = rect(0.0, 0.0, 0.0, 0.0)
    return F.when(invert(m).isNull() | covers(clip, box), F.lit(None)).when(is_empty(seen), none).otherwise(within)


@bound
def fit(box: Column, m: Column, target: Column) -> Column:
    """The matrix that, after m, takes box's image onto target: m, then scaling, then moving."""
    seen = transformed(box, m)
    scale = lambda a, b: F.when(a == 0, F.lit(1.0)).otherwise(b / F.when(a == 0, F.lit(1.0)).otherwise(a))
    sx, sy = scale(width(seen), width(target)), scale(height(seen), height(target))
    return then(m, matrix(sx, 0.0, 0.0, sy, target["x0"] - seen["x0"] * sx, target["y0"] - seen["y0"] * sy))


@bound
def crop_pixels(part: Column, w: Column, h: Column) -> Column:
    """Pixel rectangle x, y, w, h of part of the unit square, rounded outward, rows from the top; null if empty or whole."""
    x0, x1 = F.greatest(F.floor(part["x0"] * w), F.lit(0)), F.least(F.ceil(part["x1"] * w), w)
    y0, y1 = F.greatest(F.floor((1 - part["y1"]) * h), F.lit(0)), F.least(F.ceil((1 - part["y0"]) * h), h)
    good = (x1 > x0) & (y1 > y0) & ~((x0 == 0) & (y0 == 0) & (x1 == w) & (y1 == h))
    return F.when(good, F.struct(*(v.cast("bigint").alias(n) for n, v in zip("xywh", (x0, y0, x1 - x0, y1 - y0), strict=True))))


def unit_of(px: Column, w: Column, h: Column) -> Column:
    """The part of the unit square that a pixel rectangle covers."""
    return _struct(px["x"] / w, 1 - (px["y"] + px["h"]) / h, (px["x"] + px["w"]) / w, 1 - px["y"] / h)


def scaled_size(n: Column, factor: Column) -> Column:
    return F.greatest(F.round(n * factor), F.lit(1)).cast("int")


def page_clip(media: Column, crop: Column) -> Column:
    """Both boxes' common part, the one there is, or null for no limit."""
    return F.when(media.isNotNull() & crop.isNotNull(), intersect(media, crop)).otherwise(F.coalesce(media, crop))


def union_all(rects: list[Column]) -> Column:
    return reduce(union, rects)
