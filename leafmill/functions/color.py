"""Color conversions as columns; channels are numbers from 0 to 255 unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Red, green and blue of the sixteen overprints of cyan (1), magenta (2), yellow (4) and black (8).
OVERPRINTS = (
    (0.996078, 0.996078, 0.996078),
    (0.000000, 0.686275, 0.937255),
    (0.925490, 0.149020, 0.560784),
    (0.243137, 0.247059, 0.584314),
    (1.000000, 0.949020, 0.066667),
    (0.000000, 0.658824, 0.349020),
    (0.929412, 0.196078, 0.215686),
    (0.266667, 0.266667, 0.274510),
    (0.215686, 0.203922, 0.207843),
    (0.066667, 0.176471, 0.215686),
    (0.215686, 0.101961, 0.141176),
    (0.133333, 0.098039, 0.160784),
    (0.200000, 0.196078, 0.125490),
    (0.074510, 0.180392, 0.133333),
    (0.215686, 0.121569, 0.113725),
    (0.125490, 0.121569, 0.121569),
)
# The D65 white point, the Bradford cone matrix and its inverse, XYZ to linear sRGB.
D65 = (0.9505, 1.0, 1.089)
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
BRADFORD_BACK = ((0.9870, -0.1471, 0.1600), (0.4323, 0.5184, 0.0493), (-0.0085, 0.0400, 0.9685))
XYZ_TO_SRGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def _byte(v: Column) -> Column:
    return F.least(F.greatest(F.round(v), F.lit(0)), F.lit(255)).cast("int")


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """array(r, g, b): the overprints, each weighted by the area it covers."""
    inks = [v.cast("double") / 255.0 for v in (c, m, y, k)]
    areas = [reduce(lambda a, b: a * b, [ink if n >> i & 1 else 1.0 - ink for i, ink in enumerate(inks)]) for n in range(16)]
    return F.array(*(_byte(reduce(lambda a, b: a + b, [area * p[ch] for area, p in zip(areas, OVERPRINTS, strict=True)]) * 255.0) for ch in range(3)))


def _times(rows, v: list[Column]) -> list[Column]:
    return [sum((x * w for x, w in zip(v[1:], row[1:], strict=True)), v[0] * row[0]) for row in rows]


def _times_numbers(rows, v) -> list[float]:
    return [sum(a * b for a, b in zip(row, v, strict=True)) for row in rows]


def lab_to_srgb(l: Column, a: Column, b: Column, white=D65, limits=(-100.0, 100.0, -100.0, 100.0)) -> Column:  # noqa: E741
    """array of three numbers from 0 to 1, by Bradford adaptation from white to D65."""
    clamp = lambda v, lo, hi: F.least(F.greatest(v, F.lit(lo)), F.lit(hi))
    l, a, b = clamp(l, 0.0, 100.0), clamp(a, *limits[:2]), clamp(b, *limits[2:])  # noqa: E741
    mid = (l + 16.0) / 116.0
    cube = lambda t: F.when(t >= 6 / 29, t * t * t).otherwise((t - 4 / 29) * (108 / 841))
    xyz = [cube(mid + a / 500.0) * white[0], cube(mid) * white[1], cube(mid - b / 200.0) * white[2]]
    there, here = _times_numbers(BRADFORD, D65), _times_numbers(BRADFORD, white)
    cones = [v * (t / h if h else 0.0) for v, t, h in zip(_times(BRADFORD, xyz), there, here, strict=True)]
    linear = [clamp(v, 0.0, 1.0) for v in _times(XYZ_TO_SRGB, _times(BRADFORD_BACK, cones))]
    return F.array(*(F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055) for v in linear))


def ycck_to_cmyk(y: Column, cb: Column, cr: Column, k: Column, whole: bool = False) -> Column:
    """array(c, m, y, k), cut to whole numbers.

    whole says that the channels are whole numbers: sums are then of thousandths, without error. In doubles
    481.816 - 1.772 * 128 is less than 255 and is cut to 254.
    """
    unit = 1000 if whole else 1.0
    of = lambda v: round(v * 1000) if whole else v
    cut = lambda v: F.floor(F.least(F.greatest(v, F.lit(0 * unit)), F.lit(255 * unit)) / unit).cast("int")
    return F.array(cut(of(434.456) - y * unit - of(1.402) * cr), cut(of(119.541) - y * unit + of(0.344) * cb + of(0.714) * cr), cut(of(481.816) - y * unit - of(1.772) * cb), k.cast("int"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def decoded(sample: Column, low: float, high: float, depth: int) -> Column:
    """A sample of so many bits by a decode pair."""
    return low + sample * ((high - low) / (2**depth - 1))


def block_similarity(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """Structural similarity of two blocks from their sums: of each, of squares, of products, over n pixels."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = a / n, b / n
    va, vb, cov = aa / n - ma * ma, bb / n - mb * mb, ab / n - ma * mb
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
