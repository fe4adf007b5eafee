"""Named bit sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the codecs and of the kinds of entries to strip, by bit.
CODECS = ("source", "flate", "jpeg", "g4", "jbig2")
STRIP = ("threads", "metadata", "piece-info", "struct-tree", "thumbnails", "spider", "alternates", "output-intents")


def bits(names: list[str] | tuple[str, ...], known: tuple[str, ...]) -> int:
    return reduce(lambda a, n: a | 1 << known.index(n), names, 0)


def parse(text: Column, known: tuple[str, ...]) -> Column:
    """The set that a comma list names; blanks and none add nothing; an unknown name is an error that lists the choices."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.btrim(x)), lambda x: (x != "") & (x != "none"))
    strange = F.filter(parts, lambda x: ~x.isin(*known))
    value = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.array_contains(parts, n), 1 << i).otherwise(0) for i, n in enumerate(known)])
    return F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("unknown name "), strange[0], F.lit("; choose from " + ", ".join(known)))).cast("int")).otherwise(value)


def text(value: Column, known: tuple[str, ...]) -> Column:
    """Names joined by |; none for the empty set."""
    names = F.concat_ws("|", *(F.when(value.bitwiseAND(1 << i) != 0, n) for i, n in enumerate(known)))
    return F.when(value == 0, "none").otherwise(names)


def contains(value: Column, all_of: Column | int) -> Column:
    """Whether all bits of all_of are in value."""
    other = F.lit(all_of) if isinstance(all_of, int) else all_of
    return value.bitwiseAND(other) == other
