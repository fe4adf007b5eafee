"""Presets as a table, gates on them, and rules about images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.sets import CODECS, STRIP, bits

# The three presets.
PRESETS = {
    "less": {"bitonal": "jbig2,source", "continuous": "jpeg,source", "indexed": "", "target": 200.0, "threshold": 400.0, "quality": 75, "rgb": False, "clip": False, "reduce": False, "subset": True, "cff": False, "unembed": True, "strip": "", "floor": 0.95},
    "standard": {"bitonal": "g4,source", "continuous": "jpeg,flate,source", "indexed": "flate,source", "target": 150.0, "threshold": 150.0, "quality": 60, "rgb": False, "clip": True, "reduce": True, "subset": True, "cff": True, "unembed": False, "strip": "threads,metadata,piece-info,thumbnails,spider,alternates,output-intents", "floor": 0.93},
    "more": {"bitonal": "jbig2,source", "continuous": "jpeg,source", "indexed": "flate,source", "target": 72.0, "threshold": 110.0, "quality": 60, "rgb": True, "clip": True, "reduce": True, "subset": True, "cff": True, "unembed": True, "strip": "threads,metadata,piece-info,struct-tree,thumbnails,spider,alternates", "floor": 0.90},
}
# Images below this many pixels are left as they are; bytes that a cropped image's wrapper costs.
TINY, WRAPPER = 10_000, 200
SETS = {"bitonal": CODECS, "continuous": CODECS, "indexed": CODECS, "strip": STRIP}
SCHEMA = "preset string, bitonal int, continuous int, indexed int, target double, threshold double, quality int, rgb boolean, clip boolean, reduce boolean, subset boolean, cff boolean, unembed boolean, strip int, floor double"


def _set(names: str, known: tuple[str, ...]) -> int:
    return bits([n for n in names.split(",") if n], known)


def presets(spark: SparkSession) -> DataFrame:
    rows = [(name, *(_set(v, SETS[k]) if k in SETS else v for k, v in p.items())) for name, p in PRESETS.items()]
    return spark.createDataFrame(rows, SCHEMA)


def overridden(df: DataFrame, given: dict[str, object]) -> DataFrame:
    """Presets with the values that are given."""
    return df.withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in given.items() if v is not None})


def stage_gates(p: DataFrame) -> DataFrame:
    """preset and whether each stage has anything to do; the last always has."""
    any_codec = (F.col("bitonal") != 0) | (F.col("continuous") != 0) | (F.col("indexed") != 0)
    return p.select("preset", ((F.col("threshold") >= 0) | F.col("clip") | F.col("subset")).alias("usage"), any_codec.alias("images"), (F.col("subset") | F.col("cff") | F.col("unembed")).alias("fonts"), (F.col("strip") != 0).alias("strip"), F.lit(True).alias("structure"))


def trials(files: DataFrame, p: DataFrame, chosen: str, default: str = "standard") -> DataFrame:
    """Every chosen file with every preset; a file that isn't chosen with the default one, ignored."""
    return files.crossJoin(F.broadcast(p.select("preset"))).filter(F.col(chosen) | (F.col("preset") == default)).withColumn("ignored", ~F.col(chosen))


def expected(trials_: DataFrame, expectations: DataFrame) -> DataFrame:
    """trials with expected: an expectation names the file, and the preset or none."""
    e = expectations.select(F.col("file").alias("__file"), F.col("preset").alias("__preset")).distinct()
    on = (F.col("file") == F.col("__file")) & (F.col("__preset").isNull() | (F.col("preset") == F.col("__preset")))
    hits = trials_.join(e, on, "left_semi").select("file", "preset").withColumn("__hit", F.lit(True))
    return trials_.join(hits, ["file", "preset"], "left").withColumn("expected", F.coalesce("__hit", F.lit(False))).drop("__hit")


def is_sane(target: Column, threshold: Column) -> Column:
    return (threshold < 0) | (target > 0) & (threshold >= target)


def is_tiny(w: Column, h: Column) -> Column:
    return w.cast("bigint") * h.cast("bigint") < TINY


def image_class(bits_per: Column, space: Column, stencil: Column) -> Column:
    """bitonal, indexed, gray or color."""
    return F.when(stencil | (bits_per == 1) & (space == "Gray"), "bitonal").when(space == "Indexed", "indexed").when(space == "Gray", "gray").otherwise("color")


def downsamples(dpi: Column, threshold: Column, keyed: Column, w: Column, h: Column) -> Column:
    """Only known resolutions above an enabled threshold, no color key, not tiny."""
    return F.coalesce((threshold >= 0) & (dpi > threshold), F.lit(False)) & ~keyed & ~is_tiny(w, h)


def crops(enabled: Column, w: Column, h: Column, kept_w: Column, kept_h: Column, size: Column) -> Column:
    """A sixteenth of the area must be hidden, and what it holds of the bytes be more than the wrapper."""
    total, kept = w.cast("bigint") * h, kept_w.cast("bigint") * kept_h
    saved = F.call_function("div", size.cast("bigint") * (total - kept), F.greatest(total, F.lit(1)))
    return enabled & F.coalesce((kept * 16 <= total * 15) & (saved > WRAPPER), F.lit(False))


def converts(rgb: Column, keyed: Column, space: Column, profile: Column) -> Column:
    """To RGB: CMYK, and RGB with a profile; never gray, never with a color key."""
    return rgb & ~keyed & ((space == "CMYK") | (space == "RGB") & profile)


def codecs_for(class_: Column) -> Column:
    return F.when(class_ == "bitonal", F.col("bitonal")).when(class_ == "indexed", F.col("indexed")).otherwise(F.col("continuous"))


# Keys to strip, by kind of dictionary and flag.
STRIP_RULES = (
    ("catalog", "threads", "Threads"), ("catalog", "struct-tree", "StructTreeRoot"), ("catalog", "struct-tree", "MarkInfo"), ("catalog", "spider", "SpiderInfo"),
    ("catalog", "output-intents", "OutputIntents"), ("catalog", "metadata", "Metadata"), ("page", "threads", "B"), ("page", "thumbnails", "Thumb"),
    ("image", "alternates", "Alternates"), ("object", "metadata", "Metadata"), ("object", "piece-info", "PieceInfo"), ("object", "struct-tree", "StructParents"),
    ("object", "struct-tree", "StructParent"),
)


def stripped(entries: DataFrame, flags: int) -> DataFrame:
    """Entries (doc, id, key, kind, typed, is_stream, is_image, is_page, is_catalog) that the flags leave.

    Rules for objects hold for every stream but only for dictionaries that say their type.
    """
    rules = [(kind, key) for kind, flag, key in STRIP_RULES if flags >> STRIP.index(flag) & 1]
    where = {"catalog": F.col("is_catalog"), "page": F.col("is_page"), "image": F.col("is_image"), "object": F.col("is_stream") | F.col("typed")}
    gone = F.lit(False)
    for kind, key in rules:
        gone = gone | (F.col("key") == key) & where[kind]
    return entries.filter(~F.coalesce(gone, F.lit(False)))
