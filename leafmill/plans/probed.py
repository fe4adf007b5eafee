"""Queries over probe documents, each of which varies one thing, and over formatting and geometry.

The documents are built in memory; they are parsed, compressed and read again
by the same operators that work on files. The SQL states the rows that must
come out, from the documents' definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import color, fonts, geometry, glyphs, text
from leafmill.operators import compare, presets
from leafmill.session import table
from leafmill.sources import documents, probes

from .catalog import _r, query


def _files(spark: SparkSession, *names: str) -> DataFrame:
    made = probes.probes() | probes.damaged()
    return spark.createDataFrame([(n, bytearray(made[n])) for n in names or probes.probes()], "path string, content binary").repartition(4)


def _done(spark: SparkSession, preset: str, *names: str) -> DataFrame:
    return documents.compressed(_files(spark, *names), preset)


@query("""
SELECT * FROM (VALUES
  ('bitonal-lines', 0, 3), ('clipped', 0, 3), ('cmyk', 0, 3), ('duplicates', 0, 3), ('form', 0, 3), ('gray-rgb-300dpi', 0, 3), ('indexed', 0, 3), ('inline', 0, 3), ('metadata', 0, 3),
  ('unused', 0, 3), ('verbose', 0, 3)
) t(doc_id, page, num)
""")
def probe_pages(spark, sf):
    return documents.pages(_files(spark)).select("doc_id", "page", "num")


@query("""
SELECT * FROM (VALUES
  ('bitonal-lines', 'dictionary', 3, 0), ('bitonal-lines', 'stream', 2, 1), ('clipped', 'dictionary', 3, 0), ('clipped', 'stream', 2, 1), ('cmyk', 'dictionary', 3, 0), ('cmyk', 'stream', 2, 1),
  ('duplicates', 'dictionary', 3, 0), ('duplicates', 'stream', 3, 2), ('form', 'dictionary', 4, 0), ('form', 'stream', 3, 1), ('gray-rgb-300dpi', 'dictionary', 3, 0),
  ('gray-rgb-300dpi', 'stream', 2, 1), ('indexed', 'dictionary', 3, 0), ('indexed', 'stream', 2, 1), ('inline', 'dictionary', 3, 0), ('inline', 'stream', 1, 0), ('metadata', 'dictionary', 3, 0),
  ('metadata', 'stream', 3, 1), ('unused', 'dictionary', 4, 0), ('unused', 'stream', 3, 2), ('verbose', 'dictionary', 3, 0), ('verbose', 'stream', 1, 0)
) t(doc_id, kind, n, images)
""")
def probe_objects(spark, sf):
    return documents.objects(_files(spark)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("subtype") == "Image").alias("images"))


@query("""
SELECT * FROM (VALUES
  ('metadata', 1, 'Metadata', 'reference', -1.0, ''), ('metadata', 1, 'Pages', 'reference', -1.0, ''), ('metadata', 1, 'Type', 'name', -1.0, 'Catalog'),
  ('metadata', 2, 'Count', 'integer', 1.0, ''), ('metadata', 2, 'Kids/0', 'reference', -1.0, ''), ('metadata', 2, 'Type', 'name', -1.0, 'Pages'),
  ('metadata', 3, 'Contents', 'reference', -1.0, ''), ('metadata', 3, 'MediaBox/0', 'integer', 0.0, ''), ('metadata', 3, 'MediaBox/1', 'integer', 0.0, ''),
  ('metadata', 3, 'MediaBox/2', 'integer', 300.0, ''), ('metadata', 3, 'MediaBox/3', 'integer', 300.0, ''), ('metadata', 3, 'Parent', 'reference', -1.0, ''),
  ('metadata', 3, 'Thumb', 'reference', -1.0, ''), ('metadata', 3, 'Type', 'name', -1.0, 'Page'), ('metadata', 5, 'Type', 'name', -1.0, 'Metadata'),
  ('metadata', 6, 'BitsPerComponent', 'integer', 8.0, ''), ('metadata', 6, 'ColorSpace', 'name', -1.0, 'DeviceRGB'), ('metadata', 6, 'Height', 'integer', 16.0, ''),
  ('metadata', 6, 'Subtype', 'name', -1.0, 'Image'), ('metadata', 6, 'Type', 'name', -1.0, 'XObject'), ('metadata', 6, 'Width', 'integer', 16.0, ''),
  ('verbose', 1, 'Pages', 'reference', -1.0, ''), ('verbose', 1, 'Type', 'name', -1.0, 'Catalog'), ('verbose', 2, 'Count', 'integer', 1.0, ''), ('verbose', 2, 'Kids/0', 'reference', -1.0, ''),
  ('verbose', 2, 'Type', 'name', -1.0, 'Pages'), ('verbose', 3, 'Contents', 'reference', -1.0, ''), ('verbose', 3, 'MediaBox/0', 'integer', 0.0, ''),
  ('verbose', 3, 'MediaBox/1', 'integer', 0.0, ''), ('verbose', 3, 'MediaBox/2', 'integer', 300.0, ''), ('verbose', 3, 'MediaBox/3', 'integer', 300.0, ''),
  ('verbose', 3, 'Parent', 'reference', -1.0, ''), ('verbose', 3, 'Type', 'name', -1.0, 'Page')
) t(doc_id, num, path, kind, number, text)
""")
def probe_entries(spark, sf):
    return documents.entries(_files(spark, "verbose", "metadata")).filter("path[0] <> 'Length'").select("doc_id", "num", F.concat_ws("/", "path").alias("path"), "kind", F.coalesce("value_num", F.lit(-1.0)).alias("number"), F.coalesce(F.col("value_bin").cast("string"), F.lit("")).alias("text"))


@query("""
SELECT * FROM (VALUES
  ('duplicates', 0, 'Root', 1), ('duplicates', 1, 'Pages', 2), ('duplicates', 2, 'Kids/0', 3), ('duplicates', 3, 'Contents', 4), ('duplicates', 3, 'Parent', 2),
  ('duplicates', 3, 'Resources/XObject/A', 5), ('duplicates', 3, 'Resources/XObject/B', 6), ('form', 0, 'Root', 1), ('form', 1, 'Pages', 2), ('form', 2, 'Kids/0', 3), ('form', 3, 'Contents', 4),
  ('form', 3, 'Parent', 2), ('form', 3, 'Resources/Font/T', 6), ('form', 3, 'Resources/XObject/Fm', 7), ('form', 7, 'Resources/XObject/Im', 5)
) t(doc_id, src_num, path, dst_num)
""")
def probe_edges(spark, sf):
    return documents.edges(_files(spark, "form", "duplicates")).select("doc_id", "src_num", F.concat_ws("/", "path").alias("path"), "dst_num")


@query("""
SELECT * FROM (VALUES
  ('clipped', 0, 'q', ''), ('clipped', 1, 're', '0 0 100 200'), ('clipped', 2, 'W', ''), ('clipped', 3, 'n', ''), ('clipped', 4, 'cm', '200 0 0 200 0 0'), ('clipped', 5, 'Do', '/Im'),
  ('clipped', 6, 'Q', ''), ('duplicates', 0, 'q', ''), ('duplicates', 1, 'cm', '50 0 0 50 0 0'), ('duplicates', 2, 'Do', '/A'), ('duplicates', 3, 'Q', ''), ('duplicates', 4, 'q', ''),
  ('duplicates', 5, 'cm', '50 0 0 50 60 0'), ('duplicates', 6, 'Do', '/B'), ('duplicates', 7, 'Q', ''), ('form', 0, 'q', ''), ('form', 1, 'cm', '2 0 0 2 0 0'), ('form', 2, 'Do', '/Fm'),
  ('form', 3, 'Q', ''), ('form', 4, 'Tf', '/T 12'), ('form', 5, 'Tj', '(hello)')
) t(doc_id, seq, operator, operands)
""")
def probe_operations(spark, sf):
    return documents.content_operations(_files(spark, "form", "clipped", "duplicates")).select("doc_id", "seq", "operator", F.concat_ws(" ", "operands").alias("operands"))


@query("""
SELECT * FROM (VALUES
  ('bitonal-lines', 144.0, 72.0, -1.0, -1.0, -1.0, -1.0), ('clipped', 200.0, 200.0, 0.0, 0.0, 0.5, 1.0), ('cmyk', 72.0, 72.0, -1.0, -1.0, -1.0, -1.0),
  ('duplicates', 50.0, 50.0, -1.0, -1.0, -1.0, -1.0), ('duplicates', 50.0, 50.0, -1.0, -1.0, -1.0, -1.0), ('form', 144.0, 72.0, -1.0, -1.0, -1.0, -1.0),
  ('gray-rgb-300dpi', 72.0, 72.0, -1.0, -1.0, -1.0, -1.0), ('indexed', 96.0, 72.0, -1.0, -1.0, -1.0, -1.0), ('unused', 72.0, 72.0, -1.0, -1.0, -1.0, -1.0)
) t(doc_id, width, height, x0, y0, x1, y1)
""")
def probe_placements(spark, sf):
    found = documents.placements(_files(spark))
    return found.select("doc_id", _r(F.col("width_pt").cast("double"), 2).alias("width"), _r(F.col("height_pt").cast("double"), 2).alias("height"), *(F.coalesce(_r(F.col(f"crop.{c}").cast("double"), 3), F.lit(-1.0)).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("""
SELECT * FROM (VALUES
  ('form', 'hello', '101,104,108,111')
) t(doc_id, strings, codes)
""")
def probe_shown_codes(spark, sf):
    found = documents.shown_strings(_files(spark, "form", "verbose"))
    return found.select("doc_id", F.concat_ws(",", F.transform("strings", lambda s: s.cast("string"))).alias("strings"), F.concat_ws(",", F.transform(glyphs.used_codes(F.col("strings")), lambda c: c.cast("string"))).alias("codes"))


@query("""
SELECT * FROM (VALUES
  ('bitonal-lines', 'less', 1200, 600, 600.0, 'kept: no codec at hand', 1, true), ('bitonal-lines', 'more', 1200, 600, 600.0, 'kept: no codec at hand', 1, true),
  ('bitonal-lines', 'standard', 1200, 600, 600.0, 'downsampled', 1, true), ('clipped', 'less', 400, 400, 144.0, 'kept: no codec at hand', 1, true),
  ('clipped', 'more', 400, 400, 144.0, 'kept: no codec at hand', 1, true), ('clipped', 'standard', 400, 400, 144.0, 'clipped', 1, true),
  ('cmyk', 'less', 100, 100, 100.0, 'kept: no codec at hand', 1, true), ('cmyk', 'more', 100, 100, 100.0, 'kept: no codec at hand', 1, true),
  ('cmyk', 'standard', 100, 100, 100.0, 'recoded', 1, true), ('duplicates', 'less', 100, 100, 144.0, 'kept: no codec at hand', 2, true),
  ('duplicates', 'more', 100, 100, 144.0, 'kept: no codec at hand', 2, true), ('duplicates', 'standard', 100, 100, 144.0, 'recoded', 2, true),
  ('form', 'less', 144, 144, 72.0, 'kept: no codec at hand', 1, true), ('form', 'more', 144, 144, 72.0, 'kept: no codec at hand', 1, true),
  ('form', 'standard', 144, 144, 72.0, 'recoded', 1, true), ('gray-rgb-300dpi', 'less', 300, 300, 300.0, 'kept: no codec at hand', 1, true),
  ('gray-rgb-300dpi', 'more', 300, 300, 300.0, 'kept: no codec at hand', 1, true), ('gray-rgb-300dpi', 'standard', 300, 300, 300.0, 'reduced+downsampled', 1, true),
  ('indexed', 'less', 400, 300, -1.0, 'kept: class excluded', 1, true), ('indexed', 'more', 400, 300, 300.0, 'downsampled', 1, true),
  ('indexed', 'standard', 400, 300, 300.0, 'downsampled', 1, true), ('metadata', 'less', 16, 16, -1.0, 'kept: no codec at hand', 1, true),
  ('metadata', 'more', 16, 16, -1.0, 'kept: no codec at hand', 1, true), ('metadata', 'standard', 16, 16, -1.0, 'recoded', 1, true),
  ('unused', 'less', 80, 80, -1.0, 'kept: no codec at hand', 1, true), ('unused', 'less', 80, 80, 80.0, 'kept: no codec at hand', 1, true),
  ('unused', 'more', 80, 80, -1.0, 'kept: no codec at hand', 1, true), ('unused', 'more', 80, 80, 80.0, 'kept: no codec at hand', 1, true),
  ('unused', 'standard', 80, 80, -1.0, 'recoded', 1, true), ('unused', 'standard', 80, 80, 80.0, 'recoded', 1, true)
) t(doc_id, preset, width, height, dpi, action, n, never_grew)
""")
def probe_image_rows(spark, sf):
    rows = [documents.image_rows(_done(spark, p)) for p in presets.PRESETS]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("doc_id", "preset", "width", "height", F.coalesce(F.round(F.col("dpi").cast("double")), F.lit(-1.0)).alias("dpi"), "action").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("bytes_out") <= F.col("bytes_in")).alias("never_grew"))


@query("""
SELECT * FROM (VALUES
  ('bitonal-lines', '300', '150', '1', 'DeviceGray', 'CCITTFaxDecode'), ('clipped', '200', '400', '8', 'DeviceGray', 'FlateDecode'), ('cmyk', '100', '100', '8', 'DeviceCMYK', 'FlateDecode'),
  ('duplicates', '100', '100', '8', 'DeviceGray', 'FlateDecode'), ('form', '144', '144', '8', 'DeviceRGB', 'FlateDecode'), ('gray-rgb-300dpi', '150', '150', '8', 'DeviceGray', 'FlateDecode'),
  ('indexed', '200', '150', '8', 'array', 'FlateDecode'), ('unused', '80', '80', '8', 'DeviceRGB', 'FlateDecode')
) t(doc_id, width, height, bits, space, filter)
""")
def probe_images_written(spark, sf):
    """Images as they stand in the compressed files."""
    out = documents.entries(_done(spark, "standard").select(F.col("doc_id").alias("path"), F.col("output").alias("content")))
    value = lambda key: F.max(F.when(F.concat_ws("/", "path") == key, F.coalesce(F.col("value_num").cast("int").cast("string"), F.col("value_bin").cast("string"))))
    rows = out.groupBy("doc_id", "num").agg(*(value(k).alias(n) for n, k in (("subtype", "Subtype"), ("width", "Width"), ("height", "Height"), ("bits", "BitsPerComponent"), ("space", "ColorSpace"), ("filter", "Filter"))))
    return rows.filter("subtype = 'Image'").drop("subtype", "num").fillna("array", ["space"])


@query("""
SELECT * FROM (VALUES
  ('bitonal-lines', '', true, 1, true), ('clipped', '', true, 1, true), ('cmyk', '', true, 1, true), ('duplicates', '', true, 1, true), ('form', '', true, 1, true),
  ('gray-rgb-300dpi', '', true, 1, true), ('indexed', '', true, 1, true), ('inline', '', true, 1, true), ('junk', 'does not parse', false, 0, true),
  ('locked', 'password required', false, 1, true), ('lost-content', 'missing content', false, 1, true), ('lost-page', 'broken page tree', false, 1, true), ('metadata', '', true, 1, true),
  ('unused', '', true, 1, true), ('verbose', '', true, 1, true)
) t(doc_id, refusal, ok, pages, never_grew)
""")
def probe_outcomes(spark, sf):
    done = _done(spark, "standard", *probes.probes(), *probes.damaged())
    ok = documents.outcome(done).select("doc_id", "ok")
    kind = F.regexp_extract(F.coalesce("refusal", F.lit("")), "^(does not parse|[a-z -]*)", 1)
    pages = documents.pages(done.select(F.col("doc_id").alias("path"), F.col("output").alias("content"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    return done.join(ok, "doc_id").join(pages, "doc_id", "left").select("doc_id", kind.alias("refusal"), "ok", F.coalesce("pages", F.lit(0)).alias("pages"), (F.col("output_bytes") <= F.col("input_bytes")).alias("never_grew"))


@query("""
SELECT * FROM (VALUES
  ('clipped', 'content streams rebuilt: 1'), ('duplicates', 'content streams rebuilt: 1'), ('duplicates', 'objects merged: 1'), ('form', 'content streams rebuilt: 1'),
  ('inline', 'output would not be smaller; the input is kept'), ('metadata', 'entries stripped: 2'), ('unused', 'unused resources: 2'), ('verbose', 'content streams rebuilt: 1')
) t(doc_id, note)
""")
def probe_notes(spark, sf):
    return _done(spark, "standard").select("doc_id", F.explode("notes").alias("note")).filter("note not like 'bytes saved%'")


@query("""
SELECT * FROM (VALUES
  ('clipped', 'images,fonts,strip,structure', true), ('metadata', 'images,fonts,strip,structure', true), ('verbose', 'images,fonts,strip,structure', true)
) t(doc_id, stages, chained)
""")
def probe_ledger(spark, sf):
    rows = documents.stage_rows(_done(spark, "more", "clipped", "verbose", "metadata"))
    done = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("stage_no", "name", "bytes_before", "bytes_after"))).alias("s"))
    chained = F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get(F.col("s"), i)["bytes_before"] == F.get(F.col("s"), i - 1)["bytes_after"])
    return done.select("doc_id", F.concat_ws(",", F.transform("s", lambda x: x["name"])).alias("stages"), chained.alias("chained"))


@query("""
SELECT * FROM (VALUES
  ('less', 'Metadata'), ('less', 'Thumb')
) t(preset, key)
""")
def probe_stripped_keys(spark, sf):
    left = []
    for p in presets.PRESETS:
        out = documents.entries(_done(spark, p, "metadata").select(F.col("doc_id").alias("path"), F.col("output").alias("content")))
        left.append(out.filter("path[0] in ('Metadata', 'Thumb')").select(F.lit(p).alias("preset"), F.element_at("path", 1).alias("key")).distinct())
    return left[0].union(left[1]).union(left[2])


# ---- formatting, geometry, fonts, presets


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '-' ELSE printf('%.0f%%', c_custkey * 100.0 / (c_custkey % 10 * 1001)) END AS share,
  CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE c_custkey || ' (' || printf('%.0f%%', c_custkey * 100.0 / 997) || ')' END AS cell,
  CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE printf('%.3f', c_custkey / 7.0) END AS score,
  '...' || right(c_name, 9) AS short, CASE WHEN c_custkey % 2 = 0 THEN '/in/' || c_mktsegment ELSE '/out' END || '/' || c_name || '-compressed.pdf' AS target,
  substr(regexp_replace(c_name || ' (' || c_mktsegment || ')/é', '[^\\x21-\\x7e]|[\\[\\](){}<>/%]', '_', 'g'), 1, 127) AS safe,
  CASE WHEN c_custkey % 2 = 0 THEN 'QWERTY+' ELSE 'ABCDEF+' END || c_name AS tagged FROM customer
""")
def report_cells(spark, sf):
    key, name = F.col("c_custkey"), F.col("c_name")
    tagged = F.when(key % 2 == 0, F.concat(F.lit("QWERTY+"), name)).otherwise(name)
    path = F.concat(F.lit("/in/"), "c_mktsegment", F.lit("/"), name, F.lit(".pdf"))
    return table(spark, sf, "customer").select(
        "c_custkey", text.ratio(key, key % 10 * 1001).alias("share"), text.size_cell(F.when(key % 4 != 0, key), F.lit(997)).alias("cell"), text.score_cell(F.when(key % 3 != 0, key / 7.0)).alias("score"),
        text.truncated_left(name, 12).alias("short"), text.output_name(path, F.when(key % 2 != 0, "/out")).alias("target"),
        text.safe_name(F.concat(name, F.lit(" ("), "c_mktsegment", F.lit(")/é"))).alias("safe"), text.with_tag(tagged, F.lit("ABCDEF")).alias("tagged"),
    )


@query("""
WITH b AS (SELECT p_partkey, p_size * 4.0 AS w, p_size * 3.0 AS h FROM part), v AS (
  SELECT *, least(1.0, 50.371 / w) AS x1, least(1.0, 70.4127 / h) AS y1, 10 + w <= 60.371 AND 20 + h <= 90.4127 AS whole FROM b)
SELECT p_partkey, CASE WHEN whole THEN -1.0 ELSE round(x1, 4) END AS x1, CASE WHEN whole THEN -1.0 ELSE round(y1, 4) END AS y1,
  CASE WHEN whole THEN -1 ELSE CAST(least(400, ceil(x1 * 400)) AS BIGINT) END AS px_w, CASE WHEN whole THEN -1 ELSE CAST(300 - floor((1 - y1) * 300) AS BIGINT) END AS px_h,
  round(200 / w, 4) AS fit_a, round(100 / h, 4) AS fit_d, 100.0 AS fit_e,
  CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 = 0 THEN -1.0 WHEN p_partkey % 3 = 0 THEN w WHEN p_partkey % 5 = 0 THEN 300.0 ELSE least(300.0, w) END AS clip_x1 FROM v
""")
def visible_parts(spark, sf):
    w, h = F.col("p_size") * 4.0, F.col("p_size") * 3.0
    part = geometry.visible_part(geometry.matrix(w, 0.0, 0.0, h, 10.0, 20.0), geometry.rect(0.0, 0.0, 60.371, 90.4127))
    df = table(spark, sf, "part").withColumn("v", part)
    px = geometry.crop_pixels(F.col("v"), F.lit(400), F.lit(300))
    onto = geometry.fit(geometry.rect(0.0, 0.0, w, h), geometry.matrix(2.0, 0.0, 0.0, 2.0, 5.0, 5.0), geometry.rect(100.0, 100.0, 300.0, 200.0))
    media = F.when(F.col("p_partkey") % 3 != 0, geometry.rect(0.0, 0.0, 300.0, 400.0))
    clip = geometry.page_clip(media, F.when(F.col("p_partkey") % 5 != 0, geometry.rect(0.0, 0.0, w, 1000.0)))
    none = F.lit(-1.0)
    return df.withColumns({"px": px, "onto": onto, "clip": clip}).select(
        "p_partkey", F.coalesce(_r("v.x1"), none).alias("x1"), F.coalesce(_r("v.y1"), none).alias("y1"), F.coalesce("px.w", F.lit(-1)).alias("px_w"), F.coalesce("px.h", F.lit(-1)).alias("px_h"),
        _r("onto.a").alias("fit_a"), _r("onto.d").alias("fit_d"), _r("onto.e").alias("fit_e"), F.coalesce("clip.x1", none).alias("clip_x1"),
    )


def _lab_sql() -> str:
    product = lambda a, b: [[sum(x * y for x, y in zip(r, c, strict=True)) for c in zip(*b, strict=True)] for r in a]
    whole = product(color.XYZ_TO_SRGB, product(color.BRADFORD_BACK, color.BRADFORD))
    linear = [f"least(greatest({' + '.join(f'({w!r}) * {c}' for w, c in zip(row, 'xyz', strict=True))}, 0), 1)" for row in whole]
    cube = lambda t: f"CASE WHEN {t} >= 6 / 29.0 THEN {t} * {t} * {t} ELSE ({t} - 4 / 29.0) * (108 / 841.0) END"
    curve = lambda v: f"round(CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE pow({v}, 1 / 2.4) * 1.055 - 0.055 END, 4)"
    return f"""
WITH i AS (SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) AS l, CAST(p_size - 25 AS DOUBLE) AS a, CAST(25 - p_size AS DOUBLE) AS b FROM part),
t AS (SELECT p_partkey, (l + 16) / 116 + a / 500 AS tx, (l + 16) / 116 AS ty, (l + 16) / 116 - b / 200 AS tz FROM i),
c AS (SELECT p_partkey, ({cube('tx')}) * {color.D65[0]} AS x, ({cube('ty')}) * {color.D65[1]} AS y, ({cube('tz')}) * {color.D65[2]} AS z FROM t),
o AS (SELECT p_partkey, {linear[0]} AS lr, {linear[1]} AS lg, {linear[2]} AS lb FROM c)
SELECT p_partkey, {curve('lr')} AS r, {curve('lg')} AS g, {curve('lb')} AS b FROM o
"""


@query(_lab_sql())
def lab_colors(spark, sf):
    size = F.col("p_size").cast("double")
    df = table(spark, sf, "part").withColumn("rgb", color.lab_to_srgb(size * 2, size - 25, 25 - size))
    return df.select("p_partkey", *(_r(F.col("rgb")[i]).alias(n) for i, n in enumerate("rgb")))


@query("""
SELECT n_name AS source, CASE WHEN n_nationkey % 4 = 0 THEN 'missing' WHEN n_nationkey % 3 = 0 THEN 'manifest only' WHEN n_regionkey <> n_nationkey % 5 THEN 'stale' ELSE 'ok' END AS status FROM nation
""")
def source_states(spark, sf):
    n = table(spark, sf, "nation")
    own = n.select(F.col("n_name").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("rev"))
    manifest = n.filter("n_nationkey % 4 <> 0").select(F.col("n_name").alias("source"), F.concat(F.lit("r"), F.col("n_nationkey") % 5).alias("rev"))
    return documents.source_status(own, manifest, n.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("source")))


@query("""
SELECT * FROM (VALUES ('less', true, true, true, false, true, true), ('standard', true, true, true, true, true, true), ('more', true, true, true, true, true, true),
  ('less-off', false, false, false, false, true, true), ('standard-off', false, false, false, true, true, true), ('more-off', false, false, false, true, true, true),
  ('less-odd', true, true, true, false, true, false), ('standard-odd', true, true, true, true, true, false), ('more-odd', true, true, true, true, true, false)) t(preset, usage, images, fonts, strip, structure, sane)
""")
def preset_gates(spark, sf):
    """Presets as they are, with everything about images and fonts turned off, and with a target above its threshold."""
    own = presets.presets(spark)
    off = presets.overridden(own, {"bitonal": 0, "continuous": 0, "indexed": 0, "threshold": -1.0, "clip": False, "subset": False, "cff": False, "unembed": False, "quality": None})
    odd = presets.overridden(own, {"target": 500.0})
    out = []
    for p, tag in ((own, ""), (off, "-off"), (odd, "-odd")):
        sane = p.select(F.col("preset").alias("__p"), presets.is_sane(F.col("target"), F.col("threshold")).alias("sane"))
        gates = presets.stage_gates(p).join(sane, F.col("preset") == F.col("__p")).drop("__p")
        out.append(gates.withColumn("preset", F.concat("preset", F.lit(tag))))
    return out[0].union(out[1]).union(out[2])


@query("""
SELECT c_nationkey, coalesce(min(CASE WHEN c_custkey % 3 = 0 THEN c_custkey / 8.0 END), 1.0) AS least FROM customer GROUP BY c_nationkey
""")
def least_scores(spark, sf):
    """A third of the scores are no number, a third are missing."""
    score = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") / 8.0).when(F.col("c_custkey") % 3 == 1, F.lit(float("nan")))
    return table(spark, sf, "customer").withColumn("score", score).groupBy("c_nationkey").agg(compare.least_score().alias("least"))


@query("""
SELECT p_partkey, CAST(list_sum(list_transform(range(0, length(p_name)), lambda i: ascii(substr(p_name, CAST(i + 1 AS INTEGER), 1)) * CASE i % 4 WHEN 0 THEN 16777216 WHEN 1 THEN 65536 WHEN 2 THEN 256 ELSE 1 END)) % 4294967296 AS BIGINT) AS checksum FROM part
""")
def table_checksums(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fonts.checksums(F.col("p_name").cast("binary")).alias("checksum"))


@query("""
SELECT * FROM (VALUES ('A', 65), ('eacute', 233), ('germandbls', 223), ('uni20AC', 8364), ('u1F600', 128512), ('zero', 48), ('quoteright', 8217), ('uniD800', -1), ('nothing', -1), ('fi', 64257)) t(glyph, code)
""")
def glyph_characters(spark, sf):
    names = ["A", "eacute", "germandbls", "uni20AC", "u1F600", "zero", "quoteright", "uniD800", "nothing", "fi"]
    return spark.createDataFrame([(n, glyphs.character(n) if glyphs.character(n) is not None else -1) for n in names], "glyph string, code int")


@query("""
SELECT * FROM (VALUES ('difference', 65, 'alpha'), ('base', 128, 'Euro'), ('base', 65, 'A'), ('standard', 39, 'quoteright'), ('symbolic', 39, '-'), ('mac', 128, 'Adieresis'), ('other', 96, 'quoteleft')) t(how, code, glyph)
""")
def selected_glyphs(spark, sf):
    cases = [("difference", 65, {65: "alpha"}, "WinAnsiEncoding", False), ("base", 128, {65: "alpha"}, "WinAnsiEncoding", False), ("base", 65, {}, "WinAnsiEncoding", True), ("standard", 39, {}, None, False), ("symbolic", 39, {}, None, True), ("mac", 128, {}, "MacRomanEncoding", False), ("other", 96, {}, "StandardEncoding", True)]
    return spark.createDataFrame([(how, code, glyphs.glyph_name(code, own, base, symbolic) or "-") for how, code, own, base, symbolic in cases], "how string, code int, glyph string")
