import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.sources import probes as make
from leafmill.functions.color import cmyk_to_rgb
from leafmill.operators import stages
from leafmill.operators.presets import PRESETS
from leafmill.sources import documents
from leafmill.sources.objects import FormatError, Name, Ref, Stream, Text, canonical, content_of, operations, read, smaller, spell, write

PROBES = make.probes()


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in PROBES.items()] + [("junk", bytearray(b"not a document")), ("none", None)], "path string, content binary").repartition(4)


def image_of(data: bytes) -> Stream:
    return next(x for x in read(data).objects.values() if isinstance(x, Stream) and x.dict.get(b"Subtype") == b"Image")


@pytest.mark.parametrize("name", PROBES)
@pytest.mark.parametrize("preset", PRESETS)
def test_every_probe_stays_whole_and_never_grows(name, preset):
    out, report, refusal = stages.compress(PROBES[name], preset)
    assert refusal is None and len(out) <= len(PROBES[name])
    assert stages.verify(out, 1) == []
    assert all(r["bytes_out"] <= r["bytes_in"] for r in report.images)
    assert [s["bytes_before"] for s in report.stages[1:]] == [s["bytes_after"] for s in report.stages[:-1]]


def test_gray_rgb_is_reduced_and_downsampled():
    out, report, _ = stages.compress(PROBES["gray-rgb-300dpi"], "standard")
    assert report.images[0]["action"] == "reduced+downsampled" and report.images[0]["dpi"] == 300
    x = image_of(out).dict
    assert x[b"ColorSpace"] == b"DeviceGray" and x[b"Width"] == 150


def test_clipped_image_is_cropped():
    out, report, _ = stages.compress(PROBES["clipped"], "standard")
    assert "clipped" in report.images[0]["action"]
    doc = read(out)
    wrapped = next(x for x in doc.objects.values() if isinstance(x, Stream) and x.dict.get(b"Subtype") == b"Form")
    assert image_of(out).dict[b"Width"] <= 200 and b"/Im Do" in content_of(doc, wrapped)


def test_duplicates_merge_and_unused_go():
    images = lambda data: [x for x in read(data).objects.values() if isinstance(x, Stream) and x.dict.get(b"Subtype") == b"Image"]
    assert len(images(stages.compress(PROBES["duplicates"], "less")[0])) == 1
    out = stages.compress(PROBES["unused"], "less")[0]
    assert len(images(out)) == 1 and b"Helvetica" not in b"".join(spell(x) for x in read(out).objects.values() if not isinstance(x, Stream))


def test_metadata_goes_with_standard_only():
    text = lambda p: b"".join(spell(x if not isinstance(x, Stream) else x.dict) for x in read(stages.compress(PROBES["metadata"], p)[0]).objects.values())
    assert b"Metadata" in text("less") and b"Thumb" in text("less")
    assert b"Metadata" not in text("standard") and b"Thumb" not in text("standard")


def test_content_is_shortened_and_inline_images_are_not():
    doc = read(stages.compress(PROBES["verbose"], "less")[0])
    assert stages.page_content(doc, stages.pages_of(doc)[0]).startswith(b".5 0 50 50 re f 1.5 1 50 50 re f")
    doc = read(stages.compress(PROBES["inline"], "less")[0])
    assert b"ID abcd EI" in stages.page_content(doc, stages.pages_of(doc)[0])


def test_canonical_content_is_stable():
    for source in (b"1 0 0 1 0.50 00 cm /F1  12.0 Tf (a (b) \\) c) Tj <4 1> Tj [ (x) -120 <00> ] TJ", b"/GS0 gs q Q", b"<< /A 1.0 >> BDC", b"true false null x"):
        once = stages.canonical_content(source)
        assert once is not None and operations(once) == operations(source) and stages.canonical_content(once) == once and len(once) <= len(source)
    for bad in (b"1 2", b"(open", b"BI ID x EI", b"<< /A"):
        assert stages.canonical_content(bad) is None


def test_usage(table):
    rows = {r.doc_id: r for r in documents.placements(table).collect()}
    assert rows["gray-rgb-300dpi"].width_pt == 72 and rows["gray-rgb-300dpi"].crop is None
    assert [round(v, 4) for v in rows["clipped"].crop] == [0, 0, 0.5, 1]
    assert (rows["form"].width_pt, rows["form"].height_pt) == (144, 72)
    shown = documents.shown_strings(table).collect()
    assert [(r.doc_id, [bytes(s) for s in r.strings]) for r in shown] == [("form", [b"hello"])]


def test_tables(table):
    objects, edges, entries, pages = (f(table) for f in (documents.objects, documents.edges, documents.entries, documents.pages))
    assert {r.doc_id for r in pages.collect()} == set(PROBES) and pages.count() == len(PROBES)
    assert objects.filter("subtype = 'Image'").groupBy("doc_id").count().filter("doc_id = 'duplicates'").first()["count"] == 2
    ids = objects.select("doc_id", F.col("num").alias("dst_num"))
    assert edges.join(ids, ["doc_id", "dst_num"], "left_anti").count() == 0
    assert entries.filter("kind = 'reference'").count() == edges.filter("src_num > 0").count()
    equal = objects.filter("subtype = 'Image'").groupBy("doc_id", "canonical").count().filter("count > 1").collect()
    assert [r.doc_id for r in equal] == ["duplicates"]
    ops = documents.content_operations(table.filter("path = 'form'")).orderBy("seq").collect()
    assert [r.operator for r in ops] == ["q", "cm", "Do", "Q", "Tf", "Tj"]


def test_compressing_a_table(table):
    done = documents.compressed(table, "standard").cache()
    assert {r.doc_id: r.refusal is None for r in done.collect()} == {k: True for k in PROBES} | {"junk": False, "none": False}
    assert done.filter("refusal is not null and output_bytes <> input_bytes").count() == 0
    assert all(r.ok == (r.doc_id not in ("junk", "none")) for r in documents.outcome(done).collect())
    assert documents.totals(done).first().refused == 2
    assert documents.image_rows(done).count() >= 9 and documents.stage_rows(done).count() == 4 * len(PROBES)


def test_guards():
    doc = make.page(b"q Q")
    doc.trailer[b"Encrypt"] = {b"V": 1}
    with pytest.raises(stages.Refusal, match="password"):
        stages.guard(doc)
    doc = make.page(b"q Q")
    doc.objects[Ref(2, 0)][b"Kids"] = [Ref(99, 0)]
    with pytest.raises(stages.Refusal, match="page tree"):
        stages.guard(doc)
    doc = make.page(b"q Q", {b"Font": {b"F": Ref(77, 0)}})
    with pytest.raises(stages.Refusal, match="resources"):
        stages.guard(doc)
    doc = make.page(b"q Q")
    doc.add({b"Resources": {b"Font": {b"F": Ref(77, 0)}}})  # damage that nothing reaches
    stages.guard(doc)


def test_both_forms_and_a_broken_table_read_the_same():
    doc = read(PROBES["form"])
    want = {r: canonical(x) for r, x in doc.objects.items()}
    for bundled in (False, True):
        data = write(doc, bundled)
        assert {r: canonical(x) for r, x in read(data).objects.items()} == want
        at = data.rfind(b"startxref")
        broken = data[:at] + b"startxref\n7\n%%EOF"
        assert {r: canonical(x) for r, x in read(broken).objects.items()} == want
    assert len(smaller(doc)[0]) == min(len(write(doc, b)) for b in (True, False))
    assert smaller(doc, b"x") == (b"x", "kept")


def test_values_round_trip():
    rng = random.Random(0)

    def value(depth=0):
        kind = rng.randrange(9 if depth < 3 else 7)
        if kind < 7:
            return [None, True, rng.randrange(-999, 999), Name(bytes(rng.randrange(33, 255) for _ in range(4))), Text(bytes(rng.randrange(256) for _ in range(9))), Ref(rng.randrange(1, 99), 0), 2.5][kind]
        return [value(depth + 1) for _ in range(3)] if kind == 7 else {bytes([65 + i]): value(depth + 1) for i in range(3)}

    from leafmill.sources.objects import Parser

    for _ in range(300):
        v = value()
        assert canonical(Parser(spell(v) + b" ").value()) == canonical(v)
    for bad in (b"", b"[1", b"<</A", b"(x", b"nonsense", b">>"):
        with pytest.raises(FormatError):
            Parser(bad).value()


def test_prediction_and_flate_round_trip():
    for r in (stages.Raster("rgb", make.photo(37, 21)), stages.Raster("gray", make.photo(50, 3, 1)), stages.Raster("bitonal", (make.photo(19, 9, 1) > 99).astype(np.uint8) * 255), stages.Raster("gray", make.photo(1, 1, 1))):
        body, head = stages.encode_image(r)
        space = {"rgb": b"DeviceRGB"}.get(r.kind, b"DeviceGray")
        doc = make.page(b"")
        back = stages.decode_image(doc, Stream(head | {b"ColorSpace": Name(space)}, body))
        assert back.kind == r.kind and (back.data == r.data).all()
        forced = stages.zlib.compress(stages.predicted(r), 9)
        parms = {b"Predictor": 15, b"Colors": r.data.shape[2], b"BitsPerComponent": head[b"BitsPerComponent"], b"Columns": r.size[0]}
        again = stages.decode_image(doc, Stream(head | {b"ColorSpace": Name(space), b"Filter": Name(b"FlateDecode"), b"DecodeParms": parms}, forced))
        assert (again.data == r.data).all()


def test_resizing():
    flat = stages.Raster("gray", np.full((40, 60, 1), 77, np.uint8))
    assert (stages.resize_raster(flat, 15, 10).data == 77).all() and stages.resize_raster(flat, 60, 40) is None
    lines = np.full((40, 40, 1), 255, np.uint8)
    lines[::4] = 0
    half = stages.resize_raster(stages.Raster("bitonal", lines), 20, 20)
    assert (half.data == 0).any()  # a line of one pixel lives through halving
    index = stages.Raster("indexed", (np.indices((8, 8)).sum(0) % 4).astype(np.uint8)[..., None])
    assert set(np.unique(stages.resize_raster(index, 3, 3).data)) <= {0, 1, 2, 3}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(PROBES["form"])
    (tmp_path / "y.pdf").write_bytes(b"%PDF-junk")
    (tmp_path / "z.txt").write_bytes(b"")
    found = documents.files(spark, str(tmp_path))
    assert found.count() == 2 and found.filter(documents.is_document(F.col("content"))).count() == 2
    assert "content" not in documents.sizes(spark, str(tmp_path)).columns


def test_codecs_are_the_presets_own():
    actions = {p: {n: stages.compress(PROBES[n], p)[1].images[0]["action"] for n in ("bitonal-lines", "indexed", "gray-rgb-300dpi")} for p in PRESETS}
    assert actions["less"]["indexed"] == "kept: class excluded"
    assert all(a == "kept: no codec at hand" for p in ("less", "more") for n, a in actions[p].items() if n == "bitonal-lines")
    assert "downsampled" in actions["standard"]["bitonal-lines"] and "downsampled" in actions["more"]["indexed"]


def test_cmyk_becomes_rgb_where_the_preset_says_so(spark):
    own = PRESETS["more"] | {"continuous": "flate,source"}
    out, report, refusal = stages.compress(PROBES["cmyk"], own)
    assert refusal is None and "rgb" in report.images[0]["action"] and image_of(out).dict[b"ColorSpace"] == b"DeviceRGB"
    assert "rgb" not in stages.compress(PROBES["cmyk"], own | {"rgb": False})[1].images[0]["action"]
    rng = np.random.default_rng(1)
    ink = rng.integers(0, 256, (1, 50, 4)).astype(np.uint8)
    want = spark.createDataFrame([tuple(map(int, x)) for x in ink[0]], "c int, m int, y int, k int").select(cmyk_to_rgb(*map(F.col, "cmyk")).alias("rgb")).collect()
    assert stages.cmyk_raster_to_rgb(stages.Raster("cmyk", ink)).data[0].tolist() == [r.rgb for r in want]


def test_problems_count_by_category():
    old = [f"page {i}: content stream: x" for i in range(60)]
    assert stages.regressed(old, old) == []
    assert stages.regressed([*old, "page 60: content stream: x"], old) == [("content_stream", 61, 60)]
    assert stages.regressed(["object 3: stream: x"], old) == [("stream", 1, 0)]


def test_stages_that_a_preset_turns_off_are_listed():
    none = PRESETS["less"] | {"continuous": "", "bitonal": "", "subset": False, "unembed": False, "threshold": -1.0}
    report = stages.compress(PROBES["gray-rgb-300dpi"], none)[1]
    assert [s["name"] for s in report.stages] == ["images", "fonts", "strip", "structure"] and report.images == []
    assert all(s["bytes_before"] == s["bytes_after"] for s in report.stages[:3])
