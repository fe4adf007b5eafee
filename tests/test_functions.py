import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import calculator, color, geometry, sets, text


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_canonical_numbers(spark):
    want = {"+1.50": "1.5", "-0.0": "0", "007": "7", "5.": "5", "-.50": "-.5", "0": "0", "+0.10": ".1", ".": "0", "": None, "1e5": None, "--1": None, "1.2.3": None, "-00012.0": "-12", "-": None}
    df = spark.createDataFrame([(k,) for k in want], "token string")
    got = {r.token: r.c for r in df.select("token", text.canonical_number(F.col("token")).alias("c")).collect()}
    assert got == want
    again = df.select(text.canonical_number(F.col("token")).alias("c")).select("c", text.canonical_number(F.col("c")).alias("d"))
    assert all(r.c == r.d for r in again.collect())


def test_standard_fonts(spark):
    want = {
        "Arial": "Helvetica", "ABCDEF+Arial-BoldMT": "Helvetica-Bold", "Arial,Italic": "Helvetica-Oblique", "TimesNewRomanPSMT": "Times-Roman", "TimesNewRoman,BoldItalic": "Times-BoldItalic",
        "CourierNewPS-BoldItalicMT": "Courier-BoldOblique", "Courier": "Courier", "ArialNarrow": None, "Arial Unicode MS": None, "Symbol": "Symbol", "SymbolMT": None, "ZapfDingbats": "ZapfDingbats",
        "Verdana": None, "abcdef+Arial": None, "Helvetica-Black": None, "Times-Roman": "Times-Roman",
    }
    df = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r.name: r.f for r in df.select("name", text.standard_font(F.col("name")).alias("f")).collect()} == want


def test_unembedding(spark):
    rows = [("Arial", "WinAnsiEncoding", None, True, "Helvetica"), ("Arial", None, None, True, None), ("Arial", None, None, False, "Helvetica"), ("Symbol", None, None, True, "Symbol"), ("Symbol", "WinAnsiEncoding", None, True, None), ("Arial", "Other", None, False, None), ("Arial", "WinAnsiEncoding", False, False, None)]
    df = spark.createDataFrame(rows, "name string, e string, d boolean, s boolean, want string")
    for r in df.select("want", text.can_unembed(F.col("name"), F.col("e"), F.col("d"), F.col("s")).alias("got")).collect():
        assert r.got == r.want


def test_labels(spark):
    got = one(spark, text.human(F.lit(512)), text.human(F.lit(2048)), text.human(F.lit(5 * 2**20)), text.percent(F.lit(200), F.lit(100)), text.percent(F.lit(0), F.lit(5)), text.ratio(F.lit(1), F.lit(4)), text.truncated_left(F.lit("abcdefgh"), 6), text.safe_name(F.lit("a b/c")), text.safe_name(F.lit("")), text.with_tag(F.lit("Arial"), F.lit("QWERTY")), text.output_name(F.lit("a/b.c.pdf"), F.lit(None).cast("string")))
    assert list(got) == ["512 B", "2.0 KiB", "5.0 MiB", "-50.0%", "-", "25%", "...fgh", "a_b_c", "Untitled", "QWERTY+Arial", "a/b.c-compressed.pdf"]


def test_bytes_outside_printable_ascii(spark):
    want = {b"plain": False, b"\x1f": True, b"\x7f": True, b"\x80": True, b"a~ ": False, b"": False, b"\x31\xf1": True}
    df = spark.createDataFrame([(bytearray(k),) for k in want], "b binary")
    assert {bytes(r.b): r.x for r in df.select("b", text.non_ascii_hex(F.hex("b")).alias("x")).collect()} == want


def test_sets(spark):
    assert one(spark, sets.parse(F.lit(" flate, jpeg ,,none"), sets.CODECS), sets.text(F.lit(6), sets.CODECS), sets.text(F.lit(0), sets.CODECS), sets.contains(F.lit(6), 2), sets.contains(F.lit(6), 3)) == (6, "flate|jpeg", "none", True, False)
    with pytest.raises(Exception, match="choose from source"):
        one(spark, sets.parse(F.lit("zip"), sets.CODECS))


def test_colors(spark):
    cmyk = lambda *v: color.cmyk_to_rgb(*map(F.lit, v))
    got = one(spark, cmyk(255, 0, 0, 0), cmyk(0, 0, 0, 0), cmyk(0, 0, 0, 255), color.lab_to_srgb(F.lit(100.0), F.lit(0.0), F.lit(0.0)), color.lab_to_srgb(F.lit(0.0), F.lit(0.0), F.lit(0.0)), color.luma(F.lit(255), F.lit(255), F.lit(255)), color.ycck_to_cmyk(F.lit(0), F.lit(128), F.lit(128), F.lit(9)))
    assert got[0] == [0, 175, 239] and got[1] == [254, 254, 254] and got[2] == [55, 52, 53]
    assert all(abs(v - 1) < 0.01 for v in got[3]) and all(abs(v) < 1e-6 for v in got[4])
    assert got[5] == 255 and got[6] == [255, 254, 254, 9]


def test_whole_ycck_channels_are_exact(spark):
    df = spark.range(256).select(F.col("id").alias("y")).crossJoin(spark.range(256).select(F.col("id").alias("x")))
    y, x = F.col("y"), F.col("x")
    got = df.select("y", "x", color.ycck_to_cmyk(y, x, x, F.lit(9), whole=True).alias("v")).collect()
    cut = lambda v: max(0, min(255, v // 1000))
    want = lambda y, x: [cut(434456 - 1000 * y - 1402 * x), cut(119541 - 1000 * y + 1058 * x), cut(481816 - 1000 * y - 1772 * x), 9]
    assert len(got) == 65536 and all(r.v == want(r.y, r.x) for r in got)


def test_color_query_where_sums_are_whole(spark, tmp_path):
    import duckdb

    from leafmill.plans import catalog

    keys = spark.range(256).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), F.lit(128).cast("long").alias("l_suppkey"))
    keys.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalog.QUERIES["color_kernels"](spark, str(tmp_path))
    want = db.execute(catalog.ORACLE_SQL["color_kernels"]).df()
    assert sorted(map(tuple, got.collect())) == sorted(want[got.columns].itertuples(index=False, name=None))


def test_geometry(spark):
    m = geometry.matrix(2, 0, 0, 3, 10, 20)
    box = geometry.unit_square(m)
    back = geometry.apply(geometry.invert(m), F.lit(12.0), F.lit(23.0))
    got = one(
        spark, box, back[0], back[1], geometry.invert(geometry.matrix(1, 2, 2, 4, 0, 0)), geometry.visible_part(m, geometry.rect(10, 20, 11, 23)), geometry.visible_part(m, geometry.rect(0, 0, 100, 100)),
        geometry.visible_part(m, geometry.rect(0, 0, 1, 1)), geometry.crop_pixels(geometry.rect(0.0, 0.0, 0.5, 1.0), F.lit(400), F.lit(400)), geometry.crop_pixels(geometry.rect(0.0, 0.0, 1.0, 1.0), F.lit(4), F.lit(4)),
        geometry.scaled_size(F.lit(10), F.lit(0.25)), geometry.scaled_size(F.lit(1), F.lit(0.1)), geometry.transformed(geometry.rect(0, 0, 4, 2), geometry.fit(geometry.rect(0, 0, 4, 2), geometry.matrix(*geometry.IDENTITY), geometry.rect(5, 5, 6, 9))),
    )
    assert tuple(got[0]) == (10, 20, 12, 23) and (got[1], got[2]) == (1, 1) and got[3] is None
    assert tuple(got[4]) == (0, 0, 0.5, 1) and got[5] is None and tuple(got[6]) == (0, 0, 0, 0)
    assert tuple(got[7]) == (0, 0, 200, 400) and got[8] is None and (got[9], got[10]) == (3, 1)
    assert tuple(got[11]) == (5, 5, 6, 9)


PROGRAMS = [
    "{ add 2 div }", "{ exch sub abs neg }", "{ 2 copy gt { exch } if pop }", "{ 2 copy eq { pop pop 1 } { div } ifelse }", "{ idiv }", "{ mod }", "{ atan }", "{ exch cvi exch cvi bitshift }",
    "{ 1 2 3 5 -1 roll pop pop pop pop }", "{ 1 index add exch pop }", "{ cvi exch cvi and }", "{ cvi exch cvi xor not }", "{ 0 gt exch 0 gt and { 1 } { 0 } ifelse }", "{ sin exch cos mul }",
    "{ abs sqrt exch abs 1 add ln add }", "{ truncate exch round add }", "{ floor exch ceiling add }", "{ true exch pop { 3 } { 4 } ifelse }", "{ le not { 5 } { 6 } ifelse }", "{ 3 exch 2 roll pop }",
]


def test_compiled_programs_as_the_machine(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(40)] + [(0.0, 0.0), (3.0, 0.0), (0.0, -2.0), (2.5, -2.5), (-7.0, 2.0), (7.0, -2.0), (40.0, 3.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    for source in PROGRAMS:
        try:
            out = calculator.program(source, [F.col("x"), F.col("y")], [-100, 100, -100, 100], [-1e30, 1e30])[0]
        except calculator.ProgramError as e:
            assert "roll" in source and "depends" in str(e)
            continue
        for r in df.select("x", "y", out.alias("out")).collect():
            want = calculator.Machine(source).run([r.x, r.y])[-1]
            if math.isnan(want):
                assert r.out is None or math.isnan(r.out) or abs(r.out) == 1e30
            else:
                assert r.out == pytest.approx(min(max(want, -1e30), 1e30), abs=1e-9), (source, r)


def test_roll_and_errors(spark):
    assert calculator.Machine("{ 3 -1 roll }").run([1, 2, 3]) == [2, 3, 1]
    assert calculator.Machine("{ 3 1 roll }").run([1, 2, 3]) == [3, 1, 2]
    for bad in ("add", "{ add", "{ nonsense }", "{ 1 } { 2 }", "}", "{ { 1 } }"):
        with pytest.raises(calculator.ProgramError):
            calculator.program(bad, [F.lit(1.0)], [0, 1], [0, 1])
    with pytest.raises(calculator.ProgramError):
        calculator.program("{ true }", [F.lit(1.0)], [0, 1], [0, 1])


def test_sampled(spark):
    got = one(spark, *(calculator.sampled(F.lit(x), [0, 1], [0, 100, 255], 3, 8, [0, 2], [0, 1]) for x in (0.0, 0.25, 0.5, 1.0, 9.0)))
    assert [round(v, 6) for v in got] == [0, round(50 / 255, 6), round(100 / 255, 6), 1, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-20, 20), min_size=3, max_size=3), st.integers(-7, 7))
def test_rolling_back_gives_the_same(values, by):
    assert calculator.Machine(f"{{ 3 {by} roll 3 {-by} roll }}").run(values) == values
