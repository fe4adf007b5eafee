from pyspark.sql import functions as F

from leafmill.functions import glyphs


def test_characters():
    want = {"A": "A", "eacute": "é", "Ntilde": "Ñ", "germandbls": "ß", "space": " ", "zero": "0", "quoteright": "’", "uni00E9": "é", "u1F600": "😀", "scaron": "š", "fi": "ﬁ", "asciitilde": "~", "Euro": "€"}
    assert {n: chr(glyphs.character(n)) for n in want} == want
    assert all(glyphs.character(n) is None for n in ("nonsense", "uniD800", "uni12", "u110000", "xtilde1", "", "qacute"))


def test_encodings():
    win, mac, std = (glyphs.encoding(n) for n in ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding"))
    assert (win[0x80], win[0xE9], win[0xA0], win[0xAD], win[0x81], win[0x27]) == ("Euro", "eacute", "space", "hyphen", "bullet", "quotesingle")
    assert (mac[0x8E], mac[0x41], mac[0xA5]) == ("eacute", "A", "bullet")
    assert (std[0x27], std[0x60], std[0xA1], std[0xAF], std[0xFB], std[0x41]) == ("quoteright", "quoteleft", "exclamdown", "fl", "germandbls", "A")
    assert len(std) == 149 and all(glyphs.character(n) for n in std.values())


def test_names_by_code():
    assert glyphs.glyph_name(65, {65: "Alpha"}, "WinAnsiEncoding", False) == "Alpha"
    assert glyphs.glyph_name(0xE9, {}, "WinAnsiEncoding", True) == "eacute"
    assert glyphs.glyph_name(65, {}, None, False) == "A" and glyphs.glyph_name(65, {}, None, True) is None
    assert glyphs.glyph_order(["x", ".notdef", "A", "B"], {66: "B", 70: "A", 65: "A"}) == [".notdef", "A", "B", "x"]


def test_used_codes(spark):
    df = spark.createDataFrame([([bytearray(b"ba"), bytearray(b"\xffb"), bytearray(b"")],), ([],)], "s array<binary>")
    assert [r.c for r in df.select(glyphs.used_codes(F.col("s")).alias("c")).collect()] == [[97, 98, 255], []]
