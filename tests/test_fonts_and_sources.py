import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.sources import probes as make
from leafmill.functions import fonts
from leafmill.sources import config
from leafmill.sources.objects import FormatError, Name, Text
from leafmill.streaming import files


@given(st.binary(max_size=200), st.sampled_from([fonts.EEXEC, fonts.CHARSTRING]))
def test_ciphers(data, key):
    assert fonts.decipher(fonts.encipher(data, key), key) == data


def test_private_part():
    body = fonts.encipher(b"/Private 1 dict")
    assert fonts.private_part(b"%!\ncurrentfile eexec\n" + body) == b"/Private 1 dict"
    assert fonts.private_part(b"%!\ncurrentfile eexec\n" + body.hex().encode()) == b"/Private 1 dict"
    wrapped = b"\x80\x01\x03\0\0\0abc\x80\x02\x02\0\0\0de\x80\x03"
    assert fonts.without_segments(wrapped) == b"abcde" and fonts.without_segments(b"plain") == b"plain"


def test_font_files(spark):
    rng = random.Random(0)
    tables = {t: rng.randbytes(rng.randrange(1, 99)) for t in (b"glyf", b"head", b"cmap", b"OS/2")}
    font = fonts.build_font(tables)
    assert fonts.tables_of(font) == tables and len(font) % 4 == 0
    assert fonts.checksum(b"\xff\xff\xff\xff\0\0\0\x02") == 1 and fonts.checksum(b"\x01") == 1 << 24
    with pytest.raises(FormatError):
        fonts.tables_of(b"junk" * 9)
    df = spark.createDataFrame([(bytearray(b"\x01"),), (None,)], "t binary")
    assert [r.c for r in df.select(fonts.checksums("t").alias("c")).collect()] == [1 << 24, None]


def test_tags_and_differences():
    assert fonts.subset_tag([3, 1, 2]) == fonts.subset_tag([1, 2, 3, 3]) != fonts.subset_tag([1, 2])
    assert len(fonts.subset_tag([])) == 6 and fonts.subset_tag([9]).isupper()
    assert fonts.differences([65, Name(b"A"), Name(b"B"), 32, Name(b"space")]) == {65: b"A", 66: b"B", 32: b"space"}
    with pytest.raises(FormatError):
        fonts.differences([Text(b"x")])


def test_dictionary_numbers():
    assert fonts.number(0) == b"\x8b" and fonts.number(-107) == b"\x20" and fonts.number(108) == b"\xf7\x00" and fonts.number(-1131) == b"\xfe\xff"
    assert fonts.number(10000) == b"\x1c\x27\x10" and fonts.number(100000) == b"\x1d\x00\x01\x86\xa0" and fonts.number(-2.25) == b"\x1e\xe2\xa2\x5f"


def test_code_maps():
    m = fonts.CodeMap.parse(b"1 begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange 2 begincidrange <20> <30> 100 <8000> <80ff> 500 endcidrange 1 begincidchar <41> 7 endcidchar")
    assert m.numbers(b"\x20\x21\x41\x80\x05\x50") == [100, 101, 7, 505, 0]
    assert fonts.CodeMap.named(b"Identity-H").numbers(b"\x01\x02\x03") == [0x102, 3]
    assert fonts.CodeMap.parse(b"/Identity-H usecmap").numbers(b"\x00\x09") == [9]
    assert fonts.CodeMap.parse(b"1 beginbfrange <0001> <0004> <0010> endbfrange").numbers(b"\x00\x02") == [17]
    for bad in (b"", b"/Other usecmap", b"<0011223344> <01> endcodespacerange"):
        with pytest.raises(FormatError):
            fonts.CodeMap.parse(bad)


def test_configuration(spark, tmp_path):
    at = tmp_path / "c.toml"
    at.write_text('[[source]]\nname="a"\nrev="1"\npaths=["x"]\n[subsets]\nquick=["f1","f2"]\n[[expect]]\nfile="f1"\nreason="known"\n')
    assert config.sources(spark, str(at)).first().name == "a"
    assert config.subsets(spark, str(at)).count() == 2
    assert tuple(config.expectations(spark, str(at)).first()) == ("f1", None, "known")
    assert config.load_manifest(str(tmp_path / "none.json")) == {}
    config.save_manifest(str(tmp_path / "m" / "m.json"), {"a": 1})
    assert config.load_manifest(str(tmp_path / "m" / "m.json")) == {"a": 1}


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    names = ["verbose", "form"]
    data = make.probes()
    run = lambda: files.compress_arriving(spark, str(tmp_path / "in"), "standard", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    for k, name in enumerate(names):
        (tmp_path / "in" / f"{name}.pdf").write_bytes(data[name])
        run()
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.count() == k + 1 and got.filter(F.col("output_bytes") > F.col("input_bytes")).count() == 0
