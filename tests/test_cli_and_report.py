from pathlib import Path

import pytest

from leafmill.sources import probes as make
from leafmill import cli, report
from leafmill.operators.presets import PRESETS
from leafmill.sources.objects import read


def test_settings():
    parse = lambda *a: cli.settings(cli.parser().parse_args(["x.pdf", *a]))
    assert parse() == PRESETS["standard"] and parse("--less") == PRESETS["less"]
    got = parse("--more", "--dpi", "50", "--no-rgb", "--strip", "threads", "--bitonal-codecs", "none")
    assert (got["target"], got["rgb"], got["strip"], got["bitonal"], got["threshold"]) == (50, False, "threads", "", 110)
    with pytest.raises(SystemExit):
        parse("--dpi", "500")
    with pytest.raises(SystemExit):
        parse("--less", "--more")
    with pytest.raises(SystemExit):
        parse("--bitonal-codecs", "zip")


def test_targets(tmp_path):
    assert cli.target(Path("a/b.pdf"), None, False) == Path("a/b-compressed.pdf")
    assert cli.target(Path("a/b.pdf"), Path("o.pdf"), False) == Path("o.pdf")
    assert cli.target(Path("a/b.pdf"), Path("out"), True) == Path("out/b-compressed.pdf")
    assert cli.target(Path("a/b.pdf"), tmp_path, False) == tmp_path / "b-compressed.pdf"


def test_run(spark, tmp_path, capsys):
    data = make.probes()
    good, bad = tmp_path / "good.pdf", tmp_path / "bad.pdf"
    good.write_bytes(data["gray-rgb-300dpi"])
    bad.write_bytes(b"nothing")
    assert cli.main([str(good), "--dry-run"]) == 0 and not (tmp_path / "good-compressed.pdf").exists()
    assert cli.main([str(good), str(bad), str(tmp_path / "none.pdf"), "-o", str(tmp_path / "out")]) == 1
    made = (tmp_path / "out" / "good-compressed.pdf").read_bytes()
    assert len(made) < len(data["gray-rgb-300dpi"]) and read(made)
    said = capsys.readouterr().out
    assert "reduced+downsampled" in said and "refused" in said and "structure" in said
    assert not (tmp_path / "out" / "bad-compressed.pdf").exists()


def test_score_table(spark):
    rows = spark.createDataFrame([("a.pdf", 1000, 500, 0.98, 400), ("b" * 70 + ".pdf", 2000, None, None, 1000), ("c.pdf", 100, 100, 0.9, None)], "file string, input bigint, ours bigint, ssim double, tool bigint")
    lines = report.score_table(rows, ["tool"]).split("\n")
    assert lines[1].split() == ["a.pdf", "1000", "500", "(50%)", "0.980", "400", "(40%)"]
    assert lines[2].startswith("...") and lines[4].split() == ["total", "3100", "600", "(55%)", "0.900", "400", "(40%)"]
    assert lines[5].split() == ["coverage", "1/3", "ours", "50%"]


def test_references(spark):
    found = spark.createDataFrame([("x-less",), ("x-standard",), (".hidden-less",), ("y",)], "name string")
    names = lambda *a, **k: [r.name for r in report.references_for(found, "less", *a, **k).collect()]
    assert names() == ["x-less"] and names("y") == ["y"] and names(explicit=True) == ["x-less", "x-standard", "y"]
