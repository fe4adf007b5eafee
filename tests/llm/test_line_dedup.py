import random

from pyspark.sql import functions as F

import brute
from leafmill.llm import line_dedup


def rows():
    rng = random.Random(1)
    lines = [f"line {i}" for i in range(60)] + ["", " menu ", "menu", "\tfooter\r", "footer"]
    out = [(i, rng.choice(["a", "b", "c", None]), "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for i in range(300)]
    return [*out, (300, "a", None), (301, None, ""), (302, "z", "alone"), (303, "a", "menu\nmenu\nmenu"), (303, "a", "menu\nmenu\nmenu")]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 9) for r in data], "doc_id long, source string, text string, n_removed int").repartition(4)
    for ratio, least in ((0.05, 3), (0.2, 2), (0.9, 1)):
        got = line_dedup.drop_boilerplate(df, F.col("source"), ratio=ratio, least=least)
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute.line_dedup(data, ratio, least), key=str)
        for r in got.collect():
            kept = 0 if r.text is None else r.text.count("\n") + 1
            assert r.n_lines - r.n_removed in (kept, 0 if r.text == "" else kept)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert line_dedup.drop_boilerplate(df, F.col("source")).count() == 0


def test_host_of(spark):
    urls = {"https://www.Example.org:8080/a?b": "example.org", "http://u:p@x.com": "x.com", "//cdn.net/x": "cdn.net", "no url": "", None: None}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.h for r in df.select("url", line_dedup.host_of(F.col("url")).alias("h")).collect()} == urls


def test_pages_by_host(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 2}.org/{i}", f"top\nown {i}") for i in range(20)], "page_id long, url string, body string")
    got = line_dedup.drop_boilerplate(df, line_dedup.host_of(F.col("url")), text="body").collect()
    assert {r.page_id: r.body for r in got} == {i: f"own {i}" for i in range(20)}
