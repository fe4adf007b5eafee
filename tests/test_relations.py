from pyspark.sql import functions as F

from leafmill.operators import candidates, compare, presets
from leafmill.sources import documents


def test_gates_and_overrides(spark):
    p = presets.presets(spark)
    gates = {r.preset: r for r in presets.stage_gates(p).collect()}
    assert not gates["less"].strip and gates["standard"].strip and all(r.structure and r.images and r.usage for r in gates.values())
    got = presets.overridden(p, {"target": 50, "rgb": None, "strip": 0}).filter("preset = 'more'").first()
    assert (got.target, got.rgb, got.strip) == (50.0, True, 0)
    off = presets.stage_gates(presets.overridden(p, {"bitonal": 0, "continuous": 0, "indexed": 0})).collect()
    assert not any(r.images for r in off)
    sane = p.agg(F.bool_and(presets.is_sane(F.col("target"), F.col("threshold"))).alias("ok"))
    assert sane.first().ok


def test_codecs_follow_the_class(spark):
    p = presets.presets(spark).filter("preset = 'standard'").crossJoin(spark.createDataFrame([("bitonal",), ("indexed",), ("gray",), ("color",)], "class string"))
    got = {r["class"]: r.c for r in p.select("class", presets.codecs_for(F.col("class")).alias("c")).collect()}
    assert got == {"bitonal": 9, "indexed": 3, "gray": 7, "color": 7}


def test_sources_and_their_states(spark):
    sources = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "1")], "source string, rev string")
    manifest = spark.createDataFrame([("b", "1"), ("c", "1"), ("d", "1")], "source string, rev string")
    present = spark.createDataFrame([("c",), ("d",), ("d",)], "source string")
    got = {r.source: r.status for r in documents.source_status(sources, manifest, present).collect()}
    assert got == {"a": "missing", "b": "manifest only", "c": "stale", "d": "ok"}


def test_regressions_and_pages(spark):
    now = spark.createDataFrame([("parse",), ("parse",), ("image",)], "kind string")
    before = spark.createDataFrame([("parse",), ("image",), ("stream",)], "kind string")
    assert [tuple(r) for r in compare.regressions(now, before, "kind").collect()] == [("parse", 1, 2)]
    a, b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "page int, v double"), spark.createDataFrame([(2, 3.0), (3, 1.0)], "page int, v double")
    got = {r.page: r.score for r in compare.pages(a, b, "page", F.col("a.v") / F.col("b.v")).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 0.0}
    scores = spark.createDataFrame([(0.9,), (float("nan"),), (0.95,)], "score double")
    assert scores.agg(compare.least_score().alias("s")).first().s == 0.9
    assert scores.filter("false").agg(compare.least_score().alias("s")).first().s == 1.0


def test_similarity_of_images(spark):
    image = lambda k: spark.createDataFrame([(0, x, y, (x * 7 + y * 3 + k * x * y) % 256) for x in range(20) for y in range(11)], "id int, x int, y int, v int")
    assert compare.similarity(image(0), image(0), ["id"]).first().score == 1.0
    assert compare.similarity(image(0), image(5), ["id"]).first().score < 0.9


def test_ties_go_to_the_first_candidate(spark):
    df = spark.createDataFrame([(1, 5, 2, "b"), (1, 5, 1, "a"), (1, 9, 0, "c"), (1, None, 0, "z"), (2, None, 1, "x")], "k int, size int, rank int, name string")
    got = {r.k: r.name for r in candidates.smallest(df, ["k"], "size", "rank", ["name"]).collect()}
    assert got == {1: "a", 2: "x"}
    taken = df.select(candidates.never_grow(df, F.col("size"), F.lit(5)).alias("t")).collect()
    assert [r.t for r in taken] == [False] * 5
