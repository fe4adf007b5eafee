import random
import time

from leafmill.operators import graph, lookup, ordered, usage
from pyspark.sql import functions as F


def test_reachable_on_random_graphs_with_cycles(spark):
    rng = random.Random(6)
    edges = [(d, rng.randrange(30), rng.randrange(30)) for d in range(4) for _ in range(40)]
    got = {(r.doc, r.id) for r in graph.reachable(spark.createDataFrame(edges, "doc int, src int, dst int"), spark.createDataFrame([(d, 0) for d in range(4)], "doc int, id int")).collect()}
    want = set()
    for d in range(4):
        todo = [0]
        while todo:
            x = todo.pop()
            if (d, x) not in want:
                want.add((d, x))
                todo += [b for e, a, b in edges if e == d and a == x]
    assert got == want


def test_dedupe_to_a_fixpoint_and_again(spark):
    # two equal chains, and a cycle of two that stays
    objects = [(0, i, b) for i, b in enumerate(["leaf", "leaf", "mid", "mid", "top", "top", "p", "q"])]
    edges = [(0, 2, "k", 0), (0, 3, "k", 1), (0, 4, "k", 2), (0, 5, "k", 3), (0, 6, "k", 7), (0, 7, "k", 6)]
    o = spark.createDataFrame(objects, "doc int, id int, body string")
    e = spark.createDataFrame(edges, "doc int, src int, slot string, dst int")
    got = {r.id: r.keep for r in graph.dedupe_fixpoint(o, e).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {r.id: r.keep for r in graph.dedupe_fixpoint(o, e, 1).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}


def test_dangling_and_prune(spark):
    objects = spark.createDataFrame([(0, i) for i in (1, 2, 5)], "doc int, id int")
    edges = spark.createDataFrame([(0, 1, 5), (0, 5, 9), (0, 2, 1)], "doc int, src int, dst int")
    assert [tuple(r) for r in graph.dangling(edges, objects).collect()] == [(0, 5, 9)]
    assert graph.without_dangling(edges, objects).count() == 2
    kept = graph.prune(objects, edges, spark.createDataFrame([(0, 1)], "doc int, id int"))
    assert {(r.id, r.new) for r in kept.collect()} == {(1, 1), (5, 2)}


def test_default_appearance_strings(spark):
    want = {"/Helv 12 Tf 0 g": ["Helv"], "/Helv  12 Tf": [], "0 g /A 1 Tf /B 2 Tf": ["A", "B"], "": [], "Tf": [], "x 1 Tf": [], "/A\n1\tTf": ["A"]}
    df = spark.createDataFrame([(k,) for k in want], "da string")
    assert {r.da: r.f for r in df.select("da", ordered.appearance_fonts(F.col("da")).alias("f")).collect()} == want


def test_long_default_appearances_take_time_in_proportion(spark):
    name = "N" * 3000
    long = "/A 1 Tf " + "w " * 100_000 + f"/{name} 2 Tf"
    df = spark.createDataFrame([(long,), (None,)], "da string")
    began = time.perf_counter()
    assert [r.f for r in df.select(ordered.appearance_fonts(F.col("da")).alias("f")).collect()] == [["A", name], None]
    assert time.perf_counter() - began < 60


def test_triples_of_null_texts(spark, tmp_path):
    from leafmill.plans import catalog

    spark.createDataFrame([(1, None), (2, "a b the c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, catalog.QUERIES["triples"](spark, str(tmp_path)).collect())) == [(1, ""), (2, "a")]


def test_resolution_and_boxes(spark):
    df = spark.createDataFrame([(600, 600, 144.0, 288.0), (600, 600, 72.0, 0.0)], "w int, h int, pw double, ph double")
    assert df.limit(1).agg(usage.min_resolution(*map(F.col, ("w", "h", "pw", "ph"))).alias("d")).first().d == 150.0
    assert df.agg(usage.min_resolution(*map(F.col, ("w", "h", "pw", "ph"))).alias("d")).first().d == 150.0
    assert df.filter("false").agg(usage.min_resolution(*map(F.col, ("w", "h", "pw", "ph"))).alias("d")).first().d is None


def test_first_range_wins(spark):
    rows = spark.createDataFrame([(i,) for i in range(0, 40)], "v int")
    ranges = spark.createDataFrame([(0, 5, 12, "a"), (1, 10, 30, "b")], "ordinal int, low int, high int, r string")
    got = {r.v: r.r for r in lookup.range_join(rows, "v", ranges, 7).collect()}
    assert got == {v: "a" if 5 <= v <= 12 else "b" if 10 <= v <= 30 else None for v in range(40)}


def test_resource_categories(spark):
    df = spark.createDataFrame([(o,) for o in ("Do", "Tf", "gs", "CS", "scn", "sh", "BDC", "re")], "o string")
    assert [r.c for r in df.select(usage.resource_category(F.col("o")).alias("c")).collect()] == ["XObject", "Font", "ExtGState", "ColorSpace", "Pattern", "Shading", "Properties", None]
