import hashlib
import random
from functools import reduce

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import brute
from leafmill.llm import passages
from leafmill.llm.common import joined_words


def rows():
    rng = random.Random(5)
    some = [f"w{i}" for i in range(30)]
    base = [rng.choice(some) for _ in range(400)]
    out = []
    for _ in range(150):
        a = rng.randrange(0, 300)
        part = base[a : a + rng.randrange(40, 100)]
        x = [rng.choice(some) for _ in range(rng.randrange(0, 60))] + part + [rng.choice(some) for _ in range(rng.randrange(0, 60))]
        x = rng.choice([x, x, x, ["a"] * rng.randrange(0, 200), part + part, base])
        out.append((rng.randrange(2000, 2120), "  ".join(x)))
    text = " ".join(base)
    return [*out, (None, text), (None, text), (5000, None), (5001, ""), (5002, text), (5002, text), (5003, " \n ")]


def run(df, batches):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.h) for r in passages.dedup(df, batches).withColumn("h", F.sha2("kept", 256)).collect()), key=str)


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, spans string").repartition(8)
    want = sorted(brute.passages(data), key=str)
    assert run(df, 1) == want
    assert run(df, 3) == want


def test_hot_anchors_are_spread(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    got = passages.dedup(df, 4, hot=3).withColumn("h", F.sha2("kept", 256)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.h) for r in got), key=str) == sorted(brute.passages(data), key=str)


def test_runs_are_compacted(spark):
    data = [(i, t) for i, (_, t) in enumerate(rows()[:120])]
    index, found = passages.FingerprintIndex(spark), []
    for k in range(6):
        found.append(index.add(spark.createDataFrame([r for r in data if r[0] // 20 == k], "doc_id long, text string")))
        assert len(index.runs) <= passages.FAN_IN
    kept = spark.table(index.runs[0])
    assert kept.count() == kept.select("print").distinct().count()
    df = spark.createDataFrame(data, "doc_id long, text string")
    spans = passages.spans(reduce(DataFrame.union, found))
    got = passages.without_repeats(df, passages.with_digests(spans, df)).withColumn("h", F.sha2("kept", 256)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.h) for r in got) == sorted(brute.passages(data))
    index.drop()


def test_runs_are_not_shuffled(spark):
    index = passages.FingerprintIndex(spark)
    index.add(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows()[:50])], "doc_id long, text string"))
    probes = spark.range(100).select(F.col("id").alias("spread"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table(index.runs[0]).join(probes, "spread", "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    index.drop()


def test_matches_whose_words_differ_are_left_out(spark):
    words = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, words), (2, words), (3, words.replace("w30", "x"))], "doc_id long, text string")
    marks = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    claimed = spark.createDataFrame([(d, marks[d], 0, 11, 1, marks[1], 0) for d in (2, 3)], passages._MATCH)
    got = passages.without_repeats(df, passages.with_digests(passages.spans(claimed), df)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 60, 3: 0}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert passages.dedup(df).count() == 0
    short = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_removed, r.kept) for r in passages.dedup(short).collect()] == [(2, 0, "a b")]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=200), st.integers(1, 60))
def test_stretches_cover_each_window_once(words, slab):
    anchors, _, firsts, counts, prints = passages.stretches(joined_words(" ".join(words)), slab)
    seen = [(a, w) for a, f, n in zip(anchors, firsts, counts, strict=True) for w in range(f, f + n)]
    assert [w for _, w in seen] == list(range(max(0, len(words) - passages.WINDOW + 1))) and len(prints) == len(seen)
    whole = {}
    for (anchor, w), h in zip(seen, prints, strict=True):
        key = tuple(words[w : w + passages.WINDOW])
        assert whole.setdefault(key, (anchor, h)) == (anchor, h)  # equal windows, equal anchors


def test_kept_words_are_the_text(spark):
    df = spark.createDataFrame([(1, "\tone\n\ntwo  thrée ")], "doc_id long, text string")
    assert passages.dedup(df).first().kept == "one two thrée"
    assert hashlib.sha256(b"").hexdigest() == brute.passages([(1, None)])[0][3]
