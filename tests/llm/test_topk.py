import math
import re

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import topk


def brute(rows, asked, k):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: v for i, v in reversed(ok) if asked(i)}.items()):
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)  # noqa: B905
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


def run(spark, rows, k=5, every=7):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % every == 0, k).collect())), brute(rows, lambda i: i % every == 0, k)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=12).tolist()) for i in rng.permutation(900)]
    rows += [(1000 + i, [0.5] * 12) for i in range(300)]  # ties, and a box without extent
    rows += [(None, [1.0] * 12), (2000, None), (2002, [1.0, None]), (2003, [float("nan")] * 12), (2009, [float("inf")] * 12), (2100, []), (2107, [2.0, -1.0])]
    got, want = run(spark, rows)
    assert got == want


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-(2**22), 2**22, 6) + 0.0).tolist()) for i in range(60)]
    got, want = run(spark, rows)
    assert got == want
    assert max(abs(s) for *_, s in got) > 2**53


def test_tasks_are_as_many_as_lanes_and_bands(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 8)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(3000)], "vec_id long, embedding array<double>")
    plan = topk.top_k(df, F.col("vec_id") % 7 == 0)._jdf.queryExecution().executedPlan().toString()
    # shards times blocks would be 80,625 pairs
    assert max(int(n) for n in re.findall(r"Exchange .*?, (\d+)\), REPARTITION_BY_NUM", plan)) <= topk.SPREAD


def test_lanes_and_bands_and_boxes_that_cut(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 100), ("QUERY_BLOCK", 10), ("LANE_BYTES", 3000), ("BAND_BYTES", 3000), ("SPREAD", 2), ("CHUNK", 16)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(20, 3)) * 4
    rows = [(i, (middle[i % 20] + rng.normal(size=3) / 100).tolist()) for i in range(1200)]
    rows += [(rows[i][0] + 5000, rows[i][1]) for i in range(300)]  # copies: ties across lanes
    rows += [(14, rows[14][1]), (15, rows[3][1])]  # ids again, as a query and as candidates
    got, want = run(spark, rows)
    assert got == want


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0]), (7, [2.0])]) == ([(0, 1, 7, 131072), (7, 1, 0, 131072)],) * 2
    assert run(spark, [(0, [1.0])])[0] == []
    assert run(spark, [(1, [1.0])])[0] == []
    assert run(spark, [])[0] == []


def test_tree_boxes_are_tight_and_hold_all_rows():
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, (1000, 5)).astype(np.int16)
    t = topk.build_tree(v)
    assert sorted(t["order"].tolist()) == list(range(1000))
    for a, b, lo, hi in zip(t["start"], t["end"], t["lo"], t["hi"], strict=True):
        own = v[t["order"][a:b]]
        assert (own.min(0) == lo).all() and (own.max(0) == hi).all()
