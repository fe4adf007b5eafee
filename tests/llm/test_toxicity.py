import random

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import toxicity as tx


def corpus(n=1500, seed=0):
    rng = random.Random(seed)
    some = [f"wo{rng.getrandbits(24):x}" for _ in range(800)]
    some = ["".join(c if c.isalpha() else "q" for c in w) for w in some]
    docs, labels = [], []
    for d in range(n):
        words = [rng.choice(some) for _ in range(rng.randrange(20, 150))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zargle", "blorpf", "frumpok", "idiot", "m0r0n"]))
        docs.append((d, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((d, 1, int(toxic)))
    return docs, labels, None


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy_and_calibration(spark):
    docs, labels, _ = corpus()
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double").repartition(4)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    model = tx.fit(df, lab, tx.learnable(F.col("id")))
    got = {r.doc_id: r.score for r in tx.scores(df, model).collect()}
    held = {d: t for d, _, t in labels if __import__("zlib").crc32(str(d).encode()) % 5 == 0}
    s, y = np.array([got[d] for d in held]), np.array(list(held.values()))
    assert auc(s, y) > 0.97
    assert ((s >= 0.5) == (y == 1)).mean() > 0.95
    assert ((s >= 0) & (s <= 1)).all() and abs(s.mean() - y.mean()) < 0.06


def test_edges(spark):
    docs, labels, _ = corpus(300, 1)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = tx.fit(df, lab, tx.learnable(F.col("id")))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (4, "you " * 50_000), (4, "you"), (5, "i d i o t !!!! @$$"), (6, "\x00 ÄÖ 漢")], "doc_id long, text string")
    rows = tx.scores(odd, model, ["doc_id"]).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tx.scores(none, model).count() == 0
    empty = tx.fit(df, lab.filter("false"), tx.learnable(F.col("id")))
    assert {r.score for r in tx.scores(df, empty, ["doc_id"]).collect()} == {0.0}
    same = tx.fit(df, lab.filter("toxic = 1"), tx.learnable(F.col("id")))
    assert {r.score for r in tx.scores(df, same, ["doc_id"]).collect()} == {1.0}
    assert tx.fit(none, lab, tx.learnable(F.col("id"))).share == 0.0


def test_isotonic_fit():
    x, y = tx.isotonic(np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert y.tolist() == sorted(y.tolist()) and np.allclose(np.interp([1, 2], x, y), 0.5, atol=0.5)
    assert abs(y[0]) < 1e-9 and y[-1] == 1


def test_trees_learn_a_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 1] > 0.3).astype(float)
    raw = tx.Trees(x, y).raw(x)
    assert auc(raw, y) > 0.99


def test_plain_words():
    assert tx.plain("m0r0n") == "moron" and tx.plain("i.d.i.o.t") == "idiot" and tx.plain("word") is None and tx.plain("1234") is None
