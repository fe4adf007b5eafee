import random
import time

from pyspark.sql import functions as F

import brute
from leafmill.llm import pii

PARTS = ["a@b.co", "x_", "@", "foo.bar+z@ex-a.mple.org.", "1.2.3.4", "256.1.1.1", "001.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+33 1 23 45 67 89"]
PARTS += [" ", "é", "𝒳", "漢", "\n", ".", "..", "a", " 12", "0", "+1", "(", "-", "--", "@b.c", "call ", "9" * 30, "1.1.1.1.1.1.1.1.1", "a@b", "a@b.c_d@e.f", "words", "jo at example dot com", "(212) 555-1234", "2001:db8:0:0:0:0:0:1", "token = "]


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    return [*out, None, "", "a" * 20_000, "1" * 20_000, "a@b.co " * 1500, "1.2.3.4 " * 700, "a." * 8_000 + "@" + "b." * 8_000, "1-" * 8_000]


def test_base_spans_against_brute_force(spark):
    data = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(data)], "doc_id long, text string, cands string").repartition(16)
    got = pii.personal_data(df).select("*", F.sha2(pii.span_text(F.col("base_spans")), 256).alias("digest")).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.digest == brute.base_digest(data[r.doc_id]), data[r.doc_id][:200]
        spans = [(s.start, s.kind, s.end) for s in r.all_spans]
        base = brute.base_spans(data[r.doc_id])
        assert set(base) <= set(spans) and spans == sorted(spans)
        for s, _, e in set(spans) - set(base):
            assert all(e <= a or z <= s for a, _, z in base)


def test_the_method_adds_spans(spark):
    rows = [(i, f"call me: (212) 555-{i:04d}, or mail jo{i} at example dot com") for i in range(50)] + [(50 + i, f"a@b{i}.com +1 (743) 555-{i:04d}") for i in range(50)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(len(r.all_spans) > len(r.base_spans) for r in got if r.doc_id < 50) >= 40


def test_reliabilities(spark):
    """The votes of a good labeler are found to be reliable, those of a coin aren't."""
    rng = random.Random(0)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.5
        good = [1 if (rng.random() < 0.9) == truth else -1 for _ in range(4)]
        key = (*good, rng.choice([1, -1]))
        counts[key] = counts.get(key, 0) + 1
    post, table = pii.estimate([(0, k, n) for k, n in sorted(counts.items())])
    assert all(abs(t[1][1] - 0.9) < 0.05 and abs(t[0][-1] - 0.9) < 0.05 for t in table[:4])
    assert abs(table[4][1][1] - 0.5) < 0.06
    assert all(0 <= p <= 1 for p in post)


def test_nothing_found(spark):
    for rows in ([], [(1, None), (None, ""), (2, "plain words")]):
        got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and not any(r.all_spans for r in got)


def test_time_grows_with_the_text_only(spark):
    """2.5 million characters with 150,000 emails, and wide candidates beside base spans."""
    rows = [(1, "jo.doe@ex.com ok " * 150_000), (2, "call (212) 555-1234 at 1.2.3.4 " * 40_000)]
    began = time.monotonic()
    got = {r.doc_id: (r.b, r.a) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("base_spans").alias("b"), F.size("all_spans").alias("a")).collect()}
    assert got[1][0] == 150_000 and got[2][0] == 40_000 and got[2][1] >= 40_000
    assert time.monotonic() - began < 240


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a@b.co"), (3, "a@b.co"), (3, "a@b.co")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.base_spans)) for r in pii.personal_data(df).collect()) == [(0, 1), (3, 1), (3, 1)]
