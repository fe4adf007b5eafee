import random

import numpy as np

from leafmill.llm import decontaminate as dc


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (dc.MATCH if x == y else dc.MISS), row[j + 1] + dc.GAP, new[j] + dc.GAP))
        best, row = max(best, *new), new
    return best


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(0, 20)), rng.integers(0, 4, rng.integers(0, 30))
        score, end = dc.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist())
        assert score == (smith_waterman(a.tolist(), b[:end].tolist()) if end else 0)


def corpus():
    rng = random.Random(3)
    some = [f"w{i}" for i in range(2500)]
    items = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(15, 60)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "too short"), (103, " ".join(rng.choice(some) for _ in range(400))), (None, "w1 w2 w3 w4 w5 w6 w7")]
    noise = lambda n: [rng.choice(some) for _ in range(n)]
    docs, want = [], {}
    for d in range(300):
        words = noise(rng.randrange(0, 200))
        if d % 3 == 0:
            item, text = items[d // 3 % 30]
            part = text.split()
            edit = d % 9
            if edit == 3:  # one word in eight replaced
                part = [w if i % 8 else "other" for i, w in enumerate(part)]
            elif edit == 6:  # words left out and put in
                part = [x for i, w in enumerate(part) for x in ([] if i % 9 == 4 else [w, "extra"] if i % 11 == 3 else [w])]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in part]
            want[d] = item
        docs.append((d, " ".join(words)))
    docs.append((900, items[33][1].split(" ", 100)[-1]))  # most of the long item
    want[900] = 103
    docs += [(901, None), (902, ""), (None, items[0][1])]
    return docs, items, want


def test_planted_passages(spark):
    docs, items, want = corpus()
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, leaks int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.leaks for r in dc.find_leaks(df, bench).collect()}
    assert len(got) == len({d for d, _ in docs})
    for d, leaks in got.items():
        found = {x.item_id for x in leaks}
        assert found == ({want[d]} if d in want else {0} if d is None else set()), (d, leaks)
    text = dict(docs)
    for d, leaks in got.items():
        for x in leaks:
            assert 0 <= x.start < x.end <= len(dc.words_of(text[d])) and 0 < x.score <= 1


def test_a_passage_in_a_third_of_all_documents_keeps_its_seeds(spark):
    item = " ".join(f"k{i}" for i in range(30))
    rows = [(i, f"a b c {item} d" if i % 3 == 0 else f"plain text number {i}") for i in range(300)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = dc.find_leaks(df, bench, ["doc_id"]).collect()
    assert {r.doc_id for r in got if r.leaks} == {i for i in range(300) if i % 3 == 0}


def test_no_alignment_scores_more_than_the_bound():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = rng.integers(1, 9, rng.integers(1, 20)), rng.integers(0, 12, rng.integers(1, 30))
        assert dc.align(a, b)[0] <= dc.most(a, b)


def test_parts_that_are_the_commoner_half(spark):
    items = [(i, " ".join(f"p{i}x{k}" for k in range(40))) for i in range(20)]
    rows = []
    for i, text in items:
        words = text.split()
        rows += [(100 * i + c, " ".join(["some", "words", *part, "and", "more"])) for c, part in enumerate((words[9:22], words[20:], *[words[:20]] * 9))]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in dc.find_leaks(df, bench, ["doc_id"]).collect()}
    assert got == {d: [d // 100] for d, _ in rows}


def test_runs_lie_in_one_segment():
    for n in [*range(dc.SHORTEST, 400), 1000]:
        parts = dc.segments_of(" ".join(f"w{i}" for i in range(n)))
        assert all(len(p) <= dc.SEGMENT for p in parts)
        held = {tuple(p[i : i + dc.RUN]) for p in parts for i in range(len(p) - dc.RUN + 1)}
        assert all(tuple(f"w{i}".encode() for i in range(at, at + dc.RUN)) in held for at in range(n - dc.RUN + 1))
    assert dc.segments_of(None) == dc.segments_of("too short") == []


def test_an_item_of_very_many_words(spark, monkeypatch):
    monkeypatch.setattr(dc, "SLICE", 1000)
    item = " ".join(f"w{i}" for i in range(5000))
    parts = list(dc._slices(spark.createDataFrame([(1, item), (2, "a b c d e f g")], "item_id long, text string"), "item_id", "text"))
    assert len(parts) > 5 and all(sum(map(len, p.words)) <= 1000 for p in parts)
    df = spark.createDataFrame([(1, "x y " + " ".join(item.split()[3000:3013]) + " z"), (1, "x y"), (1, "x y")], "doc_id long, text string")
    assert sorted(len(r.leaks) for r in dc.find_leaks(df, spark.createDataFrame([(1, " ".join(item.split()[2900:3100]))], "item_id long, text string")).collect()) == [0, 0, 1]


def test_benchmark_in_slices(spark, monkeypatch):
    docs, items, want = corpus()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "SLICE", 500)
    got = {r.doc_id for r in dc.find_leaks(df, bench, ["doc_id"]).collect() if r.leaks}
    assert got == {*want, None}


def test_empty_tables(spark):
    docs, items, _ = corpus()
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.find_leaks(none, bench).count() == 0
    df = spark.createDataFrame(docs[:5], "doc_id long, text string")
    assert all(r.leaks == [] for r in dc.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).collect())
