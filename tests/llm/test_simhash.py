import random
import re

import pytest
from pyspark.sql import functions as F

import brute
from leafmill.llm import components, simhash


def rows():
    rng = random.Random(9)
    some = [f"w{i}" for i in range(40)]
    out = []
    for _ in range(60):
        base = [rng.choice(some) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(1, 4)):
            out.append((len(out), " ".join(base).upper() if rng.random() < 0.2 else "  ".join(base)))
            if base:
                base[rng.randrange(len(base))] = "changed"
    return [*out, (None, "alone in null"), (900, None), (901, ""), (902, " \t"), (903, "two words"), (903, "two words"), (904, "ÄÖ Ü ẞ")]


def test_components_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, fp int").repartition(6)
    got = simhash.components(simhash.fingerprints(df)).select("doc_id", simhash.hex16(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.simhash_components(data), key=str)


def test_chains_of_fingerprints(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    for _ in range(700):
        prints.append(prints[rng.randrange(len(prints))] ^ 1 << rng.randrange(64) ^ (rng.randrange(2) << rng.randrange(64)))
    got = {r.doc_id: r.component_id for r in simhash.components(spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(prints)], "doc_id long, fp long")).collect()}
    groups = brute.Groups()
    for i, a in enumerate(prints):
        groups.find(i)
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                groups.join(i, j)
    least = {}
    for i in range(len(prints)):
        least.setdefault(groups.find(i), i)
    assert got == {i: least[groups.find(i)] for i in range(len(prints))}


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text) == whole == brute.fingerprint(text)


def test_roots_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 80)] + [(700, 700), (None, 3), (9, 8), (8, 9)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(101)}) == 1
    assert len({got[500 + i] for i in range(80)}) == 1
    assert got[0] != got[500] and 700 not in got
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_against_brute_force(spark):
    rng = random.Random(4)
    some = [f"v{i}" for i in range(3000)]
    data = []
    for _ in range(80):
        base = [rng.choice(some) for _ in range(rng.randrange(80, 300))]
        data.append((len(data), " ".join(base)))
        for _ in range(rng.randrange(0, 4)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(some)
            data.append((len(data), " ".join(copy)))
    data += [(1000, None), (1001, ""), (1002, "a b"), (1003, "a b"), (1004, "A  b")]
    df = spark.createDataFrame([(*r, "x") for r in [*data, data[0], (None, "a b")]], "doc_id long, text string, node string").repartition(5)
    got = {r.doc_id: r.group_id for r in simhash.near_groups(df).collect()}
    want = brute.near_groups(data)
    assert set(got) == set(want)
    assert all(want[g] == want[d] for d, g in got.items())  # none joined that shouldn't be
    assert sum(got[d] != want[d] for d in want) <= 0.02 * len(want)


@pytest.mark.parametrize("most", [simhash.ODD, 0])
def test_near_copies_among_pages_of_one_template(spark, most):
    rng = random.Random(6)
    page = [f"t{i}" for i in range(200)]

    def changed(words, n, tag):
        out = list(words)
        at = rng.randrange(len(out) - n)
        out[at : at + n] = [f"{tag}_{i}" for i in range(n)]
        return " ".join(out)

    data = []
    for f in range(60):
        own = changed(page, 20, f"f{f}").split()  # families are some 0.65 alike, their members 0.9
        data += [(f, c, changed(own, 3, f"f{f}c{c}")) for c in range(4)]
    rng.shuffle(data)
    rows = [(i, text) for i, (_, _, text) in enumerate(data)]
    got = {r.doc_id: r.group_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), most=most).collect()}
    want = brute.near_groups(rows)
    assert len(set(want.values())) > 10
    assert sum(got[d] != want[d] for d in want) <= 2, (len(set(got.values())), len(set(want.values())))


def test_few_pairs_of_unlike_pages_are_verified(spark, monkeypatch):
    rng = random.Random(9)
    page, rows = [f"t{i}" for i in range(300)], []
    for i in range(240):
        own, at = list(page), rng.randrange(260)
        own[at : at + 30] = [f"p{i}_{j}" for j in range(30)]  # any two are some 0.6 to 0.8 alike
        rows.append((i, " ".join(own)))
    tried, keep = [], simhash.written

    def counted(df, name="table"):
        out = keep(df, name)
        if name == "pairs":
            tried.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    got = {r.doc_id: r.group_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.near_groups(rows)
    assert sum(tried) < 500, tried


def joined_rows(spark, since):
    """Rows that the inner joins of the queries after the first `since` made, by join; the number of queries."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store = spark._jsparkSession.sharedState().statusStore()
    ids, out = [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())], {}
    for i in ids:
        if i > since:
            values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                if "Join" in node.name() and "Inner" in node.desc():
                    metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                    made = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                    key = re.sub(r"#\d+L?|^.*?Join|Build\w+", "", node.desc())[:80]
                    out[key] = out.get(key, 0) + sum(int(v.get().replace(",", "")) for v in made if v.isDefined())
    return out, max(ids, default=-1)


def test_documents_that_meet_often_are_joined_once(spark):
    rng = random.Random(14)
    page, rows = [f"t{i}" for i in range(300)], []
    for i in range(240):
        own, at = list(page), rng.randrange(270)
        own[at : at + 25] = [f"p{i}_{j}" for j in range(25)]  # unlike, but they meet in many groups
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    since = joined_rows(spark, 1 << 62)[1]
    got = {r.doc_id: r.group_id for r in simhash.near_groups(df).collect()}
    assert got == brute.near_groups(rows)
    made, _ = joined_rows(spark, since)
    by_node = {k: n for k, n in made.items() if "[node], [node]" in k}  # not once for each of the up to 256 groups of a document
    assert made and sum(by_node.values()) <= 2 * len(rows), made


def test_sharing_gives_every_similar_pair_of_any_sizes(spark):
    rng, rows = random.Random(16), []
    for f in range(25):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.choice((1, 4, 9, 40, 200)))]
        for _ in range(4):
            copy = base[: len(base) - rng.randrange(1 + len(base) // 6)]  # shorter ones too
            for _ in range(rng.randrange(1 + len(copy) // 50)):
                copy[rng.randrange(len(copy))] = f"x{rng.getrandbits(30)}"
            rows.append((len(rows), " ".join(copy)))
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met = spark.createDataFrame([(v, i, i, len(rows)) for i, _ in rows for v in (1, 2)], "variant long, node long, label long, size long")
    got = {(r.a, r.b) for r in simhash.sharing(met, texts, 5, 0.8, 4).collect()}
    want = {(i, j) for j, b in rows for i, a in rows[:j] if simhash.jaccard(a, b, 5) >= 0.8}
    assert len(want) > 40 and want <= got
    assert len(got) < 3 * len(want)


def test_no_similar_pair_fails_the_bound(spark):
    rng, pairs = random.Random(10), []
    while len(pairs) < 300:
        base = [f"w{rng.getrandbits(30)}" for _ in range(rng.choice((1, 4, 30, 300, 3000)))]
        copy = list(base)
        for _ in range(rng.randrange(1 + len(base) // 40)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = [f"x{rng.getrandbits(30)}"] * rng.randrange(3)
        pair = [" ".join(base), " ".join(copy)]
        if simhash.jaccard(*pair, 5) >= 0.8:
            pairs.append([simhash.banded(t, 5)[2] for t in pair])
    apart = [[simhash.banded(" ".join(f"{c}{i}" for i in range(200)), 5)[2] for c in "ab"]]
    df = spark.createDataFrame([tuple(p) for p in pairs + apart], "a array<long>, b array<long>").coalesce(1)
    assert [r.ok for r in df.select(simhash.can_reach("a", "b", 0.8).alias("ok")).collect()] == [True] * 300 + [False]


def test_repeated_lines_count_once():
    rng = random.Random(8)
    for _ in range(20):
        body, line = ([f"{c}{rng.getrandbits(40)}" for _ in range(n)] for c, n in (("b", 200), ("l", 20)))
        few, many = (" ".join(body + line * k) for k in (2, 8))
        assert simhash.jaccard(few, many, 5) == 1
        assert simhash.banded(few, 5) == simhash.banded(many, 5)


def test_as_many_near_copies_meet_in_a_large_table():
    rng, met, tried = random.Random(12), 0, 0
    size = 1 << simhash.UNSURE
    while tried < 200:
        base = [f"w{rng.getrandbits(40)}" for _ in range(300)]
        copy = list(base)
        for _ in range(rng.randrange(5, 8)):
            copy[rng.randrange(300)] = f"x{rng.getrandbits(40)}"
        a, b = " ".join(base), " ".join(copy)
        if 0.8 <= simhash.jaccard(a, b, 5) < 0.85:
            x, y = (simhash.banded(t, 5)[1] for t in (a, b))  # whatever the number of texts
            met += any(set(x[k : k + size]) & set(y[k : k + size]) for k in range(0, len(x), size))
            tried += 1
    assert met >= 0.92 * tried


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(simhash.fingerprints(df)).count() == 0
    assert simhash.near_groups(df).count() == 0
