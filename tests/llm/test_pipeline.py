import hashlib

import pytest
import public_tokenizers as P

import brute
import corpus_pipeline
from leafmill.llm import bpe, decontaminate, line_dedup, queries
from leafmill.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF).cache()
        out.append((name, docs, new))
        docs = new
    return {name: (a, b) for name, a, b in out}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(steps, spark):
    columns = table(spark, SF, "documents").columns
    for name, (_, after) in list(steps.items())[:-1]:
        assert after.columns == columns, name


def test_toxicity_rejects_what_it_scores(steps, spark):
    before, after = map(rows, steps["toxicity"])
    scored = {r.doc_id: r.predicted for r in queries.op4_toxicity(spark, SF).collect()}
    assert set(after) == {d for d in before if not scored[d]}


def test_lines(steps):
    before, after = map(rows, steps["line_dedup"])
    want = dict(brute.line_dedup([(d, r.source, r.text) for d, r in before.items()], line_dedup.RATIO, line_dedup.LEAST))
    assert {d: r.text for d, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_one_of_each_group_stays(steps):
    before, after = map(rows, steps["simhash"])
    want = brute.near_groups([(d, r.text) for d, r in before.items()])
    kept = {d for d, g in want.items() if d == g}
    assert kept <= set(after) and len(set(after) - kept) <= 1


def test_contaminated_documents_go(steps, spark):
    before, after = map(rows, steps["decontaminate"])
    items = [decontaminate.words_of(r.text) for r in table(spark, SF, "benchmark").collect()]
    text = lambda r: b" ".join(decontaminate.words_of(r.text))
    holds = {d for d, r in before.items() if any(b" ".join(i) in text(r) for i in items if len(i) >= decontaminate.SHORTEST)}
    assert holds == set(before) - set(after)


def test_encoding(steps):
    before, after = map(rows, steps["byte_bpe"])
    enc = bpe.encoding(P.path(queries.BYTE_RANKS), P.PATTERN)
    assert set(before) == set(after)
    for d, r in after.items():
        assert r.n_tokens == len(enc.encode_ordinary(before[d].text))
        assert r.decoded_sha256 == hashlib.sha256(before[d].text.encode()).hexdigest()


def test_run_gives_the_last_stages_rows(steps, spark):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps["byte_bpe"][1].collect()))


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __text string"
    odd = [(None, None, None, None, None, "x"), (1, None, "en", "s", 0, None), (2, "", "en", None, 0, "x"), (2, "", "en", None, 0, "x"), (3, "a b c", None, "s", 5, "x"), (4, "long " * 20_000, "en", "s", 1, "x")]
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema).drop("__text")
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= len(data)
            if "text" in out.columns:
                assert out.columns == docs.columns
