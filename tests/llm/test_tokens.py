import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from leafmill.llm import bpe, token_counts

RANKS, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\r\n", "\t", "a", "b", "ing", "▁", "\x00", "é", "漢", "𝒳", "'s", "12", "!?", "<s>", "<|endoftext|>", "　", "x" * 40, "́"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    return [*out, None, "", " ".join(map(str, range(40_000))), "z" * 30_000, "same " * 255 + "other " * 256 + "third " * 1000]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(5)


def test_encoding_and_decoding_as_the_library(frame, texts):
    enc = bpe.encoding(RANKS, P.PATTERN)
    got = {r.doc_id: r for r in bpe.digest(bpe.encode(frame, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_cutting_long_texts_changes_no_id(texts):
    enc = bpe.encoding(RANKS, P.PATTERN)
    for t in filter(None, texts):
        assert "".join(bpe.pieces(t, 3)) == t
        assert np.frombuffer(bpe.encode_text(t, RANKS, P.PATTERN, 3), "<u4").tolist() == enc.encode_ordinary(t)


def test_ids_array(frame, spark):
    enc = bpe.encoding(RANKS, P.PATTERN)
    df = spark.createDataFrame([(1, "good morning, world"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.a for r in bpe.encode(df, RANKS, P.PATTERN).select("doc_id", bpe.ids_array(F.col("ids")).alias("a")).collect()}
    assert got == {1: enc.encode_ordinary("good morning, world"), 2: []}


def test_counts_as_the_library(frame, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(frame, MODEL).collect()}
    want = {i: (len((t or "").encode()), len(model.encode(t or "", num_threads=1))) for i, t in enumerate(texts)}
    assert got == want


@pytest.mark.parametrize("limits", [token_counts.Limits(rows=7, words=20, sums=50, batch=3), token_counts.Limits(chars=100, sums=1)])
def test_counts_in_small_blocks(frame, texts, limits):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    some = [(i, t) for i, t in enumerate(texts[:200] + texts[-4:])]
    df = frame.sparkSession.createDataFrame(some, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, MODEL, limits=limits).collect()}
    assert got == {i: len(model.encode(t or "", num_threads=1)) for i, t in some}


def test_packed_postings():
    rng = np.random.default_rng(2)
    lists = [np.sort(rng.integers(0, 1 << 14, rng.integers(1, 40) if k % 5 else 1)) for k in range(500)]
    rows = np.concatenate(lists)
    first = np.zeros(len(rows), bool)
    first[np.cumsum([0, *map(len, lists[:-1])])] = True
    data, starts = token_counts.packed(rows, first)
    back, counts = token_counts.unpacked(data, np.append(starts[first][1:], len(data)))
    assert back.tolist() == rows.tolist() and counts.tolist() == [len(x) for x in lists]


def test_each_pre_token_is_counted_once(spark):
    df = spark.createDataFrame([(i, f"the same words {i % 3}\nagain") for i in range(60)], "doc_id long, text string").repartition(4)
    words = [r.word for r in token_counts.distinct_words(df, MODEL).collect()]
    assert sorted(words) == sorted({"▁the", "▁same", "▁words", "▁0", "▁1", "▁2", "\n", "again"})


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(bpe.encode(none, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0
    assert token_counts.token_counts(none, MODEL).count() == 0


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(df, MODEL).collect()) == [(0, 2), (1, 2), (1, 2)]
    assert bpe.encode(df, RANKS, P.PATTERN).count() == 3
