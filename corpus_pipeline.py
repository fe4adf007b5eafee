"""The corpus pipeline: five stages, each working on all that the one before kept.

All but the last return the columns of documents. run() writes each stage's
rows to the shared folder and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from leafmill.llm.common import table, written
from leafmill.llm.queries import BYTE_RANKS

#: Five words, and the least similarity of near duplicates.
WORDS, SIMILARITY = 5, 0.8
#: From this score on a document is rejected.
TOXIC = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored TOXIC or more go. The model learns from the labels it may learn from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learnable(F.col("id")))
    scored = toxicity.scores(docs, model, docs.columns, score="__score")
    return scored.filter(F.col("__score") < TOXIC).select(docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; every document stays."""
    out = line_dedup.drop_boilerplate(docs, F.col("source"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id; rows without an id stay."""
    groups = simhash.near_groups(docs, WORDS, SIMILARITY)
    gone = groups.filter("doc_id <> group_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs.doc_id == F.col("__gone"), "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(docs.columns)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded bytes of every document."""
    path = public_tokenizers.path(BYTE_RANKS)
    return bpe.digest(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode_documents),
]

#: Learnt scores and near copies have no SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
