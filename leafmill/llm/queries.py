"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_dedup, passages, pii, reshard, simhash, token_counts, topk, toxicity
from .common import table

BYTE_RANKS, PIECE_MODEL = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
SHARDS, OLD_SHARDS = 24, 16


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each contaminated document and item."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learnable(F.col("id")))
    out = toxicity.scores(docs, model, ["doc_id"])
    held_out = F.coalesce(~toxicity.learnable(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.span_text(F.col("base_spans")), 256).alias("base_sha256"), pii.span_text(F.col("all_spans")).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout: OLD_SHARDS shards by a hash of the source."""
    old = F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))
    placed = reshard.reshard(table(spark, sf_dir, "documents"), old, OLD_SHARDS, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_RANKS)
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_kd_top_k": op2_kd_top_k,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_personal_data": op5_personal_data,
    "op6_line_dedup": op6_line_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_reshard": op8_reshard,
    "op9_token_counts": op9_token_counts,
    "op10_byte_bpe": op10_byte_bpe,
}

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, rowid AS r, source AS host, u.line, u.pos, trim(u.line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, unnest(range(len(string_split(d.text, chr(10))))) AS pos) u
), totals AS (SELECT source AS host, count(*) AS pages FROM documents GROUP BY source),
often AS (
  SELECT l.host, l.bare FROM lines l JOIN totals t ON t.host IS NOT DISTINCT FROM l.host
  WHERE l.bare <> '' GROUP BY l.host, l.bare, t.pages
  HAVING count(DISTINCT l.r) >= {line_dedup.LEAST} AND count(DISTINCT l.r) > {line_dedup.RATIO} * t.pages
), marked AS (
  SELECT l.*, o.bare IS NOT NULL AS bad FROM lines l
  LEFT JOIN often o ON o.host IS NOT DISTINCT FROM l.host AND o.bare = l.bare
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '')) AS kept_sha256
FROM marked GROUP BY doc_id, r
"""

TOP_K_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

SUBSTRING_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), words AS (
  SELECT r, doc_id, u.p, w[u.p] AS word, CASE WHEN u.p + {passages.WINDOW - 1} <= len(w) AND doc_id IS NOT NULL THEN md5(array_to_string(w[u.p:u.p + {passages.WINDOW - 1}], ' ')) END AS k
  FROM split, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p) u
), least AS (SELECT k, min(doc_id) AS owner FROM words WHERE k IS NOT NULL GROUP BY k),
starts AS (
  SELECT words.*, coalesce(least.owner < words.doc_id, false) AS again FROM words LEFT JOIN least ON least.k = words.k
), marked AS (
  SELECT r, p, word, max(again::INTEGER) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {passages.WINDOW - 1} PRECEDING AND CURRENT ROW) = 1 AS gone FROM starts
), kept AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept ON kept.r = split.r
"""

ORACLE_SQL: dict[str, str] = {"op2_kd_top_k": TOP_K_SQL, "op6_line_dedup": LINE_DEDUP_SQL, "op7_substring_dedup": SUBSTRING_SQL}
