"""The registered queries against their SQL, over the small tables."""

import duckdb
import pytest

from leafmill.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda f: sorted(map(tuple, f[columns].astype(str).values.tolist()))
    assert key(got) == key(want)


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_columns(spark):
    want = {
        "op1_simhash": ["doc_id", "fingerprint", "component_id"],
        "op2_kd_top_k": ["query_id", "rank", "vec_id", "score"],
        "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op5_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op7_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op8_reshard": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op9_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op10_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    }
    kinds = {"doc_id": "bigint", "rank": "int", "score": {"op2_kd_top_k": "bigint", "op4_toxicity": "double"}, "held_out": "boolean", "predicted": "int", "shard": "int", "slot": "bigint", "grown_shard": "int", "over_limit": "boolean", "n_tokens": "bigint"}
    for name, columns in want.items():
        out = queries.QUERIES[name](spark, SF)
        assert out.columns[: len(columns)] == columns
        for c, kind in out.dtypes:
            k = kinds.get(c, kind)
            assert kind == (k[name] if isinstance(k, dict) else k), (name, c)
