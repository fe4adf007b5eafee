"""Every query against its SQL, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from leafmill.plans import catalog, probed  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def rows(df: pd.DataFrame) -> list[tuple]:
    text = lambda v: "null" if v is None or v is pd.NA or v != v else str(v)
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLE_SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
