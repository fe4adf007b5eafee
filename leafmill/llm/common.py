"""What the operators of this subpackage share: tables, shared storage, word kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from leafmill.storage import settled as written
from leafmill.storage import shared_dir

__all__ = ["arrow_map", "joined_words", "shared_dir", "table", "word_bounds", "written"]

#: Bytes that part words: space and 0x09 to 0x0D. bytes.split() parts on exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: Rows in a batch that goes to Python.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), with at most ARROW_ROWS rows going to Python at once, as texts can be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(run, schema)


def joined_words(text: str | None, lower: bool = False) -> bytes:
    """The words of a text, joined by one space, as UTF-8."""
    if not text:
        return b""
    raw = text.encode("utf-8", "surrogatepass")
    if lower:
        raw = raw.lower()  # bytes.lower() changes A-Z alone
    return b" ".join(raw.split())


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offset of each word of joined_words()."""
    if not joined:
        none = np.zeros(0, np.int64)
        return none, none
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
