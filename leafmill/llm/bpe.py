"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

encode() takes any table with a text column and gives its key columns with
ids, a BINARY of little-endian unsigned 32-bit token ids; decode() gives the
raw bytes of such ids; ids_array() unpacks them to ARRAY<BIGINT>.

Long texts are cut only at safe boundaries: before a space or line feed that
follows an ASCII letter or digit. No match of the pattern holds such a pair
inside, and no lookahead sees across it from the left, so the pieces give the
ids of the whole text while one call of the library never holds more than
about PIECE characters (a text without such a place stays whole).

Nulls count as empty texts and give no ids. Repeated rows give repeated rows.
Columns other than the named ones are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

#: Characters after which a long text is cut at the next safe place.
PIECE = 1 << 16
#: Rows of a batch that go back to Spark at once.
ROWS = 256
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text, cut at safe boundaries; joined they are the text."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(text: str | None, path: str, pattern: str, size: int = PIECE) -> bytes:
    if not text:
        return b""
    enc = encoding(path, pattern)
    return b"".join(enc.encode_to_numpy(p, disallowed_special=()).astype("<u4").tobytes() for p in pieces(text, size))


def encode(df: DataFrame, path: str, pattern: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and ids of every row of df."""
    kept = df.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*(kept.schema[k] for k in keys), T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = pa.array([encode_text(t, path, pattern) for t in part.column(len(keys)).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keys))), ids], names=[*keys, "ids"])

    return arrow_map(kept, run, schema)


def decode_ids(ids: bytes | None, path: str, pattern: str) -> bytes:
    if not ids:
        return b""
    return encoding(path, pattern).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def decode(path: str, pattern: str):
    """A function of an ids column that gives the raw bytes (null: empty)."""

    @F.arrow_udf("binary")
    def raw(ids: pa.Array) -> pa.Array:
        return pa.array([decode_ids(x, path, pattern) for x in ids.to_pylist()], pa.binary())

    return raw


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def ids_array(ids: Column) -> Column:
    """ARRAY<BIGINT> of packed ids."""
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k + 1, F.lit(1))), 16, 10).cast("long")
    return F.when(F.octet_length(ids) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1),
            lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216,
        )
    )


def digest(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """What the query returns of encode()'s rows."""
    back = decode(path, pattern)
    return df.select(
        "doc_id",
        n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(back("ids"), 256).alias("decoded_sha256"),
    )
