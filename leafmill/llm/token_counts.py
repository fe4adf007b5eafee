"""Token counts of whole texts without their ids.

A text's pre-tokens are counted; each distinct pre-token is tokenized once and
only its number of pieces is kept; the text's tokens are the sum over its
pre-tokens of frequency times pieces.

Pre-tokens end where a space follows something else, and around line feeds:
checked against the vocabulary, no piece of which holds another character
before a space mark, or a line feed. Merges never cross such a place, so the
sums equal the library's counts. A vocabulary for which that doesn't hold is
refused.

The texts are read twice. The first time gives the distinct pre-tokens, each
of which is tokenized once and written with its number of pieces. The second
time gives frequencies: rows are taken in blocks of at most Limits.rows
(and Limits.chars characters, but for one longer text), and a block has one row
for each of its pre-tokens, with the texts that hold it, as often as they do. Those
are joined to the pieces; the products are summed by text within a task first,
then by block. So a frequent pre-token has one row a block, not one a text,
and Spark splits the partition of one that is in every block. A block is known
by its task and number: df must give the same rows in the same order when a
task is run again, as a scan of files does.

Nulls count as empty texts; those have no tokens. Repeated rows give repeated
rows; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, written


class Limits(NamedTuple):
    """What a task holds at once: rows and characters of a block, distinct pre-tokens, products, rows of a batch."""

    rows: int = 8192  # below 2^14
    chars: int = 32_000_000
    words: int = 500_000
    sums: int = 2_000_000
    batch: int = 20_000


MARK = "▁"  # how the model writes a space
_SUM = np.dtype([("row", "<u2"), ("tokens", "<i8")])


class PieceCounter:
    """Counts a text's tokens through its distinct pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if bad := [p for p in pieces if re.search(f"[^{MARK}]{MARK}", p) or "\n" in p]:
            raise ValueError(f"pieces that cross pre-tokens, such as {bad[0]!r}")
        self.line_feed = len(self.model.encode("a\na", num_threads=1)) - 2 * len(self.model.encode("a", num_threads=1))
        if self.model.encode("a", out_type=str, num_threads=1) != [f"{MARK}a"] or self.model.encode("\na", out_type=str, num_threads=1)[0] != MARK:
            raise ValueError("the model doesn't put a space before a text")

    def pre_tokens(self, text: str) -> tuple[list[str], bool]:
        """Pre-tokens as the model sees them: spaces as MARK, one put before the text; whether the first mark of each is left out."""
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or "\n" in marked:
            return _SPLIT.findall(marked), False
        return marked.split(MARK)[1:], True

    def pieces(self, words: list[str]) -> list[int]:
        """The number of pieces of each of words (pre-tokens)."""
        # The model puts a space before each text, so a pre-token's first mark is left to it;
        # one without a mark (after a line feed) follows a line feed here too.
        texts = [w[1:] if w[0] == MARK else f"\n{w}" for w in words]
        given = {MARK: 1, "\n": self.line_feed}
        return [given[w] if w in given else len(ids) if w[0] == MARK else len(ids) - 1 - self.line_feed for w, ids in zip(words, self.model.encode(texts, num_threads=1), strict=True)]


_SPLIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def packed(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps between numbers below 2^14 as one or two bytes each, and where each starts; first marks those that follow no other."""
    steps = np.where(first, rows, rows - np.concatenate(([0], rows[:-1])))
    high = steps >> 7
    starts = np.cumsum(1 + (high > 0)) - 1 - (high > 0)
    out = np.zeros(len(steps) + int((high > 0).sum()), np.uint8)
    out[starts] = (steps & 127) | ((high > 0) << 7)
    out[starts[high > 0] + 1] = high[high > 0]
    return out, starts


def unpacked(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed() lists that lie one after the other up to ends, and how many each list has."""
    last = data < 128
    at = np.flatnonzero(last)
    long = np.zeros(len(at), bool)
    long[at > 0] = ~last[at[at > 0] - 1]
    steps = data[at].astype(np.int64)
    steps[long] = steps[long] << 7 | data[at[long] - 1] & 127
    counts = np.diff(np.concatenate(([0], np.searchsorted(at, ends))))
    sums = np.cumsum(steps)
    before = np.concatenate(([0], sums))[np.cumsum(counts) - counts]
    return sums - np.repeat(before, counts), counts


class Codes(dict):
    """Numbers of the pre-tokens met so far; plain: of those whose first mark is left out."""

    def __init__(self):
        self.words: list[str] = []
        self.plain = _Plain(self)

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        return code


class _Plain(dict):
    def __init__(self, codes: Codes):
        self.codes = codes

    def __missing__(self, word: str) -> int:
        code = self[word] = self.codes[MARK + word]
        return code


def distinct_words(df: DataFrame, path: str, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """word: the distinct pre-tokens of the texts of df."""

    def run(batches):
        codes, own = Codes(), counter(path)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    tokens, plain = own.pre_tokens(t)
                    for w in set(tokens):
                        (codes.plain if plain else codes)[w]
                if len(codes.words) > limits.words:
                    yield from _chunks(codes.words)
                    codes = Codes()
        yield from _chunks(codes.words)

    def _chunks(words):
        for at in range(0, len(words), limits.batch):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + limits.batch], pa.string())], names=["word"])

    return arrow_map(df.select(F.col(text).cast("string")), run, "word string").distinct()


def counted(words: DataFrame, path: str) -> DataFrame:
    """word, pieces: the number of pieces of each word."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter(path).pieces(batch.column(0).to_pylist()), pa.int32())], names=["word", "pieces"])

    return arrow_map(words, run, "word string, pieces int")


def frequencies(rows: DataFrame, path: str, limits: Limits = Limits()) -> DataFrame:
    """word, block, postings (texts of the block that hold the word, as often as they do, packed), head.

    rows: any columns, the text last. A block also has one row with the other columns of its
    texts in head, whose word, a line feed and the block's number, is no pre-token.
    """
    head = T.ArrayType(T.StructType(rows.schema.fields[:-1]))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("block", T.LongType()), T.StructField("postings", T.BinaryType()), T.StructField("head", head)])
    last = len(rows.columns) - 1

    def run(batches):
        own, number = counter(path), TaskContext.get().partitionId() << 32
        codes, parts, heads, held, chars = Codes(), [], [], 0, 0

        def block():
            structs = pa.concat_arrays([pa.StructArray.from_arrays(h.columns, fields=list(h.schema)) for h in heads])
            lists = pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)
            names = ["word", "block", "postings", "head"]
            yield pa.RecordBatch.from_arrays([pa.array([f"\n{number}"]), pa.array([number], pa.int64()), pa.array([None], pa.binary()), lists], names=names)
            if not parts:
                return
            keys = np.sort(np.concatenate(parts))
            code = keys >> 16
            first = np.concatenate(([True], code[1:] != code[:-1]))
            data, places = packed(keys & 0xFFFF, first)
            starts = np.flatnonzero(first)
            bounds = np.append(places[starts], len(data))
            for at in range(0, len(starts), limits.batch):
                a = starts[at : at + limits.batch]
                offsets = bounds[at : at + len(a) + 1]
                buffers = [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32).tobytes()), pa.py_buffer(data[offsets[0] : offsets[-1]].tobytes())]
                postings = pa.Array.from_buffers(pa.binary(), len(a), buffers)
                words = pa.array([codes.words[c] for c in code[a].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([words, pa.array(np.full(len(a), number)), postings, pa.nulls(len(a), lists.type)], names=names)

        for batch in batches:
            first = 0
            for i, t in enumerate(batch.column(last).to_pylist()):
                if held and (held == limits.rows or chars + len(t or "") > limits.chars):
                    heads.append(batch.slice(first, i - first).select(range(last)))
                    yield from block()
                    codes, parts, heads, held, chars, first = Codes(), [], [], 0, 0, i
                    number += 1
                if t:
                    tokens, plain = own.pre_tokens(t)
                    found = np.fromiter(map((codes.plain if plain else codes).__getitem__, tokens), np.int64, len(tokens))
                    parts.append(found << 16 | held)
                held, chars = held + 1, chars + len(t or "")
            heads.append(batch.slice(first).select(range(last)))
        if held:
            yield from block()

    return arrow_map(rows, run, schema)


def summed(joined: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """block, head, sums: postings times pieces by text, of the rows of frequencies() joined to pieces."""

    def run(batches):
        names, held, size = ["block", "head", "sums"], [], 0

        def sums():
            key = np.concatenate([k for k, _ in held])
            order = np.argsort(key, kind="stable")
            key, products = key[order], np.concatenate([p for _, p in held])[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            out = np.empty(len(starts), _SUM)
            key = key[starts]
            out["row"], out["tokens"] = key & 0xFFFF, np.add.reduceat(products, starts)
            block = key >> 16
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            ends = np.append(first[1:], len(block))
            data = pa.array([out[a:z].tobytes() for a, z in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())
            numbers = blocks[block[first]]
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.nulls(len(first), kind), data], names=names)

        blocks, kind = np.zeros(0, np.int64), None
        for batch in batches:
            kind = batch.column(2).type
            heads = batch.filter(pa.compute.is_valid(batch.column(2)))
            if heads.num_rows:
                yield pa.RecordBatch.from_arrays([heads.column(0), heads.column(2), pa.nulls(heads.num_rows, pa.binary())], names=names)
            rest = batch.filter(pa.compute.is_null(batch.column(2)))
            if not rest.num_rows:
                continue
            # blocks are numbered as they come, so that block and text fit one number
            own = rest.column(0).to_numpy()
            distinct, inverse = np.unique(own, return_inverse=True)
            new = np.setdiff1d(distinct, blocks)
            blocks = np.concatenate((blocks, new))
            by = np.argsort(blocks, kind="stable")
            place = by[np.searchsorted(blocks, distinct, sorter=by)][inverse]
            ends = np.cumsum(pa.compute.binary_length(rest.column(1)).to_numpy(zero_copy_only=False))
            texts, counts = unpacked(np.frombuffer(b"".join(rest.column(1).to_pylist()), np.uint8), ends)
            products = np.repeat(rest.column(3).to_numpy(zero_copy_only=False).astype(np.int64), counts)
            held.append((np.repeat(place, counts) << 16 | texts, products))
            size += len(products)
            if size > limits.sums:
                yield from sums()
                held, size, blocks = [], 0, np.zeros(0, np.int64)
        if held:
            yield from sums()

    head = next(f.dataType for f in joined.schema if f.name == "head")
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("head", head), T.StructField("sums", T.BinaryType())])
    return arrow_map(joined.select("block", "postings", "head", "pieces"), run, schema)


def token_counts(df: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """keys, n_bytes and n_tokens of every row of df, as the model file at path counts them."""
    rows = df.select(*keys, F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])
    pieces = written(counted(distinct_words(df, path, text, limits), path), "pieces")
    parts = summed(frequencies(rows, path, limits).join(pieces, "word", "left"), limits)

    def total(group: pa.Table) -> pa.Table:
        head = group.filter(pa.compute.is_valid(group.column("head"))).column("head").combine_chunks().flatten()
        tokens = np.zeros(len(head), np.int64)
        for part in group.column("sums").to_pylist():
            if part is not None:
                sums = np.frombuffer(part, _SUM)
                tokens[sums["row"]] += sums["tokens"]
        return pa.Table.from_arrays([*head.flatten(), pa.array(tokens)], names=schema.names)

    return parts.groupBy("block").applyInArrow(total, schema)
