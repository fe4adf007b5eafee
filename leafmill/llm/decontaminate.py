"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items give word n-grams. Items of more than SEGMENT words are cut into
segments that share RUN - 1 words with the next, so that RUN copied words lie
in one of them wherever they are. A
first pass counts in how many documents each of them occurs; those that occur
in none can't be found and go. All others are seeds, as any choice among them
loses copies of the part of a passage that is not chosen. A second pass joins
every document's n-grams to the seeds; each hit opens a window of the document
around the place where the segment would lie, and overlapping windows are
merged. A window whose words, each taken as like if the segment has it, can't
reach the score goes; with any other the segment is aligned, word by word:
MATCH for a like word, MISS for an unlike one, GAP for one left out or put in.
A document is contaminated by an item if an alignment reaches SHARE of the
segment's best possible score, or the score of RUN like words in a row. Edited,
shortened and paraphrased copies so far as that are found, wherever they lie,
if GRAM words in a row are unchanged.

Words are runs of ASCII letters, digits and characters beyond ASCII; A-Z count
as a-z. The join is done task by task against the segments, which are
broadcast SLICE words at a time at most: a larger benchmark takes further
passes. Documents are never joined to each other; each is read whole.

Null and empty texts are not contaminated; items that are null, or shorter
than SHORTEST words, are not looked for. Repeated items give repeated leaks,
repeated documents repeated rows. Other columns pass through; one called
leaks is replaced. Empty tables give no leaks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

GRAM, SEGMENT, SHORTEST, SLICE, ROWS = 3, 64, 6, 1_000_000, 512
MATCH, MISS, GAP, SHARE, RUN = 2, -1, -1, 0.5, 13

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Segments:
    """Segments of test items, their vocabulary and n-grams; small enough to broadcast."""

    def __init__(self, parts: list[tuple[int, list[bytes]]]):
        """parts: item and words of each segment."""
        self.items = [item for item, _ in parts]
        self.words = [words for _, words in parts]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for ws in self.words]
        per = [self.keys(x) for x in self.ids]
        self.grams = np.unique(np.concatenate([k for k, _ in per])) if per else np.zeros(0, np.int64)
        self.seeds: dict[int, list[tuple[int, int]]] = {}

    def keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams without a foreign word, and where they start."""
        size = len(self.vocabulary) + 1
        at = np.ones(max(0, len(ids) - GRAM + 1), bool)
        key = np.zeros(len(at), np.int64)
        for g in range(GRAM):
            part = ids[g : g + len(at)]
            at &= part > 0
            key = key * size + part
        where = np.flatnonzero(at)
        return key[where], where

    def document(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def known(self, keys: np.ndarray, among: np.ndarray) -> np.ndarray:
        if not len(among) or not len(keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
        return among[at] == keys

    def choose(self, seen: dict[int, int]) -> None:
        """Seeds: all n-grams of the segments that occur; seen: documents by n-gram."""
        for s, ids in enumerate(self.ids):
            keys, where = self.keys(ids)
            for key, at in zip(keys.tolist(), where.tolist(), strict=True):
                if seen.get(key, 0):
                    self.seeds.setdefault(key, []).append((s, at))
        self.seed_keys = np.array(sorted(self.seeds), np.int64)

    def windows(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each segment the merged windows of the document that its seeds open."""
        keys, where = self.keys(ids)
        hit = self.known(keys, self.seed_keys)
        out: dict[int, list[list[int]]] = {}
        for key, at in zip(keys[hit].tolist(), where[hit].tolist(), strict=True):
            for s, place in self.seeds[key]:
                n = len(self.ids[s])
                lo, hi = max(0, at - place - n // 2 - 4), min(len(ids), at - place + n + n // 2 + 4)
                own = out.setdefault(s, [])
                if own and lo <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], hi)
                    own[-1][0] = min(own[-1][0], lo)
                else:
                    own.append([lo, hi])
        return {s: [(a, b) for a, b in own] for s, own in out.items()}

    def leaks(self, text: str | None) -> list[dict]:
        ids = self.document(text)
        out = []
        for s, spans in sorted(self.windows(ids).items()):
            best, own = None, self.ids[s]
            least = min(RUN * MATCH, SHARE * MATCH * len(own))
            for lo, hi in spans:
                if most(own, ids[lo:hi]) < least:
                    continue
                score, end = align(own, ids[lo:hi])
                if score >= least and (best is None or score > best[0]):
                    start = lo + end - align(own[::-1], ids[lo : lo + end][::-1])[1]
                    best = (score, start, lo + end)
            if best:
                out.append({"item_id": self.items[s], "score": best[0] / (MATCH * len(self.ids[s])), "start": best[1], "end": best[2]})
        return out


def most(a: np.ndarray, b: np.ndarray) -> int:
    """No local alignment of a with b scores more: the best stretch of b, where a word that a has counts MATCH and any other costs the least it can."""
    total = np.cumsum(np.concatenate(([0], np.where(np.isin(b, a), MATCH, max(MISS, GAP)))))
    return int((total - np.minimum.accumulate(total)).max())


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of a with b, and the end of its earliest place in b."""
    n = len(b)
    if not n or not len(a):
        return 0, 0
    column = np.arange(n + 1, dtype=np.int64)
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for x in a.tolist():
        new = np.zeros(n + 1, np.int64)
        np.maximum(row[:-1] + np.where(b == x, MATCH, MISS), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        # from the left: the best new[k] less the gap of every column since
        row = np.maximum.accumulate(new - GAP * column) + GAP * column
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def segments_of(text: str | None) -> list[list[bytes]]:
    """The words of an item, in segments; none if it is shorter than SHORTEST."""
    words = words_of(text)
    if len(words) < SHORTEST:
        return []
    parts = max(1, -(-(len(words) - RUN + 1) // (SEGMENT - RUN + 1)))
    step = (len(words) - RUN + 1) / parts
    return [words[int(step * p) : len(words) if p + 1 == parts else int(step * (p + 1)) + RUN - 1] for p in range(parts)]


def _slices(benchmark: DataFrame, item: str, text: str):
    """Segments of at most SLICE words each, read about a slice at a time."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text")).filter("item is not null and text is not null")
    # two characters a word at least, so that no more than SLICE words are read but for one longer item
    total = rows.agg(F.sum(F.char_length("text")).alias("n")).first().n or 0
    slices = -(-total // (2 * SLICE))
    for k in range(slices):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        held, size = [], 0
        for item_id, words in ((r.item, ws) for r in sorted(part.collect()) for ws in segments_of(r.text)):
            if held and size + len(words) > SLICE:
                yield Segments(held)
                held, size = [], 0
            held.append((item_id, words))
            size += len(words)
        if held:
            yield Segments(held)


def find_leaks(df: DataFrame, benchmark: DataFrame, keys: list[str] | None = None, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The keys (all columns, if None) of every row of df, and leaks: item_id, score (1: a whole segment) and first and last word, end exclusive."""
    spark = df.sparkSession
    keys = [c for c in (df.columns if keys is None else keys) if c != "leaks"]
    own = [] if text in keys else [F.col(text).alias("__text")]
    rows = df.select(*keys, *own, F.lit(None).cast(LEAK).alias("leaks"))
    names = rows.columns
    body = names.index("__text" if own else text)
    for segments in _slices(benchmark, item, item_text):
        rough = spark.sparkContext.broadcast(segments)

        def count(batches, rough=rough):
            own, seen = rough.value, None
            for batch in batches:
                if seen is None:
                    seen = np.zeros(len(own.grams), np.int64)
                for body in batch.column(0).to_pylist():
                    found = np.unique(own.keys(own.document(body))[0])
                    found = found[own.known(found, own.grams)]
                    seen[np.searchsorted(own.grams, found)] += 1
            if seen is not None and seen.any():
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(own.grams[at]), pa.array(seen[at])], names=["gram", "n"])

        # a row for each n-gram of the slice at most
        seen = arrow_map(df.select(F.col(text).cast("string")), count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        segments.choose({r.gram: r.n for r in seen})
        fine = spark.sparkContext.broadcast(segments)

        def search(batches, fine=fine):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    old = part.column(len(names) - 1).to_pylist()
                    found = [(o or []) + fine.value.leaks(t) for o, t in zip(old, part.column(body).to_pylist(), strict=True)]
                    leaks = pa.array(found, pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names) - 1)), leaks], names=names)

        rows = arrow_map(rows, search, rows.schema)
    return rows.select(*keys, "leaks").withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAK)))
