"""Substring deduplication with a log-structured fingerprint index.

A window is WINDOW consecutive words and has a hash. Windows are kept packed:
each is known by its anchor, the least hash of the GRAM-word sequences in it
(equal windows have equal anchors), and consecutive windows with one anchor
make a stretch, about one for every 20 words: anchor, fingerprint of the
stretch's words, document, first window and the hashes of its windows.

The index is log-structured. A batch of documents becomes a run, a table of
stretches in buckets sorted by anchor, that never changes. add() first
merge-joins the batch with every earlier run, bucket by bucket (runs aren't
shuffled), and matches what shares an anchor:

- a stretch whose fingerprint a document with a smaller id has: all windows;
- else, where an anchor has unlike stretches (the edges of shared passages),
  the hashes of single windows.

When there are more than FAN_IN runs, the smaller ones are merged into one, in
which each stretch is kept once, with its smallest document. verified() reads
the words of both places of every match and compares them (by 128-bit digests,
so that no passage is shuffled). A window counts as repeated if it also starts
in a document with a smaller id that is in an earlier run or in the batch; so
batches must come in the order of ids, as dedup() does it. That is exact but
for two windows of one anchor with equal 32-bit hashes, of which one could
hide a match; nothing is removed wrongly.

Hot passages are reduced by partial minima before each shuffle. An anchor with
more than HOT stretches in a batch is spread over SALT buckets; there are at
most rows / HOT of them.

Words are parted by ASCII white space. A null text has no words. Rows with a
null id have no windows and stay whole. Repeated rows (one id) don't repeat
each other, as no id is smaller; rows of one id with unlike texts are told
apart by a hash of the text. Extra columns are not read. An empty table gives
no rows. Long texts are taken SLAB words at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.storage import delete, remove

from .common import arrow_map, joined_words, shared_dir, word_bounds, written

WINDOW, GRAM, SLAB, FAN_IN, ROWS = 50, 8, 200_000, 3, 512
BATCHES, HOT, SALT = 5, 20_000, 64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        made = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
        if size > 1 << 21:  # too large to keep
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def _hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each n of lengths a hash of the words i to i + n - 1, for each i: differences of polynomial sums, mixed."""
    up, down = _power_tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_byte_values()[np.frombuffer(joined, np.uint8)] * up[: len(joined)], out=sums[1:])
    out = []
    for n in lengths:
        first = starts[: len(starts) - n + 1]
        h = (sums[ends[n - 1 :]] - sums[first]) * down[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        out.append(h)
    return out


def _slabs(joined: bytes, slab: int):
    """Parts of at most slab windows: first word, bytes, word bounds."""
    starts, ends = word_bounds(joined)
    for at in range(0, max(0, len(starts) - WINDOW + 1), slab):
        s, e = starts[at : at + slab + WINDOW - 1], ends[at : at + slab + WINDOW - 1]
        yield at, joined[s[0] : e[-1]], s - s[0], e - s[0]


def stretches(joined: bytes, slab: int = SLAB) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, fingerprint, first window and windows of every stretch (signed 64-bit hashes), and the hashes of all windows in their order."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int32, np.int32, np.uint32)]
    for at, part, starts, ends in _slabs(joined, slab):
        (least, windows), span = _hashes(part, starts, ends, (GRAM, WINDOW)), 1
        need = WINDOW - GRAM + 1
        while span * 2 <= need:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if span < need:
            least = np.minimum(least[: len(least) - (need - span)], least[need - span :])
        first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        count = np.diff(np.concatenate((first, [len(least)])))
        a, z = starts[first].tolist(), ends[first + count + WINDOW - 2].tolist()
        prints = np.array([xxhash.xxh3_64_intdigest(part[i:j]) for i, j in zip(a, z, strict=True)], np.uint64)
        made = (least[first].view(np.int64), prints.view(np.int64), (first + at).astype(np.int32), count.astype(np.int32), (windows >> np.uint64(32)).astype(np.uint32))
        for own, x in zip(parts, made, strict=True):
            own.append(x)
    return tuple(np.concatenate(p) for p in parts)


_STRETCH = "anchor long, print long, doc_id long, text_hash long, first int, windows int, prints binary"
_MATCH = "doc_id long, text_hash long, first int, windows int, owner_id long, owner_hash long, owner_first int"


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stretches of every document."""
    names = [f.split()[0] for f in _STRETCH.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [stretches(joined_words(t)) for t in part.column(1).to_pylist()]
                anchor, prints, first, count, windows = (np.concatenate(x) for x in zip(*found, strict=True))
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                offsets = (np.concatenate(([0], np.cumsum(count))) * 4).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(windows.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(prints), part.column(0).take(rows), part.column(2).take(rows), pa.array(first), pa.array(count), packed], names=names)

    return arrow_map(_hashed(df, key, text).filter("doc_id is not null and text is not null"), run, _STRETCH)


class FingerprintIndex:
    """Runs of stretches below a folder; batches are matched with them and added, runs merged."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = FAN_IN, hot: int = HOT):
        self.spark, self.fan_in, self.limit = spark, fan_in, hot
        self.folder = folder or f"{shared_dir(spark)}/leafmill-index-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []  # names of tables, oldest first
        self.hot = spark.createDataFrame([], "anchor long")

    def _write(self, rows: DataFrame) -> str:
        """A run of rows that are dealt by spread."""
        name = f"leafmill_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "spread").sortBy("spread").saveAsTable(name)
        return name

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows with spread, what buckets go by: the anchor, or one of SALT numbers of a hot anchor."""
        hot = self.hot.select(F.col("anchor").alias("__hot"))
        rows = rows.join(hot, F.col("anchor") == F.col("__hot"), "left")
        spread = F.when(F.col("__hot").isNull(), F.col("anchor")).otherwise(F.xxhash64("anchor", F.pmod("print", F.lit(SALT))))
        return rows.withColumn("spread", spread).drop("__hot").repartition(self.buckets, "spread")

    def _everywhere(self, anchors: DataFrame) -> DataFrame:
        """anchors with every spread that their stretches can have."""
        hot = self.hot.select(F.col("anchor").alias("__hot"))
        all_of = F.concat(F.array("anchor"), F.array(*(F.xxhash64("anchor", F.lit(k).cast("long")) for k in range(SALT))))
        rows = anchors.join(hot, F.col("anchor") == F.col("__hot"), "left")
        return rows.withColumn("spread", F.explode(F.when(F.col("__hot").isNull(), F.array("anchor")).otherwise(all_of))).drop("__hot")

    def add(self, batch: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Adds the batch as a run and gives its matches with earlier runs and with itself, not yet verified.

        doc_id, text_hash, first, windows; owner_id, owner_hash, owner_first: the place of the same windows in a document with a smaller id.
        """
        made: list[DataFrame] = []

        def keep(df: DataFrame, name: str) -> DataFrame:
            made.append(written(df, name))
            return made[-1]

        rows = keep(fingerprints(batch, key, text), "batch")
        hot = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > self.limit).select("anchor")
        self.hot = written(self.hot.union(hot).distinct(), "hot")
        run = self._write(self._dealt(rows))
        own = self.spark.table(run)
        probes = self._everywhere(own.select("anchor").distinct()).select("spread")
        # runs are in buckets by spread, so only the probes are shuffled
        hits = [self.spark.table(r).join(probes, "spread", "left_semi") for r in self.runs]
        old = keep(reduce(DataFrame.union, hits), "history") if hits else own.limit(0)
        both = old.select("anchor", "print", "doc_id").union(own.select("anchor", "print", "doc_id"))
        shared = both.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), (F.min("print") != F.max("print")).alias("unlike")).filter("a < z")
        shared = keep(self._everywhere(shared.select("anchor", "unlike")).select("spread", "unlike"), "anchors")
        # what rows are joined to is written first: a join of two scans, whose hot keys Spark splits over tasks
        fields = [F.col(f.split()[0]) for f in _STRETCH.split(", ")]
        met = own.join(shared, "spread").select(*fields, "unlike", F.lit(True).alias("new"))
        met = keep(met.union(old.join(shared, "spread").select(*fields, "unlike", F.lit(False))), "met")
        place = F.struct("doc_id", "text_hash", "first").alias("place")
        owners = keep(met.select("print", place).groupBy("print").agg(F.min("place").alias("owner")), "owners")
        met = met.join(owners, "print")
        whole = met.filter("new and doc_id > owner.doc_id").select("doc_id", "text_hash", "first", "windows", "owner.*")
        edges = keep(met.filter("unlike and doc_id = owner.doc_id").select("anchor", "doc_id", "text_hash", "first", "windows", "prints", "new"), "edges")
        at = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("windows") - 1), lambda i: F.xxhash64("anchor", F.substring("prints", i * 4 + 1, F.lit(4)))))
        single = edges.select("doc_id", "text_hash", "new", "first", at.alias("i", "window")).withColumn("first", F.col("first") + F.col("i"))
        least = single.select("window", place).groupBy("window").agg(F.min("place").alias("owner"), F.max("place.doc_id").alias("most"))
        least = keep(least.filter("owner.doc_id < most").drop("most"), "least")
        partly = single.filter("new").join(least, "window").filter("doc_id > owner.doc_id").select("doc_id", "text_hash", "first", F.lit(1).alias("windows"), "owner.*")
        matches = written(whole.union(partly).toDF(*(f.split()[0] for f in _MATCH.split(", "))), "matches")
        remove(*made)
        self.runs.append(run)
        self.compact()
        return matches

    def compact(self) -> None:
        """Merges the oldest runs into one when there are more than fan_in; each stretch stays once, with its smallest document."""
        while len(self.runs) > self.fan_in:
            old, rest = self.runs[: self.fan_in], self.runs[self.fan_in :]
            rows = self._dealt(reduce(DataFrame.union, (self.spark.table(r) for r in old)).drop("spread"))
            place = F.min(F.struct("doc_id", "text_hash", "first")).alias("place")
            rows = rows.groupBy("spread", "anchor", "print").agg(place, F.first("windows").alias("windows"), F.first("prints").alias("prints"))
            merged = self._write(rows.select("anchor", "print", "place.*", "windows", "prints", "spread"))
            self._drop(old)
            self.runs = [merged, *rest]

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, f"{self.folder}/{name}")

    def drop(self) -> None:
        """Deletes all runs."""
        self._drop(self.runs)
        self.runs = []


def spans(matches: DataFrame) -> DataFrame:
    """The matches, those that continue each other joined to one."""
    names = [f.split()[0] for f in _MATCH.split(", ")]
    grouped = matches.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("owner_id", "owner_hash", "first", "windows", "owner_first")).alias("parts"))

    def run(batches):
        for batch in batches:
            out = []
            for doc, mark, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                last = None
                for p in sorted(parts, key=lambda p: (p["owner_id"], p["owner_hash"], p["owner_first"] - p["first"], p["first"])):
                    if last and last[4:6] == [p["owner_id"], p["owner_hash"]] and last[6] - last[2] == p["owner_first"] - p["first"] and p["first"] <= last[2] + last[3]:
                        last[3] = max(last[3], p["first"] + p["windows"] - last[2])
                    else:
                        last = [doc, mark, p["first"], p["windows"], p["owner_id"], p["owner_hash"], p["owner_first"]]
                        out.append(last)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return arrow_map(grouped, run, _MATCH)


def _digest(words: list[bytes], first: int, windows: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[first : first + windows + WINDOW - 1]), digest_size=16).digest()


def with_digests(found: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, spans (first, windows, digest of the owner's words there), of the rows of spans()."""
    needed = found.groupBy("owner_id", "owner_hash").agg(F.collect_set(F.struct("owner_first", "windows")).alias("parts"))
    needed = written(needed, "needed")
    bodies = _hashed(docs, key, text)
    bodies = bodies.join(needed, (bodies.doc_id == needed.owner_id) & (bodies.text_hash == needed.owner_hash)).select("owner_id", "owner_hash", "text", "parts")
    schema = pa.schema([("owner_id", pa.int64()), ("owner_hash", pa.int64()), ("owner_first", pa.int32()), ("windows", pa.int32()), ("digest", pa.binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = []
                for doc, mark, body, parts in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    words = joined_words(body).split()
                    out += [(doc, mark, p["owner_first"], p["windows"], _digest(words, p["owner_first"], p["windows"])) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    keys = ["owner_id", "owner_hash", "owner_first", "windows"]
    # once for each place, should docs repeat rows
    digests = arrow_map(bodies, run, "owner_id long, owner_hash long, owner_first int, windows int, digest binary").distinct()
    both = found.join(written(digests, "digests"), keys)
    return both.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "windows", "digest")).alias("spans"))


def without_repeats(docs: DataFrame, repeats: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that no repeated window covers, joined by one space.

    repeats: rows of with_digests(); a span whose words differ from its owner's is left out.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    found = repeats.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "spans")
    both = _hashed(docs, key, text)
    both = both.join(found, (both.doc_id == found["__doc"]) & (both.text_hash == found["__hash"]), "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out: list[list] = [[], [], []]
                for body, parts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = joined_words(body).split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s in parts or ():
                        if _digest(words, s["first"], s["windows"]) == s["digest"]:
                            gone[s["first"]] += 1
                            gone[s["first"] + s["windows"] + WINDOW - 1] -= 1
                    stay = np.cumsum(gone)[:-1] == 0
                    kept = words if not parts else [words[i] for i in np.flatnonzero(stay).tolist()]
                    for o, x in zip(out, (len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")), strict=True):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=schema.names)

    return arrow_map(both, run, schema)


def dedup(docs: DataFrame, batches: int = BATCHES, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """without_repeats() of docs, which are added to a new index in batches of about equal numbers, in the order of ids."""
    index = FingerprintIndex(docs.sparkSession, hot=hot)
    own = F.col(key).cast("long")
    ends = docs.select(own.alias("k")).approxQuantile("k", [b / batches for b in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(e) for e in ends})
    matches = []
    for lo, hi in zip([None, *edges], [*edges, None], strict=True):
        part = docs if lo is None else docs.filter(own > lo)
        matches.append(index.add(part if hi is None else part.filter(own <= hi), key, text))
    index.drop()
    found = written(spans(reduce(DataFrame.union, matches)), "spans")
    remove(*matches)
    return without_repeats(docs, written(with_digests(found, docs, key, text), "repeats"), key, text)
