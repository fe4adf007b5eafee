"""Exact top-k inner-product search with KD-trees, one for each shard.

Components become integers, floor(256 * x); scores are integer inner products.
The index: vectors dealt by hash into shards of about SHARD_ROWS, in each a
KD-tree with median splits of the widest dimension and tight bounding boxes.
The search: shards are dealt to lanes and blocks of QUERY_BLOCK queries to
bands, of LANE_BYTES and BAND_BYTES at most; a task has one lane's trees and
lets the blocks of one band pass them, so there are as many tasks as lanes
times bands, a tree is sent once for each band and a block once for each lane.
A box's bound is the largest inner product that any point in it could have.
Where boxes cut off much, a shard's leaves are taken best box first, each by
the queries whose k-th best so far its box can beat; else all rows of the shard
are. Either way the scores of a block and some rows are one matrix product, and
only those that reach the k-th best are merged. A lane gives k rows a query;
lanes are merged by a window.

Sums are done in floats while every product sum is below 2^24, in doubles below
2^53, and in Python integers otherwise, so scores are exact (they are cut to
the range of a long).

Vectors that are null or hold a null or non-finite component, and rows with a
null id, take no part. Rows with the query's id are not its candidates;
repeated query ids are one query. Vectors of unlike length are filled up with
zeros. Ties go to the smaller id; repeated candidate rows (same id and vector)
each count. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD_ROWS, LEAF, QUERY_BLOCK = 4096, 128, 1024
#: Bytes of vectors that a task holds, and that pass it; up to SPREAD lanes are made for LANE shards each before lanes are filled.
LANE_BYTES, BAND_BYTES, LANE, SPREAD = 1 << 26, 1 << 26, 4, 64
#: Rows in one product, and the share of boxes that must be cut off to take leaves one by one.
CHUNK, WORTH = 512, 0.25
#: Trees and blocks that go to Python at once.
ARROW_BLOBS = 32


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component; null if the vector takes no part."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(x, lambda v: F.floor(v * 256.0).cast("long")))


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Lists of whole numbers as rows, filled up with zeros."""
    vectors = vectors.combine_chunks()
    n, flat = pc.list_value_length(vectors).to_numpy(zero_copy_only=False), pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), max(n, default=0)), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def _small(a: np.ndarray) -> np.ndarray:
    for t in (np.int16, np.int32):
        if a.size == 0 or (a.min() >= np.iinfo(t).min and a.max() <= np.iinfo(t).max):
            return a.astype(t)
    return a


def build_tree(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """order: rows by leaf; for each node its rows (start, end), children (-1: leaf) and box (lo, hi)."""
    order = np.arange(len(vectors))
    start, end, left, right, lo, hi = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        own = vectors[order[a:b]]
        me = len(start)
        start.append(a), end.append(b), left.append(-1), right.append(-1), lo.append(own.min(0)), hi.append(own.max(0))
        return me

    todo = [node(0, len(vectors))] if len(vectors) else []
    while todo:
        at = todo.pop()
        a, b = start[at], end[at]
        spread = hi[at].astype(object) - lo[at].astype(object) if vectors.dtype == np.int64 else hi[at].astype(np.int64) - lo[at]
        if b - a <= LEAF or not len(spread) or not max(spread):
            continue
        axis, mid = int(np.argmax(spread)), (a + b) // 2
        part = vectors[order[a:b], axis]
        order[a:b] = order[a:b][np.argpartition(part, mid - a)]
        left[at], right[at] = node(a, mid), node(mid, b)
        todo += [left[at], right[at]]
    wide = vectors.shape[1]
    return {"order": order, "start": np.array(start, np.int64), "end": np.array(end, np.int64), "left": np.array(left, np.int64), "right": np.array(right, np.int64), "lo": np.array(lo, vectors.dtype).reshape(-1, wide), "hi": np.array(hi, vectors.dtype).reshape(-1, wide)}


def _build(batch: pa.Table) -> bytes:
    ids = batch.column("vec_id").to_numpy()
    vectors = _small(_matrix(batch.column("v")))
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    tree = build_tree(vectors)
    order = tree.pop("order")
    return _packed(ids=ids[order], vectors=vectors[order], **tree)


def _top(a: np.ndarray) -> int:
    return max(map(abs, (int(a.min()), int(a.max())))) if a.size else 0


def _filled(a: np.ndarray, wide: int) -> np.ndarray:
    return a if a.shape[1] == wide else np.pad(a, ((0, 0), (0, wide - a.shape[1])))


class Lane:
    """The trees of some shards."""

    def __init__(self):
        self.trees: list[dict[str, np.ndarray]] = []
        self.top = self.wide = 0

    def add(self, blob: bytes) -> None:
        t = _unpacked(blob)
        leaf = t["left"] < 0
        self.trees.append({"ids": t["ids"], "vectors": t["vectors"]} | {x: t[x][leaf] for x in ("start", "end", "lo", "hi")})
        self.top, self.wide = max(self.top, _top(t["vectors"])), max(self.wide, t["vectors"].shape[1])

    def search(self, blob: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id and score of the k best of each query of a block."""
        q = _unpacked(blob)
        wide = max(self.wide, q["vectors"].shape[1])
        most = _top(q["vectors"]) * self.top * wide
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
        # in Python integers, smaller numbers at a time
        best = (Exact if kind is object else Best)(q["ids"], _filled(q["vectors"], wide).astype(np.int64).astype(kind), k)
        for t in self.trees:
            best.shard(t["ids"], *(_filled(t[x], wide).astype(np.int64 if kind is object else kind).astype(kind) for x in ("vectors", "lo", "hi")), t["start"], t["end"])
        return best.rows()


class Best:
    """The k best of a block of queries, shard after shard, in floats; each query's best first."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.over, self.under = np.maximum(queries, 0), np.minimum(queries, 0)
        self.score = np.full((len(ids), k), -np.inf)
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def shard(self, ids: np.ndarray, vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        bounds = self.over @ hi.T + self.under @ lo.T
        if (bounds < self.score[:, -1:]).mean() < WORTH:
            for a in range(0, len(ids), CHUNK):
                self.piece(ids[a : a + CHUNK], vectors[a : a + CHUNK], None)
        else:
            for leaf in np.argsort(-bounds.mean(0), kind="stable").tolist():
                rows = np.flatnonzero(bounds[:, leaf] >= self.score[:, -1])
                if len(rows):
                    self.piece(ids[start[leaf] : end[leaf]], vectors[start[leaf] : end[leaf]], rows)
                    self.merge()
        self.merge()

    def piece(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None) -> None:
        """Finds what reaches the k-th best of the queries at rows (None: of all)."""
        queries, own, kth = (x if rows is None else x[rows] for x in (self.queries, self.ids, self.score[:, -1]))
        score = queries @ vectors.T
        if len(ids) >= self.k and np.isneginf(kth.min()):
            others = np.where(own[:, None] == ids, -np.inf, score)
            kth = np.maximum(kth, np.partition(others, -self.k, axis=1)[:, -self.k])
        kth = kth.astype(score.dtype)
        some = np.flatnonzero(score.max(axis=1) >= kth)  # few queries, soon
        at, col = np.divmod(np.flatnonzero((score[some] >= kth[some, None]).ravel()), len(ids))
        at = some[at]
        value, near = score[at, col].astype(np.float64), ids[col]
        at = at if rows is None else rows[at]
        better = (value > self.score[at, -1]) | (near < self.near[at, -1])
        better &= near != self.ids[at]
        if better.any():
            self.found.append((at[better], value[better], near[better]))
            self.waiting += int(better.sum())
            if self.waiting > 2 * len(self.ids):
                self.merge()

    def merge(self) -> None:
        if not self.found:
            return
        at, value, near = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found, self.waiting, k = [], 0, self.k
        rows = np.flatnonzero(np.bincount(at, minlength=len(self.ids)))
        at = np.concatenate((np.repeat(rows, k), at))
        value, near = np.concatenate((self.score[rows].ravel(), value)), np.concatenate((self.near[rows].ravel(), near))
        order = np.lexsort((near, -value, at))
        first = order[np.searchsorted(at[order], rows)[:, None] + np.arange(k)]
        self.score[rows], self.near[rows] = value[first], near[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = np.isfinite(self.score)
        return np.repeat(self.ids, self.k)[ok.ravel()], self.near[ok], self.score[ok].astype(np.int64)


class Exact:
    """As Best, in Python integers."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # heaps of (score, -id)

    def shard(self, ids: np.ndarray, vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        bounds = np.maximum(self.queries, 0) @ hi.T + np.minimum(self.queries, 0) @ lo.T
        for row, (own, heap) in enumerate(zip(self.ids.tolist(), self.best, strict=True)):
            for leaf in sorted(range(len(start)), key=lambda i: -bounds[row][i]):
                if len(heap) == self.k and bounds[row][leaf] < heap[0][0]:
                    break
                a, z = start[leaf], end[leaf]
                for score, near in zip((vectors[a:z] @ self.queries[row]).tolist(), ids[a:z].tolist(), strict=True):
                    item = (score, -near)
                    if near == own:
                        continue
                    if len(heap) < self.k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [(own, -other, max(-(2**63), min(2**63 - 1, score))) for own, heap in zip(self.ids.tolist(), self.best, strict=True) for score, other in heap]
        return tuple(np.array([r[i] for r in out], np.int64) for i in range(3))


def search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of task, kind (0: a tree, 1: a block of queries) and blob, each task's trees first."""
    at, lane = None, Lane()
    for batch in batches:
        for row in range(batch.num_rows):
            task, kind, blob = (batch.column(c)[row].as_py() for c in ("task", "kind", "blob"))
            if task != at:
                at, lane = task, Lane()
            if kind == 0:
                lane.add(blob)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in lane.search(blob, k)], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every row for which queries holds."""
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), quantised(F.col(vector)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).filter("vec_id is not null and v is not null")
    rows = written(rows, "vectors")
    shards, blocks = (max(1, -(-x // n)) for x, n in zip((rows.count(), rows.filter("asked").count()), (SHARD_ROWS, QUERY_BLOCK), strict=True))

    def blobs(part: DataFrame, n: int, make) -> DataFrame:
        def one(key: tuple, batch: pa.Table) -> pa.Table:
            blob = make(batch)
            return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(blob)], pa.int64()), "blob": pa.array([blob], pa.binary())})

        return part.withColumn("at", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).groupBy("at").applyInArrow(one, "at int, size long, blob binary")

    def pack(batch: pa.Table) -> bytes:
        ids, first = np.unique(batch.column("vec_id").to_numpy(), return_index=True)
        return _packed(ids=ids, vectors=_small(_matrix(batch.column("v").take(pa.array(first)))))

    index = written(blobs(rows.select("vec_id", "v"), shards, _build), "trees")
    asked = written(blobs(rows.filter("asked").select("vec_id", "v"), blocks, pack), "asked")
    lane_n, band_n = (-(-(x.agg(F.sum("size")).first()[0] or 1) // most) for x, most in ((index, LANE_BYTES), (asked, BAND_BYTES)))
    lanes, bands = max(lane_n, min(SPREAD, -(-shards // LANE))), band_n
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    trees = index.select(F.lit(0).alias("kind"), "at", "blob", (F.col("at") % lanes).alias("lane"), each(bands).alias("band"))
    passing = asked.select(F.lit(1).alias("kind"), "at", "blob", each(lanes).alias("lane"), (F.col("at") % bands).alias("band"))
    meet = trees.unionByName(passing).select((F.col("lane") * bands + F.col("band")).alias("task"), "kind", "at", "blob")
    meet = meet.repartitionById(lanes * bands, F.col("task")).sortWithinPartitions("task", "kind", "at").select("task", "kind", "blob")
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BLOBS))
    found = meet.mapInArrow(lambda batches: search(batches, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
