"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learnt lexicon (words,
and openings of 4 to 6 letters), the densest WINDOW words, hits near second-
person words, shares of capitals, of punctuation and its repeats, of words
with letters swapped for digits or signs or spaced out, lengths.

Learning takes a bounded sample: the SAMPLE labelled ids with the least hash,
one row each (rows that share an id count once, by the least of their texts). The learnt lexicon is the TERMS terms with the largest likelihood
ratio between toxic and other texts of the sample; trees are grown on features
from a lexicon of the sample's other half, so that a term's weight is never
tried on the rows it came from; calibration uses scores from trees of other
folds. Only the sample's features and the terms reach the driver (at most
SAMPLE and TERMS rows). With no label of both kinds, every score is the share
of toxic labels (0 without labels).

A null text counts as empty; empty texts are scored by the same trees.
Repeated rows give repeated rows; labels that are null or belong to no row are
left out, an id with several labels counts as toxic if most are. Extra columns
of df are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, written

SAMPLE, TERMS, EVIDENCE, WINDOW, NEAR, ROWS, MEMO = 8_000, 4000, 25.0, 20, 6, 512, 300_000
TREES, DEPTH, RATE, BINS, LEAF_ROWS, FOLDS = 60, 3, 0.15, 32, 8, 3

INSULTS = set(
    "idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage pathetic worthless disgusting clown jerk bastard bitch asshole shit fuck fucking crap retard freak pig ugly hate kill "
    "dumm idioten arschloch scheisse schwein dreck abschaum imbécile connard salaud merde ordure crétin débile estúpido idiota imbécil basura mierda asqueroso cabrón".split()
)
SECOND = set("you your yours u ur yourself youre du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os tus".split())
_LEET = str.maketrans("@4301!|$5789", "aaeoiiisstbg")
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”‘’…¿¡–—"
_INNER = re.compile(r"[^\W\d_]+(?:[.*\-_~]{1,2}[^\W\d_]+)+")
CAPITALS = bytes(range(65, 91))
SIGNS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_REPEATS = re.compile(r"([!-/:-@\[-`{-~])\1+")

FEATURES = (
    "insults", "insults_per_word", "learnt", "learnt_per_word", "heaviest", "weight_per_word", "openings", "openings_per_word", "densest",
    "near_second", "second_per_word", "capitals", "capital_words", "signs", "sign_repeats", "obfuscated", "obfuscated_hits", "spaced", "log_words",
)


def bare(token: str) -> str:
    return token.strip(_EDGE).lower()


def plain(token: str) -> str | None:
    """The word that a token with swapped or parted letters stands for; None if it has none."""
    word = token.strip(_EDGE.replace("@", "").replace("$", "").replace("!", "")).lower()
    if _INNER.fullmatch(word):
        return re.sub(r"[.*\-_~]", "", word)
    swapped = word.translate(_LEET)
    if swapped != word and swapped.isalpha() and any(c.isalpha() for c in word):
        return swapped
    return None


def terms_of(word: str) -> list[str]:
    """The word, and its openings marked by a star."""
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]


class Reader:
    """Features of texts, by a lexicon of term weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.memo: dict[str, int] = {}
        self.records = [(0, 0.0, 0.0, 0, 0, 0, 0)]  # insult, word weight, opening weight, second person, obfuscated, its hit, one letter

    def code(self, token: str) -> int:
        word, other = bare(token), plain(token)
        words = [word] if other is None or other == word else [word, other]
        insult = int(any(w in INSULTS for w in words))
        weight = max(self.lexicon.get(w, 0.0) for w in words)
        opening = max((self.lexicon.get(t, 0.0) for w in words for t in terms_of(w)[1:]), default=0.0)
        record = (insult, weight, opening, int(word in SECOND), int(other is not None), int(other is not None and (other in INSULTS or other in self.lexicon)), int(len(word) == 1))
        if record == self.records[0]:
            return 0
        self.records.append(record)
        return len(self.records) - 1

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        tokens = text.split()
        n = len(tokens)
        if len(self.memo) > MEMO:
            self.memo, self.records = {}, self.records[:1]
        memo = self.memo
        for t in set(tokens):
            if t not in memo:
                memo[t] = self.code(t)
        codes = np.fromiter(map(memo.__getitem__, tokens), np.int64, n)
        at = np.flatnonzero(codes)
        rec = np.array([self.records[c] for c in codes[at].tolist()], np.float64).reshape(-1, 7)
        toxic = (rec[:, 0] > 0) | (rec[:, 1] > 0) | (rec[:, 2] > 0)
        hits, second = at[toxic], at[rec[:, 3] > 0]
        spaced = self._spaced(tokens, at[rec[:, 6] > 0])
        densest = near = 0
        if len(hits):
            densest = int((np.searchsorted(hits, hits + WINDOW) - np.arange(len(hits))).max())
            if len(second):
                gap = np.minimum(np.abs(hits - second[np.minimum(np.searchsorted(second, hits), len(second) - 1)]), np.abs(hits - second[np.maximum(np.searchsorted(second, hits) - 1, 0)]))
                near = int((gap <= NEAR).sum())
        w, size = max(1, n), max(1, len(raw))
        learnt, openings, insults = int((rec[:, 1] > 0).sum()), int((rec[:, 2] > 0).sum()), int(rec[:, 0].sum())
        heaviest = float(max(rec[:, 1].max(), rec[:, 2].max())) if len(rec) else 0.0
        capitals = len(raw) - len(raw.translate(None, CAPITALS))
        upper = sum(len(t) > 2 and t.isupper() for t in tokens) if capitals * 4 > size else 0
        signs = len(raw) - len(raw.translate(None, SIGNS))
        repeats = sum(1 for _ in _REPEATS.finditer(text)) if signs else 0
        return [
            insults, insults / w, learnt, learnt / w, heaviest, float(np.maximum(rec[:, 1], rec[:, 2]).sum()) / w, openings, openings / w, densest,
            near, len(second) / w, capitals / size, upper / w, signs / size, repeats / w, float(rec[:, 4].sum()) / w, float(rec[:, 5].sum()), spaced, math.log1p(n),
        ]

    def _spaced(self, tokens: list[str], singles: np.ndarray) -> int:
        """Words written letter by letter that the lexicons know."""
        found = 0
        for run in np.split(singles, np.flatnonzero(np.diff(singles) != 1) + 1):
            if 4 <= len(run) <= 12:
                word = "".join(bare(tokens[i]) for i in run)
                found += word in INSULTS or word in self.lexicon
        return found


# ---- trees


def _leaf(g: float, h: float) -> float:
    return -g / (h + 1.0)


class Trees:
    """Boosted trees on quantile bins for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        share = min(1 - 1e-3, max(1e-3, float(y.mean())))
        self.base = math.log(share / (1 - share))
        self.trees: list[tuple] = []
        binned = self.bin(x)
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, p - y, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            raw += self._apply(tree, binned)

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def _grow(self, x, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * LEAF_ROWS:
            for f, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                b = x[rows, f]
                n = np.cumsum(np.bincount(b, minlength=len(edges) + 1))[:-1]
                gl, hl = (np.cumsum(np.bincount(b, weights=v[rows], minlength=len(edges) + 1))[:-1] for v in (g, h))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < LEAF_ROWS) | (n > len(rows) - LEAF_ROWS)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at)
        if best[1] is None:
            return (RATE * _leaf(gs, hs),)
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[low], depth - 1), self._grow(x, g, h, rows[~low], depth - 1)

    def _apply(self, tree, x):
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        f, at, low, high = tree
        return np.where(x[:, f] <= at, self._apply(low, x), self._apply(high, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bin(x)
        return sum((self._apply(t, b) for t in self.trees), np.full(len(x), self.base))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on raw: the middles of pooled blocks and their means."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, r])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """Lexicon, trees and calibration; score() gives the share of toxic texts among texts like this."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, knots, share: float):
        self.lexicon, self.trees, self.knots, self.share = lexicon, trees, knots, share

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        fitted = np.interp(raw, *self.knots)
        # a little of the trees' own share keeps the order where the calibration is flat
        out = 0.98 * fitted + 0.02 / (1 + np.exp(-raw))
        return np.where((fitted >= 0.5) & (out < 0.5), 0.5, out)


def lexicon_of(counts: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Weights of the terms (term, toxic texts, other texts) that tell toxic texts apart."""
    out = []
    for term, a, b in counts:
        rate = (a + b) / max(1, toxic + other)
        ratio = lambda k, n: k * math.log(k / (n * rate)) if k else 0.0  # noqa: B023, E731
        evidence = 2 * (ratio(a, toxic) + ratio(b, other) + (toxic - a) * math.log(max(1e-12, 1 - a / toxic) / (1 - rate)) + (other - b) * math.log(max(1e-12, 1 - b / other) / (1 - rate))) if 0 < rate < 1 else 0.0
        weight = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1))
        if weight > 1 and evidence >= EVIDENCE:
            out.append((-evidence, term, weight))
    return {t: w for _, t, w in sorted(out)[:TERMS]}


def _features_of(df: DataFrame, text: str, lexicons: list[dict[str, float]], which: str) -> DataFrame:
    """id, fold, toxic of df and the features of text, by the lexicon numbered in column which."""
    names = [c for c in df.columns if c != text]
    rows = df.select(*names, text)

    def run(batches):
        readers = [Reader(x) for x in lexicons]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                use = part.column(names.index(which)).to_pylist()
                out = [readers[k].features(t) for k, t in zip(use, part.column(len(names)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(out, pa.list_(pa.float64()))], names=[*names, "x"])

    return arrow_map(rows, run, ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names) + ", x array<double>")


def fit(df: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model learnt from the rows of labels for which learn holds (a condition on a column id), SAMPLE at most."""
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("t")).filter("id is not null and t is not null").filter(learn)
    known = known.groupBy("id").agg((F.avg("t") > 0.5).cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    known = written(known.withColumn("fold", F.pmod(F.hash("id"), F.lit(6)).cast("int")), "labels")
    texts = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # at most SAMPLE rows of 16 bytes; of rows that share an id one, the one with the least text
    sample = written(texts.join(F.broadcast(known), "id").groupBy("id", "toxic", "fold").agg(F.min("text").alias("text")), "sample")
    found = {(r.toxic, r.half): r.n for r in sample.groupBy("toxic", (F.col("fold") % 2).alias("half")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = [found.get((t, 0), 0) + found.get((t, 1), 0) for t in (0, 1)]
    if not all(total):
        return Model({}, None, None, total[1] / sum(total) if sum(total) else 0.0)
    word = F.lower(F.btrim(F.col("w"), F.lit(_EDGE)))
    words = sample.select("toxic", (F.col("fold") % 2).alias("half"), F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w"), "id").select("toxic", "half", "id", word.alias("w")).filter("length(w) between 3 and 40")
    terms = F.array("w", *(F.when(F.length("w") > n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in (4, 5, 6)))
    each = words.select("toxic", "half", "id", F.explode(terms).alias("term")).filter("term is not null").distinct()
    sums = [F.sum((F.col("toxic").eqNullSafe(t) & F.col("half").eqNullSafe(h)).cast("int")).alias(f"n{t}{h}") for t in (0, 1) for h in (0, 1)]
    # only terms that could pass: as often as EVIDENCE asks of a term that no other text has
    often = max(3, int(EVIDENCE / 2 / math.log(1 + sum(total) / max(1, total[1]))) // 2)
    counts = each.groupBy("term").agg(*sums).filter(F.col("n10") + F.col("n11") >= often)
    lift = (F.col("n10") + F.col("n11")) / total[1] / ((F.col("n00") + F.col("n01") + 0.5) / total[0])
    counts = counts.filter(lift > 1.5).orderBy(F.desc(lift * F.sqrt(F.col("n10") + F.col("n11"))), "term").limit(4 * TERMS).collect()
    n = lambda t, h: found.get((t, h), 0)
    by_half = [lexicon_of([(r.term, r[f"n1{h}"], r[f"n0{h}"]) for r in counts if r[f"n1{h}"]], n(1, h), n(0, h)) if n(1, h) and n(0, h) else {} for h in (0, 1)]
    full = lexicon_of([(r.term, r.n10 + r.n11, r.n00 + r.n01) for r in counts], total[1], total[0])
    rows = _features_of(sample.withColumn("other", 1 - F.col("fold") % 2).select("id", "toxic", "fold", "other", "text"), "text", by_half, "other").orderBy("id").collect()
    x, y = np.array([r.x for r in rows], np.float64), np.array([r.toxic for r in rows], np.float64)
    fold = np.array([r.fold % FOLDS for r in rows])
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        inside, outside = fold != k, fold == k
        if outside.any():
            raw[outside] = Trees(x[inside], y[inside]).raw(x[outside]) if inside.any() else 0.0
    return Model(full, Trees(x, y), isotonic(raw, y), total[1] / sum(total))


def scores(df: DataFrame, model: Model, keys: list[str] | None = None, text: str = "text", score: str = "score") -> DataFrame:
    """The keys (all columns, if None) of every row of df, and its score."""
    keys = [c for c in (df.columns if keys is None else keys) if c != score]
    own_text = [] if text in keys else [F.col(text).alias("__text")]
    rows = df.select(*keys, *own_text)
    body = rows.columns.index("__text" if own_text else text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        reader = Reader(own.lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.array([reader.features(t) for t in part.column(body).to_pylist()], np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keys))), pa.array(own.score(x), pa.float64())], names=[*keys, score])

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField(score, T.DoubleType())])
    return arrow_map(rows, run, schema)


def learnable(id: Column) -> Column:
    """The contract's rows to learn from: those whose crc32 of the id as text isn't divisible by 5."""
    return F.crc32(id.cast("string").cast("binary")) % 5 != 0
