"""SimHash near-duplicates by meet-in-the-middle ball hashing.

fingerprints() gives a document's 64-bit fingerprint: a bit is 1 if it is set
in over half of the XXH64 hashes (seed 42) of its word shingles, repeats
included; A-Z count as a-z; fewer words than a shingle are one shingle, no
word gives fingerprint zero.

Two fingerprints at most 2 bits apart have one in the middle that is at most 1
bit from either. So each distinct fingerprint emits the 65 variants within one
bit, variants are shuffled, and those that meet are candidates, which are
verified. At most 65 distinct fingerprints lie within a bit of a variant, so a
variant's group is small whatever the data; its members are linked one to the
next, which keeps every component without all pairs. Copies are one
fingerprint before anything is emitted.

A null text counts as empty. Repeated rows are alike rows. Rows with a null id
have a fingerprint and a component as any other, but are no component's
smallest id; a component of such rows alone has a null id. Extra columns are
not read. An empty table gives no rows. Texts of any length are taken BLOCK
shingles at a time.

near_groups() finds groups whose shingle sets have a Jaccard similarity of at
least `similarity` (five words, 0.8), each shingle counted once. Such pairs differ in some ten of 64
bits, more than one ball of small radius reaches, so the fingerprint has
BANDS bands of 32 bits and each band is a ball of its own: its variants flip
any of the UNSURE bits whose sums are nearest to the threshold, which are the
bits that edits turn over. Two documents meet if in one band their differing
bits are among those; a pair of similarity 0.8 meets in some band 9 times in
10, one of 0.9 practically always (groups need one such link a member). All
documents that meet are tried, unless links that are found already join them:
first each against the smallest it meets in a band and the nearest smaller,
then against the one before it in another order, which joins large groups of
copies at little cost; then the rest: in a group of at most ODD members (most
chance meetings) each pair; of larger groups (pages made from one template) each
document is taken once, however often it meets others, and paired with those of
unlike components that share one of its rarest shingles. With the
shingles of those documents in the order of their frequency, two sets that are
similar share one of the first (1 - similarity) of either, so none is lost,
and what all pages of a template share comes last and pairs nothing; the first
that they share also has as many after it in either as they must share, which
few unlike pages fulfil. A pair is
tried by all bits of the fingerprint first, then by a bound that no similar
pair fails (parities of its shingles in 1,024 cells), then exactly, by
its shingles. The width is the same for any number of texts, and so is the
chance to meet; chance meetings grow with the square of the number: six
million texts make some 34 million pairs, tried by bits.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, joined_words, word_bounds, written
from .components import roots

BLOCK, ROWS = 1 << 15, 512
BANDS, WIDTH, UNSURE = 8, 32, 5
#: Longs of the parities that bound how alike two sets can be.
PARITIES = 16
#: Members up to which the pairs of a group, whose members are in unlike components, are tried one by one.
ODD = 4
#: Classes of sizes from a set to the least that can be similar to it.
SIZES = 4


def shingle_hashes(joined: bytes, words: int, seed: int = 42):
    """XXH64 of every shingle, as blocks of unsigned 64-bit numbers."""
    starts, ends = word_bounds(joined)
    if not len(starts):
        return
    words = min(words, len(starts))
    starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        a, z = starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist()
        yield np.fromiter((digest(joined[i:j], seed) for i, j in zip(a, z, strict=True)), np.uint64, len(a))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, least bit first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(joined_words(text, lower=True), words):
        counts += bit_counts(h)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                fps = pa.array([signed(fingerprint(t, words)) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), fps], names=["doc_id", "fp"])

    return arrow_map(rows, run, "doc_id long, fp long")


def ball_links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (fp: long) at most 2 bits apart, enough to keep every component."""
    masks = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << k)) for k in range(64)))
    emitted = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = emitted.select(before.alias("a"), F.col("fp").alias("b")).filter("a is not null").distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def components(fps: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, of the rows of fingerprints()."""
    fps = written(fps, "fps")
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = roots(ball_links(own.select("fp"))).withColumnRenamed("node", "fp")
    own = written(own.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    smallest = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(written(own.join(written(smallest, "least"), "root").select("fp", "component_id"), "components"), "fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- groups by similarity


def banded(text: str | None, words: int) -> tuple[list[int], list[int], list[int]]:
    """All bits of the bands, as signed longs; for each band the variants (of WIDTH bits); the number of distinct shingles and their parities()."""
    counts = np.zeros(BANDS * 64, np.int64)
    # each shingle once, as in jaccard()
    distinct = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(joined_words(text, lower=True), words)]))
    n = len(distinct)
    for at in range(0, n, BLOCK):
        h = distinct[at : at + BLOCK]
        for b in range(BANDS):
            x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (b + 1) & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            counts[64 * b : 64 * b + 64] += bit_counts(x * np.uint64(0xD6E8FEB86659FD93))
    margin = counts * 2 - n
    out = []
    for b in range(BANDS):
        m = margin[64 * b : 64 * b + WIDTH]
        value = int(np.packbits(np.pad(m > 0, (0, 64 - WIDTH)), bitorder="little").view("<u8")[0])
        flips = [1 << int(k) for k in np.argsort(np.abs(m), kind="stable")[:UNSURE]]
        out += [value ^ sum(c) for r in range(UNSURE + 1) for c in itertools.combinations(flips, r)]
    return np.packbits(margin > 0, bitorder="little").view("<i8").tolist(), out, [n, *parities(distinct)]


def parities(distinct: np.ndarray) -> list[int]:
    """Hashes are dealt to 64 * PARITIES cells; a bit is 1 if its cell has an odd number. As signed longs."""
    cells = np.bincount((distinct >> np.uint64(32)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES)
    return np.packbits(cells & 1, bitorder="little").view("<i8").tolist()


def jaccard(a: str | None, b: str | None, words: int) -> float:
    sets = []
    for t in (a, b):
        w = joined_words(t, lower=True).split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def labelled(met: DataFrame, root: DataFrame) -> DataFrame:
    """met (variant, node) with label, the component of the node."""
    label = root.select("node", F.col("root").alias("label"))
    return met.join(label, "node", "left").select("variant", "node", F.coalesce("label", "node").alias("label"))


def mixed(met: DataFrame) -> DataFrame:
    """variant, node, label, size: rows of the groups whose members are in unlike components, and how many a group has."""
    group = Window.partitionBy("variant")
    sizes = met.select("*", F.count(F.lit(1)).over(group).alias("size"), (F.min("label").over(group) != F.max("label").over(group)).alias("unlike"))
    return sizes.filter("unlike").drop("unlike")


def neighbours(rows: DataFrame) -> DataFrame:
    """a, b: for each member of a group the one before it by a hash, if in another component; no more pairs than rows."""
    order = Window.partitionBy("variant").orderBy(F.xxhash64("node"), "node")
    rows = rows.select("node", "label", F.lag("node").over(order).alias("other"), F.lag("label").over(order).alias("theirs"))
    return rows.filter("label <> theirs").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def close(a: str, b: str, similarity: float) -> Column:
    """Whether the bits of the bands in columns a and b may be those of a pair at the similarity sought."""
    # such a pair differs in share p of the bits; half as many again leaves room for chance
    overlap = 2 * similarity / (1 + similarity)
    far = int(1.5 * BANDS * 64 * float(np.arccos(overlap)) / np.pi)
    apart = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(BANDS)), F.lit(0))
    return apart <= far


def can_reach(a: str, b: str, similarity: float) -> Column:
    """Whether sets in columns a and b (their number and parities) can be as similar; false for no pair that is.

    A parity differs only where one set has a shingle that the other lacks, and sets of that similarity differ in
    (1 - similarity) / (1 + similarity) of their numbers' sum at most.
    """
    differ = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(1, PARITIES + 1)), F.lit(0))
    return differ <= (F.col(a)[0] + F.col(b)[0]) * ((1 - similarity) / (1 + similarity)) + 1e-6


def each_pair(rows: DataFrame, most: int) -> DataFrame:
    """a, b: all pairs in unlike components of the groups with at most `most` members."""
    order = Window.partitionBy("variant").orderBy("node")
    before = [F.struct(F.lag("node", k).over(order).alias("a"), F.lag("label", k).over(order).alias("theirs")) for k in range(1, most)]
    if not before:
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    rows = rows.filter(F.col("size") <= most).select("node", "label", F.array(*before).alias("before"))
    pairs = rows.select(F.explode(F.filter("before", lambda x: x["theirs"] != F.col("label"))).alias("x"), F.col("node").alias("b"))
    return pairs.select("x.a", "b").distinct()


def sharing(rows: DataFrame, texts: DataFrame, words: int, similarity: float, most: int) -> DataFrame:
    """a, b: documents of groups with more than `most` members, in unlike components, whose first shared of their rarest shingles allows the similarity.

    Each document is taken once, whatever the number of its groups. Shingles are in the order of their frequency among
    these documents. A set of n that is similar to another has one of its first n * (1 - similarity) + 1 in common with
    it, and what is left of either from the first common one on holds all they share.
    """
    held = rows.filter(F.col("size") > most).select("node", "label").distinct()
    bodies = texts.join(written(held, "open"), texts.doc_id == F.col("node")).select("node", "label", "text").dropDuplicates(["node"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(joined_words(t, lower=True), words)])).view(np.int64) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["node", "label", "hashes"])

    each = written(arrow_map(bodies, run, "node long, label long, hashes array<long>"), "shingles").select("node", "label", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"), (F.min("label") != F.max("label")).alias("shared"))
    # those that one document has alone come first and pair nothing: they are only counted
    often = written(often.filter("df > 1"), "often")
    node = Window.partitionBy("node")
    rank = F.col("n") - F.count(F.lit(1)).over(node) + F.row_number().over(node.orderBy("df", "h"))
    rare = each.join(often, "h").withColumn("rank", rank).filter(F.col("shared") & (F.col("rank") <= F.floor(F.col("n") * (1 - similarity) + 1e-6) + 1))
    rare = written(rare.select("h", "node", "label", "n", "rank"), "rare")
    # members of the commonest component aren't paired with each other
    parts = rare.groupBy("h", "label").agg(F.count(F.lit(1)).alias("rows"))
    main = parts.groupBy("h").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    rare = written(rare.join(written(main.filter("labels > 1").drop("labels"), "main"), "h"), "postings")
    x, y = (rare.toDF("h", c, *(f"{k}_{c}" for k in ("label", "n", "rank", "main"))) for c in ("x", "y"))
    # what is left of x allows only some sizes of y; they meet by classes of sizes, so that few are compared
    step = max(float(np.log(1 / similarity)), 0.01) / SIZES
    size = lambda n: F.floor(F.log(n) / step + 1e-9)
    left, ratio = F.col("n_x") - F.col("rank_x") + 1, (1 + similarity) / similarity
    low, high = F.col("n_x") * similarity - 1e-6, F.least(F.col("n_x") / similarity, left * ratio - F.col("n_x")) + 1e-6
    x = x.filter("label_x <> main_x").withColumn("size", F.explode(F.sequence(size(low), size(F.greatest(low, high)))))
    y = y.withColumn("size", size(F.col("n_y")))
    need = (F.col("n_x") + F.col("n_y")) * (similarity / (1 + similarity)) - 1e-6
    allowed = F.least(F.col("n_x") - F.col("rank_x"), F.col("n_y") - F.col("rank_y")) + 1 >= need
    both = x.join(y, ["h", "size"]).filter("label_x <> label_y and (label_y = main_y or x < y)").filter(allowed)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are close() and can_reach()."""
    of = lambda x: prints.select(F.col("node").alias(x), F.col("fp").alias(f"fp_{x}"), F.col("odd_cells").alias(f"odd_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(close("fp_a", "fp_b", similarity) & can_reach("odd_a", "odd_b", similarity)).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar, by their shingles."""
    pairs = written(pairs, "pairs")
    body = lambda x: rows.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(body("a"), "a").join(body("b"), "b").select("a", "b", "text_a", "text_b")

    def verify(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ok = [jaccard(x, y, words) >= similarity for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok))], names=["a", "b"])

    return arrow_map(both, verify, "a long, b long")


def near_groups(df: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", most: int = ODD) -> DataFrame:
    """doc_id, and group_id, the smallest doc_id of its group, of every row of df with an id."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    # rows of one text are one node, the smallest id of the text
    sums = rows.select("doc_id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    nodes = sums.groupBy("h", "m").agg(F.min("doc_id").alias("node"))
    members = written(sums.join(written(nodes, "nodes"), ["h", "m"]).select("doc_id", "node"), "members")
    heads = members.filter("doc_id = node").select("node").distinct()
    variants = 1 << UNSURE
    texts = rows.join(heads, rows.doc_id == heads.node, "left_semi")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = [banded(t, words) for t in part.column(1).to_pylist()]
                keys = pa.array([np.array(v, np.uint64).view(np.int64) for _, v, _ in made], pa.list_(pa.int64()))
                bits, cells = (pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), bits, keys, cells], names=["node", "fp", "variants", "odd_cells"])

    prints = written(arrow_map(texts, run, "node long, fp array<long>, variants array<long>, odd_cells array<long>"), "bands")
    emitted = prints.select("node", F.posexplode("variants").alias("at", "variant"))
    # the band above the variant: one number to shuffle, whose zeros lie together and pack well
    band = F.floor(F.col("at") / variants).cast("long")
    emitted = emitted.select("node", F.shiftleft(band, WIDTH).bitwiseOR(F.col("variant")).alias("variant"))
    # rows that meet no other go; the next smaller and the smallest of those that meet
    order = Window.partitionBy("variant").orderBy("node")
    before, after = F.lag("node").over(order), F.lead("node").over(order)
    first = F.first("node").over(order.rowsBetween(Window.unboundedPreceding, 0))
    met = emitted.select("variant", "node", before.alias("before"), after.alias("after"), first.alias("first"))
    met = written(met.filter("before is not null or after is not null").drop("after"), "met")
    nearest = met.filter("before is not null").groupBy("node", F.shiftrightunsigned("variant", WIDTH).alias("band")).agg(F.min("first").alias("first"), F.max("before").alias("before"))
    pairs = nearest.select(F.explode(F.array("before", "first")).alias("a"), F.col("node").alias("b")).filter("a < b").distinct()
    links = written(verified(near(pairs, prints, similarity), rows, words, similarity), "links")
    met = met.select("variant", "node")
    root = roots(links)
    links = written(links.union(verified(near(neighbours(labelled(met, root)), prints, similarity), rows, words, similarity)), "links")
    root = roots(links)
    still = written(mixed(labelled(met, root)), "mixed")
    if not still.isEmpty():
        rest = each_pair(still, most).union(sharing(still, rows, words, similarity, most)).distinct()
        links = written(links.union(verified(near(rest, prints, similarity), rows, words, similarity)), "links")
        root = roots(links)
    root = root.withColumnRenamed("node", "member")
    grouped = members.join(root, F.col("node") == F.col("member"), "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    grouped = written(grouped, "groups")
    least = written(grouped.groupBy("root").agg(F.min("doc_id").alias("group_id")), "least")
    return grouped.join(least, "root").select("doc_id", "group_id").distinct()
