"""Every query by name, with the SQL that must give the same rows.

The queries put the operators to the supplied tables, which hold no documents
of the kind the operators are made for: they show that the relations are
right (the least candidate, the union of boxes, merging to a fixpoint), on
rows that stand for objects. Parsing, rasters and writing are tested in tests/.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import calculator, color, geometry, sets, text
from leafmill.operators import candidates, compare, graph, lookup, ordered, presets, usage
from leafmill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c: Column | str, digits: int = 4) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


# ---- candidates

BEST_SQL = """
SELECT l_orderkey, l_extendedprice AS size, l_linenumber AS rank, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) = 1
"""


@query(BEST_SQL)
def argmin_candidate(spark, sf):
    """Lines are candidates for their order; the cheapest wins, of equal ones the first."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("size"), F.col("l_linenumber").alias("rank"), "l_partkey")
    return candidates.smallest(lines, ["l_orderkey"], "size", "rank", ["l_partkey"])


def _choices(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 5).alias("stored"))
    both = orders.join(argmin_candidate(spark, sf), "l_orderkey", "left")
    return both.withColumn("taken", candidates.never_grow(both, F.col("size"), F.col("stored")))


NEVER_GROW_SQL = f"""
SELECT o_orderkey AS l_orderkey, CASE WHEN size < o_totalprice / 5 THEN 'recoded' ELSE 'kept' END AS action,
  round(o_totalprice / 5, 4) + 0.0 AS bytes_in, round(CASE WHEN size < o_totalprice / 5 THEN size ELSE o_totalprice / 5 END, 4) + 0.0 AS bytes_out
FROM orders LEFT JOIN ({BEST_SQL}) b ON l_orderkey = o_orderkey
"""


@query(NEVER_GROW_SQL)
def never_grow(spark, sf):
    df = _choices(spark, sf)
    out = F.when(F.col("taken"), F.col("size")).otherwise(F.col("stored"))
    return df.select("l_orderkey", F.when(F.col("taken"), "recoded").otherwise("kept").alias("action"), _r("stored").alias("bytes_in"), _r(out).alias("bytes_out"))


@query(f"""
WITH c AS ({NEVER_GROW_SQL})
SELECT action, count(*) AS n, round(sum(bytes_in), 1) + 0.0 AS total_in, round(sum(bytes_out), 1) + 0.0 AS total_out FROM c GROUP BY action
""")
def never_grow_totals(spark, sf):
    return never_grow(spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("bytes_in"), 1).alias("total_in"), _r(F.sum("bytes_out"), 1).alias("total_out"))


@query("""
SELECT user_id, event_id, round(coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 100.0), 6) + 0.0 AS bytes_before,
  round(value, 6) + 0.0 AS bytes_after FROM events
""")
def stage_ledger(spark, sf):
    df = candidates.ledger(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", F.lit(100.0))
    return df.select("user_id", "event_id", _r("before", 6).alias("bytes_before"), _r("value", 6).alias("bytes_after"))


@query("""
SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 50
""")
def first_n_problems(spark, sf):
    return candidates.first_n(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], 50).select("user_id", "event_id", "event_type")


@query("""
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' OR l_linestatus = 'O' OR l_quantity > 40 THEN
    concat_ws('+', CASE WHEN l_returnflag = 'R' THEN 'reduced' END, CASE WHEN l_linestatus = 'O' THEN 'clipped' END, CASE WHEN l_quantity > 40 THEN 'downsampled' END)
  ELSE 'recoded' END AS action FROM lineitem
""")
def action_labels(spark, sf):
    steps = {"reduced": F.col("l_returnflag") == "R", "clipped": F.col("l_linestatus") == "O", "downsampled": F.col("l_quantity") > 40}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", candidates.action(steps).alias("action"))


# ---- usage


@query("""
SELECT l_partkey, round(min(least(p_size * 40 / (l_quantity / 72), p_retailprice / (l_linenumber * 9 / 72.0))), 4) + 0.0 AS dpi
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey
""")
def min_effective_resolution(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    dpi = usage.min_resolution(F.col("p_size") * 40, F.col("p_retailprice"), F.col("l_quantity"), F.col("l_linenumber") * 9.0)
    return df.groupBy("l_partkey").agg(_r(dpi).alias("dpi"))


@query("""
SELECT l_partkey, CASE WHEN bool_and(l_quantity >= 3) THEN min(l_quantity) END AS x0, CASE WHEN bool_and(l_quantity >= 3) THEN min(l_discount) END AS y0,
  CASE WHEN bool_and(l_quantity >= 3) THEN max(l_quantity + l_linenumber) END AS x1, CASE WHEN bool_and(l_quantity >= 3) THEN max(l_discount + l_tax) END AS y1
FROM lineitem GROUP BY l_partkey
""")
def union_box_null_any(spark, sf):
    box = F.when(F.col("l_quantity") >= 3, F.struct(F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), (F.col("l_quantity") + F.col("l_linenumber")).alias("x1"), (F.col("l_discount") + F.col("l_tax")).alias("y1")))
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(usage.union_box(box).alias("box")).select("l_partkey", *(F.col(f"box.{c}").alias(c) for c in geometry.SIDES))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def distinct_sets(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(usage.distinct_sorted(F.col("event_type")), ",").alias("kinds"))


@query("""
WITH entries AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS name FROM lineitem),
used AS (SELECT l_suppkey AS owner, l_partkey AS name, l_quantity > 49 AND l_discount > 0.08 AS whole FROM lineitem WHERE l_returnflag = 'R')
SELECT owner, name FROM entries e WHERE owner IN (SELECT owner FROM used GROUP BY owner HAVING NOT bool_or(whole))
  AND NOT EXISTS (SELECT 1 FROM used u WHERE u.owner = e.owner AND u.name = e.name)
""")
def keep_whole_or_drop(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("name"), ((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.08)).alias("whole"), "l_returnflag")
    return usage.removable(lines.select("owner", "name").distinct(), lines.filter("l_returnflag = 'R'"), ["owner"], "name", "whole")


@query("""
SELECT o_custkey, bool_and(l_orderkey IS NOT NULL) AS covered,
  CASE WHEN bool_and(l_orderkey IS NOT NULL) THEN string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) END AS flags
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 2) l ON l_orderkey = o_orderkey GROUP BY o_custkey
""")
def covering_group_fail(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, sf, "lineitem").filter("l_linenumber = 2").select("l_orderkey", "l_returnflag")
    out = lookup.all_or_none(orders, lines, "l_orderkey", "o_custkey", "l_returnflag")
    return out.select("o_custkey", "covered", F.array_join("values", ",").alias("flags"))


# ---- graph


def _texts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.lit(0).alias("doc"), F.col("doc_id").alias("id"), F.col("text").alias("body"))


@query("SELECT doc_id AS id, keep FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents) WHERE keep <> doc_id")
def dedupe_survivors(spark, sf):
    return graph.survivors(_texts(spark, sf)).select("id", "keep")


@query("SELECT l.doc_id AS src, d.keep AS dst, toxic FROM labels l JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents) d USING (doc_id)")
def repoint(spark, sf):
    edges = table(spark, sf, "labels").select(F.lit(0).alias("doc"), F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"), "toxic")
    return graph.repoint(edges, graph.survivors(_texts(spark, sf))).select("src", "dst", "toxic")


CHAIN = "SELECT doc_id AS id, md5(text) AS body, doc_id // 2 AS dst FROM documents"


@query(f"""
WITH o AS ({CHAIN}),
p1 AS (SELECT id, min(id) OVER (PARTITION BY body, dst) AS keep FROM o),
o2 AS (SELECT o.id, o.body, k.keep AS dst FROM o JOIN p1 s ON s.id = o.id AND s.keep = o.id JOIN p1 k ON k.id = o.dst),
p2 AS (SELECT id, min(id) OVER (PARTITION BY body, dst) AS keep FROM o2),
m2 AS (SELECT p1.id, p2.keep FROM p1 JOIN p2 ON p2.id = p1.keep),
o3 AS (SELECT o.id, o.body, k.keep AS dst FROM o JOIN m2 s ON s.id = o.id AND s.keep = o.id JOIN m2 k ON k.id = o.dst),
p3 AS (SELECT id, min(id) OVER (PARTITION BY body, dst) AS keep FROM o3),
m3 AS (SELECT m2.id, p3.keep FROM m2 JOIN p3 ON p3.id = m2.keep)
SELECT id, keep FROM m3
""")
def dedupe_fixpoint(spark, sf):
    """Documents refer to the one of half their id; equal text and reference merge, three passes."""
    objects = _texts(spark, sf).withColumn("body", F.md5("body"))
    edges = objects.select("doc", F.col("id").alias("src"), F.lit("next").alias("slot"), F.expr("id div 2").alias("dst"))
    return graph.dedupe_fixpoint(objects, edges, 3).select("id", "keep")


@query("SELECT doc_id AS src, doc_id AS dst FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def dangling_refs(spark, sf):
    edges = table(spark, sf, "labels").select(F.lit(0).alias("doc"), F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"))
    objects = table(spark, sf, "documents").filter("lang = 'en'").select(F.lit(0).alias("doc"), F.col("doc_id").alias("id"))
    return graph.dangling(edges, objects).select("src", "dst")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def orphans(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_anti").select("doc_id")


@query("""
SELECT o_custkey, bool_and(n_nationkey IS NOT NULL) AS intact FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey GROUP BY o_custkey
""")
def integrity(spark, sf):
    parents = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return graph.integrity(parents, table(spark, sf, "nation").filter("n_regionkey < 3"), "n_nationkey", "o_custkey")


LINKS = "SELECT doc_id AS src, unnest([(doc_id * 7 + 3) % (SELECT max(doc_id) + 1 FROM documents), doc_id // 3]) AS dst FROM documents WHERE lang <> 'en'"


@query(f"""
WITH RECURSIVE e AS ({LINKS}), r AS (SELECT CAST(8 AS BIGINT) AS id UNION SELECT dst FROM e JOIN r ON src = id) SELECT id FROM r
""")
def reachable(spark, sf):
    docs = table(spark, sf, "documents")
    top = docs.agg((F.max("doc_id") + 1).alias("n"))
    ends = F.array((F.col("doc_id") * 7 + 3) % F.col("n"), F.expr("doc_id div 3"))
    edges = docs.filter("lang <> 'en'").crossJoin(F.broadcast(top)).select(F.lit(0).alias("doc"), F.col("doc_id").alias("src"), F.explode(ends).alias("dst"))
    return graph.reachable(edges, spark.createDataFrame([(0, 8)], "doc int, id bigint")).select("id")


@query(f"""
WITH RECURSIVE e AS ({LINKS}), r AS (SELECT CAST(8 AS BIGINT) AS id UNION SELECT dst FROM e JOIN r ON src = id)
SELECT doc_id AS id, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS new FROM documents WHERE doc_id IN (SELECT id FROM r)
""")
def prune_and_renumber(spark, sf):
    """What is reached is numbered anew within each of sixteen groups."""
    ids = reachable(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return ids.select("id", F.row_number().over(Window.partitionBy(F.col("id") % 16).orderBy("id")).cast("bigint").alias("new"))


# ---- lookups


@query("""
WITH entries AS (
  SELECT c_nationkey AS k, c_mktsegment AS name, 0 AS depth, min(c_custkey) AS ref FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2
  UNION ALL SELECT n_nationkey, 'BUILDING', 1, n_regionkey FROM nation
  UNION ALL SELECT n_nationkey, 'MACHINERY', 2, 100 + n_regionkey FROM nation
), hits AS (
  SELECT c_custkey, e.depth, e.ref FROM customer LEFT JOIN entries e ON e.k = c_nationkey AND e.name = c_mktsegment
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY e.depth) = 1
) SELECT c_custkey, coalesce(depth, -1) AS depth, coalesce(ref, -1) AS ref FROM hits
""")
def scoped_lookup(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    own = c.filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("name")).agg(F.lit(0).alias("depth"), F.min("c_custkey").alias("ref"))
    outer = n.select(F.col("n_nationkey").alias("k"), F.lit("BUILDING").alias("name"), F.lit(1).alias("depth"), F.col("n_regionkey").cast("bigint").alias("ref"))
    last = n.select(F.col("n_nationkey").alias("k"), F.lit("MACHINERY").alias("name"), F.lit(2).alias("depth"), (F.col("n_regionkey") + 100).cast("bigint").alias("ref"))
    uses = c.select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("name"))
    return lookup.scoped(uses, own.union(outer).union(last), ["k", "name"], "c_custkey", "depth", ["ref"]).fillna(-1)


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey BETWEEN 10 AND 40 THEN l_partkey - 10 WHEN l_partkey BETWEEN 30 AND 90 THEN l_partkey + 1000 WHEN l_partkey BETWEEN 85 AND 300 THEN 7 ELSE 0 END AS cid, l_partkey FROM lineitem
""")
def range_lookup(spark, sf):
    ranges = spark.createDataFrame([(0, 10, 40, -10, None), (1, 30, 90, 1000, None), (2, 85, 300, None, 7)], "ordinal int, low bigint, high bigint, shift bigint, fixed bigint")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    hit = lookup.range_join(rows, "l_partkey", ranges, 64)
    return hit.select("l_orderkey", "l_linenumber", F.coalesce("fixed", F.col("l_partkey") + F.col("shift"), F.lit(0)).alias("cid"), "l_partkey")


@query("""
SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 25 THEN 1 ELSE 2 END AS part,
  round(CASE WHEN p_size < 10 THEN p_size / 10.0 WHEN p_size < 25 THEN 1 - (p_size - 10) / 15.0 ELSE (p_size - 25) / 25.0 END, 6) + 0.0 AS out FROM part
""")
def stitched_range(spark, sf):
    one = lambda x: [x]
    out = calculator.stitched(F.col("p_size"), [0, 50], [one, one, one], [10, 25], [0, 1, 1, 0, 0, 1])[0]
    part = lookup.by_range(None, F.col("p_size"), [(0, 9, 0), (10, 24, 1), (25, 50, 2)])
    return table(spark, sf, "part").select("p_partkey", part.alias("part"), _r(out, 6).alias("out"))


# ---- ordered scans


@query("SELECT doc_id, CAST(coalesce(sum(ceil(octet_length(encode(text)) / 4.0) * 4) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 12 AS BIGINT) AS at FROM documents")
def running_offsets(spark, sf):
    df = table(spark, sf, "documents")
    return df.select("doc_id", ordered.offsets(df, ["lang"], ["doc_id"], F.octet_length("text"), 4, 12).cast("bigint").alias("at"))


@query("""
WITH s AS (SELECT *, row_number() OVER w AS i, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS given FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)),
g AS (SELECT *, last_value(CASE WHEN given IS NOT NULL THEN i END IGNORE NULLS) OVER w AS since, last_value(given IGNORE NULLS) OVER w AS base FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT l_suppkey, l_orderkey, l_linenumber, coalesce(base + i - since, -1) AS code FROM g
""")
def running_code(spark, sf):
    df = table(spark, sf, "lineitem")
    code = ordered.running_code(df, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))
    return df.select("l_suppkey", "l_orderkey", "l_linenumber", F.coalesce(code.cast("bigint"), F.lit(-1)).alias("code"))


@query("SELECT l_orderkey, l_linenumber, l_partkey - coalesce(lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey), 0) AS delta FROM lineitem")
def delta_code(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select("l_orderkey", "l_linenumber", ordered.deltas(df, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey").alias("delta"))


@query("""
WITH w AS (SELECT doc_id, string_split(regexp_replace(concat('/', replace(text, ' the ', ' Tf ')), '[\\t\\n\\f\\r]', ' ', 'g'), ' ') AS toks FROM documents),
t AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM w),
n AS (SELECT doc_id, tok, lead(tok, 2) OVER (PARTITION BY doc_id ORDER BY i) AS third FROM t)
SELECT doc_id, coalesce(string_agg(DISTINCT substr(tok, 2), ',' ORDER BY substr(tok, 2)) FILTER (WHERE third = 'Tf' AND starts_with(tok, '/')), '') AS names FROM n GROUP BY doc_id
""")
def triples(spark, sf):
    df = table(spark, sf, "documents")
    return df.select("doc_id", F.array_join(ordered.appearance_fonts(F.concat(F.lit("/"), F.replace(F.coalesce("text", F.lit("")), F.lit(" the "), F.lit(" Tf ")))), ",").alias("names"))


@query("""
WITH s AS (SELECT user_id, event_id, ts, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS t FROM events)
SELECT user_id, event_id, CAST(t - least(0, min(t) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS depth FROM s
""")
def stack_depth(spark, sf):
    df = table(spark, sf, "events").withColumn("operator", F.when(F.col("event_type") == "click", "q").when(F.col("event_type") == "purchase", "Q"))
    return ordered.stack_depth(df, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.col("depth").cast("bigint").alias("depth"))


# ---- comparing


@query("""
WITH h AS (SELECT event_type, user_id % 50 AS u, event_id < (SELECT max(event_id) / 2 FROM events) AS early FROM events),
n AS (SELECT u, count(*) FILTER (WHERE NOT early) AS now, count(*) FILTER (WHERE early) AS was FROM h GROUP BY u)
SELECT u, was, now FROM n WHERE now > was
""")
def left_default_zero(spark, sf):
    df = table(spark, sf, "events").withColumn("u", F.col("user_id") % 50)
    top = df.agg((F.max("event_id") / 2).alias("half"))
    df = df.crossJoin(F.broadcast(top))
    return compare.regressions(df.filter("event_id >= half"), df.filter("event_id < half"), "u")


@query("""
WITH d AS (SELECT CAST(date_part('day', ts) AS INTEGER) AS day, event_type, value FROM events),
a AS (SELECT day, sum(value) AS v FROM d WHERE event_type = 'click' AND day > 3 GROUP BY day), b AS (SELECT day, sum(value) AS v FROM d WHERE event_type = 'view' AND day < 25 GROUP BY day)
SELECT coalesce(a.day, b.day) AS day, round(CASE WHEN a.v IS NULL OR b.v IS NULL THEN 0.0 ELSE least(a.v, b.v) / greatest(a.v, b.v) END, 6) + 0.0 AS score FROM a FULL JOIN b ON a.day = b.day
""")
def page_compare(spark, sf):
    d = table(spark, sf, "events").withColumn("day", F.dayofmonth("ts"))
    side = lambda kind, days: d.filter((F.col("event_type") == kind) & days).groupBy("day").agg(F.sum("value").alias("v"))
    score = F.least("a.v", "b.v") / F.greatest("a.v", "b.v")
    out = compare.pages(side("click", F.col("day") > 3), side("view", F.col("day") < 25), "day", score)
    return out.select("day", _r("score", 6).alias("score"))


@query("""
WITH r AS (SELECT o_orderkey, o_totalprice AS input, sum(l_extendedprice) FILTER (WHERE l_returnflag <> 'N') AS ours, max(l_extendedprice) FILTER (WHERE l_linenumber = 3) AS tool, min(1 - l_discount) AS ssim
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT round(sum(input), 1) + 0.0 AS input, round(sum(ours), 1) + 0.0 AS ours, round(sum(input) FILTER (WHERE ours IS NOT NULL), 1) + 0.0 AS input_with_ours, round(min(ssim), 4) + 0.0 AS least_ssim, count(*) AS files,
  round(sum(tool) FILTER (WHERE ours IS NOT NULL), 1) + 0.0 AS tool_total, round(sum(ours) FILTER (WHERE tool IS NOT NULL), 1) + 0.0 AS ours_on_tool, count(*) FILTER (WHERE ours IS NOT NULL AND tool IS NOT NULL) AS tool_files FROM r
""")
def score_totals(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))).alias("ours"), F.max(F.when(F.col("l_linenumber") == 3, F.col("l_extendedprice"))).alias("tool"), F.min(1 - F.col("l_discount")).alias("ssim")
    )
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("input")).join(lines, "o_orderkey", "left")
    out = compare.score_totals(rows, ["tool"])
    return out.select(*(F.col(c) if c in ("files", "tool_files") else _r(c, 4 if c == "least_ssim" else 1).alias(c) for c in out.columns))


@query("""
WITH e AS (SELECT vec_id, floor(abs(embedding[i]) * 255) AS a, floor(abs(embedding[65 - i]) * 255) AS b FROM embeddings, range(1, 65) t(i))
, s AS (SELECT vec_id, count(*) AS n, sum(a) / 64 AS ma, sum(b) / 64 AS mb, sum(a * a) / 64 AS aa, sum(b * b) / 64 AS bb, sum(a * b) / 64 AS ab FROM e GROUP BY vec_id)
SELECT vec_id, round((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225)), 6) + 0.0 AS score FROM s
""")
def block_ssim(spark, sf):
    pixels = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    at = lambda i: (F.floor(i / 8).alias("y"), (i % 8).alias("x"))
    v = F.floor(F.abs(F.col("x").cast("double")) * 255).alias("v")
    a, b = pixels.select("vec_id", v, *at(F.col("i"))), pixels.select("vec_id", v, *at(63 - F.col("i")))
    return compare.similarity(a, b, ["vec_id"]).select("vec_id", _r("score", 6).alias("score"))


# ---- presets


@query("""
WITH p(preset) AS (VALUES ('less'), ('standard'), ('more')), e(file, preset) AS (VALUES (3, NULL), (5, 'more'), (6, 'standard'))
SELECT p_partkey AS file, p.preset, p_size % 3 <> 0 AS ignored, EXISTS (SELECT 1 FROM e WHERE e.file = p_partkey AND (e.preset IS NULL OR e.preset = p.preset)) AS expected
FROM part CROSS JOIN p WHERE p_size % 3 = 0 OR p.preset = 'standard'
""")
def presets_cross(spark, sf):
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), (F.col("p_size") % 3 == 0).alias("chosen"))
    e = spark.createDataFrame([(3, None), (5, "more"), (6, "standard")], "file bigint, preset string")
    return presets.expected(presets.trials(files, presets.presets(spark), "chosen"), e).select("file", "preset", "ignored", "expected")


@query("""
SELECT * FROM (VALUES ('less', 17, 5, 0, 'none'), ('standard', 9, 7, 3, 'threads|metadata|piece-info|thumbnails|spider|alternates|output-intents'),
  ('more', 17, 5, 3, 'threads|metadata|piece-info|struct-tree|thumbnails|spider|alternates')) t(preset, bitonal, continuous, indexed, strip)
""")
def preset_sets(spark, sf):
    p = presets.presets(spark)
    return p.select("preset", "bitonal", F.col("continuous"), "indexed", sets.text(F.col("strip"), sets.STRIP).alias("strip"))


@query("""
WITH p(preset, target, threshold, rgb, clip) AS (VALUES ('less', 200.0, 400.0, false, false), ('standard', 150.0, 150.0, false, true), ('more', 72.0, 110.0, true, true)),
i AS (SELECT p_partkey, CAST(p_size * 20 AS BIGINT) AS w, CAST(p_retailprice / 4 AS BIGINT) AS h, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 11.0 END AS dpi, p_size % 7 = 0 AS keyed,
  CASE p_size % 4 WHEN 0 THEN 'Gray' WHEN 1 THEN 'RGB' WHEN 2 THEN 'CMYK' ELSE 'Indexed' END AS space, p_size % 2 = 0 AS profile, CASE WHEN p_size % 8 = 0 THEN 1 ELSE 8 END AS bits FROM part)
SELECT p_partkey, preset, CASE WHEN bits = 1 AND space = 'Gray' THEN 'bitonal' WHEN space = 'Indexed' THEN 'indexed' WHEN space = 'Gray' THEN 'gray' ELSE 'color' END AS class, w * h < 10000 AS tiny,
  coalesce(dpi > threshold, false) AND NOT keyed AND w * h >= 10000 AS downsampled, rgb AND NOT keyed AND (space = 'CMYK' OR (space = 'RGB' AND profile)) AS converted,
  clip AND (w * (h // 2) * 16 <= w * h * 15 AND (3000 * (w * h - w * (h // 2))) // greatest(w * h, 1) > 200) AS cropped,
  CASE WHEN coalesce(dpi > threshold, false) AND NOT keyed AND w * h >= 10000 THEN CAST(greatest(round(w * (target / dpi)), 1) AS INTEGER) ELSE CAST(w AS INTEGER) END AS new_width FROM i CROSS JOIN p
""")
def class_rules(spark, sf):
    size = F.col("p_size")
    space = F.when(size % 4 == 0, "Gray").when(size % 4 == 1, "RGB").when(size % 4 == 2, "CMYK").otherwise("Indexed")
    images = table(spark, sf, "part").select(
        "p_partkey", (size * 20).cast("bigint").alias("w"), F.round(F.col("p_retailprice") / 4).cast("bigint").alias("h"), F.when(size % 5 != 0, size * 11.0).alias("dpi"), (size % 7 == 0).alias("keyed"),
        space.alias("space"), (size % 2 == 0).alias("profile"), F.when(size % 8 == 0, 1).otherwise(8).alias("bits"),
    )
    df = images.crossJoin(F.broadcast(presets.presets(spark)))
    w, h, keyed = F.col("w"), F.col("h"), F.col("keyed")
    down = presets.downsamples(F.col("dpi"), F.col("threshold"), keyed, w, h)
    return df.select(
        "p_partkey", "preset", presets.image_class(F.col("bits"), F.col("space"), F.lit(False)).alias("class"), presets.is_tiny(w, h).alias("tiny"), down.alias("downsampled"),
        presets.converts(F.col("rgb"), keyed, F.col("space"), F.col("profile")).alias("converted"), presets.crops(F.col("clip"), w, h, w, F.expr("h div 2"), F.lit(3000)).alias("cropped"),
        F.when(down, geometry.scaled_size(w, F.col("target") / F.col("dpi"))).otherwise(w.cast("int")).alias("new_width"),
    )


@query("""
SELECT event_id, CAST(user_id % 32 AS INTEGER) | CAST(event_id % 8 AS INTEGER) AS both_sets, (user_id % 32 & 5) = 5 AS has_source_and_jpeg,
  coalesce(nullif(concat_ws('|', CASE WHEN user_id & 1 <> 0 THEN 'source' END, CASE WHEN user_id & 2 <> 0 THEN 'flate' END, CASE WHEN user_id & 4 <> 0 THEN 'jpeg' END, CASE WHEN user_id & 8 <> 0 THEN 'g4' END, CASE WHEN user_id & 16 <> 0 THEN 'jbig2' END), ''), 'none') AS names FROM events
""")
def bitset_ops(spark, sf):
    own = (F.col("user_id") % 32).cast("int")
    name = sets.text(own, sets.CODECS)
    same = sets.parse(F.replace(name, F.lit("|"), F.lit(",")), sets.CODECS) == own
    df = table(spark, sf, "events")
    return df.select("event_id", own.bitwiseOR((F.col("event_id") % 8).cast("int")).alias("both_sets"), sets.contains(own, 5).alias("has_source_and_jpeg"), F.when(same, name).alias("names"))


@query("""
WITH e AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE l_linenumber WHEN 1 THEN 'Metadata' WHEN 2 THEN 'PieceInfo' WHEN 3 THEN 'B' WHEN 4 THEN 'StructParents' WHEN 5 THEN 'Alternates' ELSE 'Threads' END AS key,
  l_orderkey % 3 = 0 AS typed, l_orderkey % 5 = 0 AS is_stream, l_orderkey % 10 = 0 AS is_image, l_orderkey % 6 = 0 AS is_page, l_orderkey % 9 = 0 AS is_catalog FROM lineitem)
SELECT id, n, key FROM e WHERE NOT ((key = 'Metadata' AND (is_stream OR typed OR is_catalog)) OR (key = 'PieceInfo' AND (is_stream OR typed)) OR (key = 'B' AND is_page) OR (key = 'Alternates' AND is_image) OR (key = 'Threads' AND is_catalog))
""")
def strip_keys(spark, sf):
    keys = reduce(lambda c, k: c.when(F.col("l_linenumber") == k[0], k[1]), [(2, "PieceInfo"), (3, "B"), (4, "StructParents"), (5, "Alternates")], F.when(F.col("l_linenumber") == 1, "Metadata")).otherwise("Threads")
    of = lambda n, name: (F.col("l_orderkey") % n == 0).alias(name)
    entries = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), keys.alias("key"), of(3, "typed"), of(5, "is_stream"), of(10, "is_image"), of(6, "is_page"), of(9, "is_catalog"))
    flags = sets.bits(presets.PRESETS["standard"]["strip"].split(","), sets.STRIP)
    return presets.stripped(entries, flags).select("id", "n", "key")


# ---- scalars


@query("""
SELECT event_id, CASE WHEN contains(s, 'does not parse') THEN 'parse' WHEN contains(s, 'page count') THEN 'page_count' WHEN contains(s, 'content stream') THEN 'content_stream' WHEN contains(s, '(ImageDecode)') THEN 'image' ELSE 'stream' END AS category
FROM (SELECT event_id, event_type || CASE event_id % 6 WHEN 0 THEN ' does not parse: page count' WHEN 1 THEN ' page count 3' WHEN 2 THEN ' content stream (ImageDecode)' WHEN 3 THEN ' (ImageDecode)' ELSE ' other' END AS s FROM events)
""")
def categorize(spark, sf):
    k = F.col("event_id") % 6
    tail = F.when(k == 0, " does not parse: page count").when(k == 1, " page count 3").when(k == 2, " content stream (ImageDecode)").when(k == 3, " (ImageDecode)").otherwise(" other")
    return table(spark, sf, "events").select("event_id", text.problem_category(F.concat("event_type", tail)).alias("category"))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '+00' || l_partkey || '.500' WHEN 2 THEN '-0.0' WHEN 3 THEN '-.' || l_suppkey || '0' WHEN 4 THEN l_partkey || '.' WHEN 5 THEN '1e' || l_suppkey ELSE '-000' || l_suppkey END AS token FROM lineitem),
p AS (SELECT *, regexp_full_match(token, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]*)') AS plain, starts_with(token, '-') AS neg, ltrim(regexp_extract(token, '^[+-]?([0-9]*)', 1), '0') AS a, rtrim(regexp_extract(token, '[.]([0-9]*)$', 1), '0') AS b FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT plain THEN NULL WHEN a = '' AND b = '' THEN '0' ELSE CASE WHEN neg THEN '-' ELSE '' END || a || CASE WHEN b = '' THEN '' ELSE '.' || b END END AS canonical FROM p
""")
def canonical_number(spark, sf):
    n, p, s = F.col("l_linenumber"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    token = (
        F.when(n == 1, F.concat(F.lit("+00"), p, F.lit(".500"))).when(n == 2, "-0.0").when(n == 3, F.concat(F.lit("-."), s, F.lit("0")))
        .when(n == 4, F.concat(p, F.lit("."))).when(n == 5, F.concat(F.lit("1e"), s)).otherwise(F.concat(F.lit("-000"), s))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.canonical_number(token).alias("canonical"))


@query("""
SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', round(n / 1024.0, 1)) WHEN n < 1073741824 THEN printf('%.1f MiB', round(n / 1048576.0, 1)) ELSE printf('%.1f GiB', round(n / 1073741824.0, 1)) END AS size,
  CASE WHEN p_size % 10 = 0 THEN '-' ELSE printf('%+.1f%%', p_size * 100.0 / 31) END AS change
FROM (SELECT *, CAST(pow(2, p_size % 36) AS BIGINT) + p_partkey * 64 AS n FROM part)
""")
def human_pct(spark, sf):
    n = F.pow(F.lit(2.0), F.col("p_size") % 36).cast("bigint") + F.col("p_partkey") * 64
    change = text.percent(F.when(F.col("p_size") % 10 == 0, 0).otherwise(31.0), F.col("p_size") + 31.0)
    return table(spark, sf, "part").select("p_partkey", text.human(n).alias("size"), change.alias("change"))


@query("""
WITH n AS (SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'ABCDEF+Arial,BoldItalic' WHEN 1 THEN 'TimesNewRomanPS-BoldMT' WHEN 2 THEN 'Courier New' WHEN 3 THEN 'Arial Narrow' WHEN 4 THEN 'Symbol' WHEN 5 THEN 'Symbol-Bold' WHEN 6 THEN 'helvetica_oblique' WHEN 7 THEN p_brand ELSE 'ZapfDingbats' END AS name, p_size % 9 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'Helvetica-BoldOblique' WHEN 1 THEN 'Times-Bold' WHEN 2 THEN 'Courier' WHEN 4 THEN 'Symbol' WHEN 6 THEN 'Helvetica-Oblique' WHEN 8 THEN 'ZapfDingbats' END AS font, regexp_replace(name, '^[A-Z]{6}[+]', '') AS bare FROM n
""")
def name_fold(spark, sf):
    names = ["ABCDEF+Arial,BoldItalic", "TimesNewRomanPS-BoldMT", "Courier New", "Arial Narrow", "Symbol", "Symbol-Bold", "helvetica_oblique", None, "ZapfDingbats"]
    name = F.coalesce(F.element_at(F.array(*map(F.lit, names)), (F.col("p_size") % 9 + 1).cast("int")), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", text.standard_font(name).alias("font"), text.without_tag(name).alias("bare"))


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, -l_discount AS c, l_quantity AS d, CAST(l_linenumber AS DOUBLE) AS e, l_tax AS f FROM lineitem),
b AS (SELECT *, e + least(0, a) + least(0, c) AS x0, e + greatest(0, a) + greatest(0, c) AS x1, f + least(0, b) + least(0, d) AS y0, f + greatest(0, b) + greatest(0, d) AS y1, a * d - b * c AS det FROM m)
SELECT l_orderkey, l_linenumber, round(x0, 4) + 0.0 AS x0, round(y0, 4) + 0.0 AS y0, round(x1, 4) + 0.0 AS x1, round(y1, 4) + 0.0 AS y1, round(sqrt(a * a + b * b), 4) + 0.0 AS extent,
  round((d * 3 - c * 4 - (e * d - f * c)) / det, 6) + 0.0 AS back_x, round(greatest(0, least(x1, 10) - greatest(x0, 2)), 4) + 0.0 AS seen_width, least(x0, 2) >= 2 - 1e-4 AND y0 >= 1 AND x1 <= 10 + 1e-4 AND y1 <= 30 + 1e-4 AS inside FROM b
""")
def affine_rect(spark, sf):
    m = geometry.matrix(F.col("l_quantity"), F.col("l_discount"), -F.col("l_discount"), F.col("l_quantity"), F.col("l_linenumber"), F.col("l_tax"))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", m.alias("m"))
    df = df.withColumns({"box": geometry.unit_square(F.col("m")), "back": geometry.invert(F.col("m"))})
    clip = geometry.rect(2.0, 1.0, 10.0, 30.0)
    back_x = geometry.apply(F.col("back"), F.lit(3.0), F.lit(4.0))[0]
    seen = geometry.intersect(F.col("box"), clip)
    inside = geometry.covers(clip, F.col("box")) & (F.col("box.y0") >= 1)
    return df.select("l_orderkey", "l_linenumber", *(_r(f"box.{c}").alias(c) for c in geometry.SIDES), _r(geometry.unit_extent(F.col("m"))[0]).alias("extent"), _r(back_x, 6).alias("back_x"), _r(geometry.width(seen)).alias("seen_width"), inside.alias("inside"))


PROGRAM = "{ dup 25 gt { 2 mul exch 0.5 add } { exch dup mul } ifelse 2 copy add 3 1 roll idiv 7 mod 90 2 index sin pop pop }"


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_tax, least(greatest(l_tax * 100, 0.0), 50.0) AS x, least(greatest(l_quantity, 0.0), 50.0) AS y FROM lineitem),
s AS (SELECT *, CASE WHEN y > 25 THEN y * 2 ELSE y END AS p, CASE WHEN y > 25 THEN x + 0.5 ELSE x * x END AS q FROM v),
t AS (SELECT *, p + q AS total, CASE WHEN trunc(q) = 0 THEN 0 ELSE CAST(trunc(p) AS BIGINT) // CAST(trunc(q) AS BIGINT) END AS quotient FROM s)
SELECT l_orderkey, l_linenumber, round(least(greatest(total, 0), 500), 6) + 0.0 AS first, round(least(greatest(quotient % 7, 0), 6), 6) + 0.0 AS second, round(2 + (5 - 2) * (l_tax * 4) * (l_tax * 4), 6) + 0.0 AS power FROM t
""")
def calculator_program(spark, sf):
    x, y = F.col("l_tax") * 100, F.col("l_quantity")
    first, second = calculator.program(PROGRAM, [x, y], [0, 50, 0, 50], [0, 500, 0, 6])
    power = calculator.exponential(F.col("l_tax") * 4, [-1, 1], [2.0], [5.0], 2)[0]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _r(first, 6).alias("first"), _r(second, 6).alias("second"), _r(power, 6).alias("power"))


def _overprint_sql(channel: int) -> str:
    terms = []
    for n, p in enumerate(color.OVERPRINTS):
        area = " * ".join(f"{v}" if n >> i & 1 else f"(1 - {v})" for i, v in enumerate("cmyk"))
        terms.append(f"{area} * {p[channel]}")
    return f"CAST(least(greatest(round(({' + '.join(terms)}) * 255), 0), 255) AS INTEGER)"


@query(f"""
WITH i AS (SELECT l_orderkey, CAST(l_partkey % 256 AS DOUBLE) / 255 AS c, CAST(l_suppkey % 256 AS DOUBLE) / 255 AS m, CAST(l_orderkey % 256 AS DOUBLE) / 255 AS y, CAST(l_linenumber * 30 AS DOUBLE) / 255 AS k, l_linenumber, l_partkey % 256 AS ci, l_suppkey % 256 AS mi, l_orderkey % 256 AS yi FROM lineitem)
SELECT l_orderkey, l_linenumber, {_overprint_sql(0)} AS r, {_overprint_sql(1)} AS g, {_overprint_sql(2)} AS b,
  CAST(floor(least(greatest(434.456 - ci - 1.402 * yi, 0), 255)) AS INTEGER) AS c2, CAST(floor(least(greatest(119.541 - ci + 0.344 * mi + 0.714 * yi, 0), 255)) AS INTEGER) AS m2,
  CAST(floor(least(greatest(481.816 - ci - 1.772 * mi, 0), 255)) AS INTEGER) AS y2, l_linenumber * 30 AS k2, CAST(floor((c * 255 * 299 + m * 255 * 587 + y * 255 * 114 + 1e-6) / 1000) AS INTEGER) AS luma FROM i
""")
def color_kernels(spark, sf):
    c, m, y, k = F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256, F.col("l_linenumber") * 30
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", color.cmyk_to_rgb(c, m, y, k).alias("rgb"), color.ycck_to_cmyk(c, m, y, k, whole=True).alias("cmyk"), color.luma(c, m, y).alias("luma"))
    return df.select("l_orderkey", "l_linenumber", *(F.col("rgb")[i].alias(n) for i, n in enumerate("rgb")), *(F.col("cmyk")[i].alias(f"{n}2") for i, n in enumerate("cmyk")), "luma")


@query("""
SELECT l_suppkey, bool_and(l_returnflag = 'N') AS flat, bool_and(l_tax = 0.0 OR l_tax = 0.08) AS two_level, CASE WHEN count(*) FILTER (WHERE l_quantity < 25) * 2 <= count(*) THEN 'black' ELSE 'white' END AS ink FROM lineitem GROUP BY l_suppkey
""")
def quantifiers(spark, sf):
    dark = F.count_if(F.col("l_quantity") < 25)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.bool_and(F.col("l_returnflag") == "N").alias("flat"), F.bool_and(F.col("l_tax").isin(0.0, 0.08)).alias("two_level"), F.when(dark * 2 <= F.count(F.lit(1)), "black").otherwise("white").alias("ink")
    )


@query("""
SELECT page_id, upper(hex(encode(html))) AS digits, regexp_matches(upper(hex(encode(html))), '^(..)*([01][0-9A-F]|7F|[89A-F][0-9A-F])') AS binary FROM pages
""")
def hex_strings(spark, sf):
    digits = F.hex(F.col("html").cast("binary"))
    return table(spark, sf, "pages").select("page_id", digits.alias("digits"), text.non_ascii_hex(digits).alias("binary"))


@query("""
SELECT coalesce(max(p_type), '') AS p_type, count(*) AS n FROM part GROUP BY p_type
""")
def counts_by_kind(spark, sf):
    return table(spark, sf, "part").groupBy(F.coalesce("p_type", F.lit("")).alias("p_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT DISTINCT l_quantity AS q FROM lineitem), m AS (SELECT q, round(255 * pow(q / 50, 2.2)) AS v FROM d)
SELECT l_orderkey, l_linenumber, CAST(v AS INTEGER) AS mapped FROM lineitem JOIN m ON q = l_quantity
""")
def memoized_mapping(spark, sf):
    """Each distinct sample is mapped once, and joined back."""
    lines = table(spark, sf, "lineitem")
    mapped = lines.select("l_quantity").distinct().withColumn("mapped", F.round(F.pow(F.col("l_quantity") / 50, F.lit(2.2)) * 255).cast("int"))
    return lines.join(mapped, "l_quantity").select("l_orderkey", "l_linenumber", "mapped")
