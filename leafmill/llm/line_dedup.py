"""Site-relative line deduplication.

For each host, the share of its pages that hold a line is the pages with that
line over all of the host's pages; lines whose share is above `ratio`, on at
least `least` pages, are boilerplate and are dropped from every page of that
host. Lines are parted by line feed and compared trimmed of spaces and tabs at
their ends; blank lines are kept and not counted. A page counts a line once.

Counting uses 96-bit keys of lines and partial sums before the shuffle. A host
can have no more boilerplate lines than its lines per page over `ratio`, so
each host's list is short; lists are joined to pages by host (Spark broadcasts
them if they are small and else splits a hot host's pages over tasks; the
texts are joined once). DataFrame functions only.

A null text has no lines and stays null; a null host is a host of its own.
Repeated rows count as pages of their own. An empty table gives no rows. Other
columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A line on more than this share of a host's pages, and on at least so many of them, is boilerplate.
RATIO, LEAST = 0.05, 3


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and a leading www."""
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(bare: Column) -> Column:
    return F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b"))


def boilerplate(df: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host, and keys: the keys of its boilerplate lines. Hosts without any are absent."""
    pages = df.select(host.alias("host"), F.col(text).alias("body"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("body")), _bare), lambda x: x != ""), _key))
    counts = pages.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    often = counts.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(df: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """df with text without boilerplate lines, and n_lines and n_removed."""
    # written, so that its size is known before the texts would be shuffled, and a hot host's side can be split
    found = written(boilerplate(df, host, text, ratio, least).select(F.col("host").alias("__of"), F.col("keys").alias("__keys")), "boilerplate")
    bad = lambda x: F.array_contains(F.col("__keys"), _key(_bare(x)))
    joined = df.withColumn("__host", host).join(found, F.col("__host").eqNullSafe(F.col("__of")), "left")
    joined = joined.withColumn("__lines", _lines(F.col(text)))
    # blank lines never match: they have no key in the lists
    joined = joined.withColumn("__kept", F.when(F.col("__keys").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~bad(x))))
    size = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    out = joined.withColumn("n_lines", size("__lines")).withColumn("n_removed", F.col("n_lines") - size("__kept"))
    out = out.withColumn(text, F.when(F.col("n_removed") == 0, F.col(text)).otherwise(F.array_join("__kept", "\n")))
    return out.select(*[c for c in df.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
