"""Cutting lineage in storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where that is unset and everything runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='leafmill-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet in shared storage and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made.get(spark.sparkContext.applicationId, set()).discard(p)


def remove(*tables: DataFrame) -> None:
    """Deletes tables that settled() gave, once nothing reads them any more."""
    for t in tables:
        delete(t.sparkSession, t.settled_at)


def discard(spark: SparkSession) -> int:
    """Deletes what settled() wrote for this application, once nothing reads it any more; how many tables there were."""
    paths = tuple(_made.pop(spark.sparkContext.applicationId, ()))
    delete(spark, *paths)
    return len(paths)
