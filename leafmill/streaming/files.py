"""Files that arrive in a folder, compressed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.sources.documents import compressed

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """New files below path, at most so many a trigger."""
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return found.filter(F.lower("path").endswith(".pdf"))


def compress_arriving(spark: SparkSession, path: str, preset: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes a row for each file as Parquet; ends when all files there are done. Each file is done once, whatever fails."""
    rows = compressed(arriving(spark, path).select("path", "content"), preset)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
