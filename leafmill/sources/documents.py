"""Documents as tables: files, objects, entries, edges, pages, operations; and compressing them.

Each file is parsed in one task, in Arrow batches of a few files; a file that
doesn't parse gives no rows here and a refusal in compressed(). Everything
after parsing is per object, so one large document doesn't hold up a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from leafmill.sources.objects import Document, FormatError, Name, Ref, Stream, Text, canonical, operations, read, references

#: Files in one batch: they can be large.
FILES = 8


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of every .pdf below path, whatever the case of its ending."""
    # a glob, so that other files aren't opened
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "length", "content")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """path and length alone: the contents aren't read."""
    return files(spark, path).select("path", "length")


def is_document(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def source_status(sources: DataFrame, manifest: DataFrame, present: DataFrame) -> DataFrame:
    """source, status: missing, manifest only, stale (another revision) or ok."""
    m = manifest.select("source", F.col("rev").alias("fetched"))
    both = sources.select("source", "rev").join(m, "source", "left").join(present.select("source").distinct().withColumn("here", F.lit(True)), "source", "left")
    status = F.when(F.col("fetched").isNull(), "missing").when(F.col("here").isNull(), "manifest only").when(F.col("fetched") != F.col("rev"), "stale").otherwise("ok")
    return both.select("source", status.alias("status"))


OBJECTS = "doc_id string, num int, gen int, kind string, type_name string, subtype string, stream_len bigint, stream binary, canonical binary"
ENTRIES = "doc_id string, num int, gen int, path array<string>, kind string, value_num double, value_bin binary, ref_num int, ref_gen int"
EDGES = "doc_id string, src_num int, src_gen int, path array<string>, dst_num int, dst_gen int"
PAGES = "doc_id string, page int, num int, gen int"
OPERATIONS = "doc_id string, owner_num int, seq int, operator string, operands array<string>"
PLACEMENTS = "doc_id string, num int, gen int, width_pt float, height_pt float, crop struct<x0:float,y0:float,x1:float,y1:float>"
SHOWN = "doc_id string, num int, gen int, strings array<binary>"
COMPRESSED = (
    "doc_id string, preset string, input_bytes bigint, output_bytes bigint, refusal string, output binary, notes array<string>, "
    "images array<struct<num:int,gen:int,width:int,height:int,dpi:float,action:string,bytes_in:bigint,bytes_out:bigint>>, "
    "fonts array<struct<num:int,gen:int,name:string,program:string,bytes_in:bigint,action:string,bytes_out:bigint>>, "
    "stages array<struct<stage_no:int,name:string,bytes_before:bigint,bytes_after:bigint,elapsed_ms:double>>"
)


def _kind(x) -> str:
    kinds = ((bool, "boolean"), (int, "integer"), (float, "real"), (Name, "name"), (Text, "string"), (list, "array"), (dict, "dictionary"), (Stream, "stream"), (Ref, "reference"))
    return next((k for t, k in kinds if isinstance(x, t)), "null")


def _rows(df: DataFrame, schema: str, make: Callable[[str, Document], Iterator[tuple]], id: str, content: str) -> DataFrame:
    """make(id, document) for every file that parses."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(FILES))
    struct = spark.createDataFrame([], schema).schema
    names, arrow = struct.names, to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            out = []
            for key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out += make(key, read(data))
                except FormatError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], arrow.field(n).type) for k, n in enumerate(names)], names=names)

    return df.select(F.col(id).cast("string"), content).filter(F.col(content).isNotNull()).mapInArrow(run, struct)


def objects(df: DataFrame, id: str = "path", content: str = "content") -> DataFrame:
    def make(key, doc):
        for ref, x in doc.objects.items():
            d = x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else {}
            names = [v.decode("latin-1") if isinstance(v := doc.resolve(d.get(k)), Name) else None for k in (b"Type", b"Subtype")]
            yield key, ref.num, ref.gen, _kind(x), *names, len(x.data) if isinstance(x, Stream) else None, x.data if isinstance(x, Stream) else None, canonical(x)

    return _rows(df, OBJECTS, make, id, content)


def entries(df: DataFrame, id: str = "path", content: str = "content") -> DataFrame:
    """Every leaf of every object, with the keys that lead to it."""

    def leaves(x, path):
        x = x.dict if isinstance(x, Stream) else x
        if isinstance(x, dict):
            for k, v in x.items():
                yield from leaves(v, [*path, k.decode("latin-1")])
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from leaves(v, [*path, str(i)])
        else:
            yield path, x

    def make(key, doc):
        for ref, x in doc.objects.items():
            for path, v in leaves(x, []):
                number = float(v) if isinstance(v, (int, float)) else None
                yield key, ref.num, ref.gen, path, _kind(v), number, bytes(v) if isinstance(v, (Name, Text)) else None, *(v if isinstance(v, Ref) else (None, None))

    return _rows(df, ENTRIES, make, id, content)


def edges(df: DataFrame, id: str = "path", content: str = "content") -> DataFrame:
    def make(key, doc):
        for ref, x in [(Ref(0, 65535), doc.trailer), *doc.objects.items()]:
            for path, to in references(x):
                yield key, ref.num, ref.gen, list(path), to.num, to.gen

    return _rows(df, EDGES, make, id, content)


def pages(df: DataFrame, id: str = "path", content: str = "content") -> DataFrame:
    def make(key, doc):
        from leafmill.operators.stages import pages_of

        for n, ref in enumerate(pages_of(doc)):
            yield key, n, ref.num, ref.gen

    return _rows(df, PAGES, make, id, content)


def content_operations(df: DataFrame, id: str = "path", content: str = "content") -> DataFrame:
    """Operations of every page's content in order; pages that can't be parsed strictly have none."""

    def make(key, doc):
        from leafmill.operators.stages import page_content, pages_of
        from leafmill.sources.objects import spell

        for ref in pages_of(doc):
            body = page_content(doc, ref)
            try:
                found = operations(body) if body is not None else []
            except FormatError:
                found = []
            for seq, (op, operands) in enumerate(found):
                yield key, ref.num, seq, op.decode("latin-1"), [spell(o).decode("latin-1") for o in operands]

    return _rows(df, OPERATIONS, make, id, content)


def placements(df: DataFrame, id: str = "path", content: str = "content") -> DataFrame:
    """Every drawing of an image: its size in points, and what of it shows (null: all)."""

    def make(key, doc):
        from leafmill.operators.stages import Usage

        for ref, each in Usage(doc).placements.items():
            for w, h, part in each:
                yield key, ref.num, ref.gen, w, h, dict(zip(("x0", "y0", "x1", "y1"), part, strict=True)) if part else None

    return _rows(df, PLACEMENTS, make, id, content)


def shown_strings(df: DataFrame, id: str = "path", content: str = "content") -> DataFrame:
    """The distinct strings that each font shows."""

    def make(key, doc):
        from leafmill.operators.stages import Usage

        for ref, strings in Usage(doc).strings.items():
            yield key, ref.num, ref.gen, sorted(strings)

    return _rows(df, SHOWN, make, id, content)


def compressed(df: DataFrame, preset: str | dict, id: str = "path", content: str = "content", check: bool = True) -> DataFrame:
    """One row for each file: its sizes, output, refusal, notes, image rows and stage ledger."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(FILES))
    schema = spark.createDataFrame([], COMPRESSED).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        from leafmill.operators.stages import compress

        for batch in batches:
            rows = []
            for key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = data or b""
                out, report, refusal = compress(data, preset, check)
                images = [{k: row.get(k) for k in ("num", "gen", "width", "height", "dpi", "action", "bytes_in", "bytes_out")} for row in report.images]
                rows.append({"doc_id": key, "preset": preset if isinstance(preset, str) else "custom", "input_bytes": len(data), "output_bytes": len(out), "refusal": refusal, "output": out, "notes": report.notes, "images": images, "fonts": report.fonts, "stages": report.stages})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.select(F.col(id).cast("string"), content).mapInArrow(run, schema)


def image_rows(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "preset", F.explode("images").alias("i")).select("doc_id", "preset", "i.*")


def font_rows(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "preset", F.explode("fonts").alias("f")).select("doc_id", "preset", "f.*")


def stage_rows(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "preset", F.explode("stages").alias("s")).select("doc_id", "preset", "s.*")


def totals(done: DataFrame) -> DataFrame:
    """Files, refusals and bytes by preset."""
    return done.groupBy("preset").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("refusal").isNotNull()).alias("refused"), F.sum("input_bytes").alias("input_bytes"), F.sum("output_bytes").alias("output_bytes"))


def outcome(done: DataFrame) -> DataFrame:
    """doc_id, ok: nothing grew, neither the file nor any of its images."""
    grown = F.exists("images", lambda i: i["bytes_out"] > i["bytes_in"])
    return done.select("doc_id", "preset", (F.col("refusal").isNull() & (F.col("output_bytes") <= F.col("input_bytes")) & ~grown).alias("ok"))
