"""Text files as pages, and JSON lines with their line numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def decoded(data: bytes) -> str | None:
    """UTF-8, with or without a byte-order mark, else CP950; null for neither."""
    for encoding in ("utf-8-sig", "cp950"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            text = decoded(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([text], pa.string()), pa.array([None if text is not None else "encoding"], pa.string())], ["path", "text", "error"])


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text, preserves_layout, error): a .txt, .md or .markdown file is one page; Markdown keeps its layout. A file
    in no known encoding has the error ``encoding``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,markdown}").load(path).select("path", "content")
    d = files.mapInArrow(_decoded, "path string, text string, error string")
    return d.select("path", F.lit(1).cast("long").alias("page"), "text", F.lower("path").rlike(r"\.(md|markdown)$").alias("preserves_layout"), "error")


def form_feed_pages(texts: DataFrame) -> DataFrame:
    """(doc_id, page, text): texts split at form feeds; only an empty last page is dropped, so that numbers do not shift."""
    parts = F.split("text", "\f", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return texts.select("doc_id", F.posexplode(parts).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("long").alias("page"), "text")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text): the lines of text files with their numbers, from 1. Files are read in splits by as many tasks as they
    need: the splits' numbers of lines, added up in order, tell where each split's numbers begin."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("_at"))
    counts = rows.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split")) - F.col("n")
    begins = counts.select(F.col("path").alias("_path"), F.col("split").alias("_split"), (before - F.col("first") + 1).alias("_shift"))
    return rows.join(begins, (F.col("path") == F.col("_path")) & (F.col("split") == F.col("_split"))).select("path", (F.col("_at") + F.col("_shift")).alias("line"), "text")


def json_line_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line, text) of the lines that are not blank and no JSON of the schema, such as QUESTION or CONVERSATION."""
    bad = F.from_json("text", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()
    return numbered_lines(spark, path).filter("trim(text) <> ''").filter(bad)
