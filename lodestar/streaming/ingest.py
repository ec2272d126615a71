"""Incremental ingest: new documents become chunks; a document that comes again replaces its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.text import search_text
from lodestar.operators.chunking import CHUNK, Budget, assembled, chunk_documents
from lodestar.sources.versioned import VersionedTable


def chunk_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, "doc_id", f"{CHUNK}, search_text string")


def ingest_chunks(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, order: str = "version", budget: Budget = Budget()) -> StreamingQuery:
    """Reads Parquet files (doc_id, text, ``order``) that arrive in ``source`` and replaces their documents' chunks in
    chunk_table(target). Of a document's rows in one micro-batch, that with the greatest ``order`` counts, then the greatest
    text; one whose text is gone loses its chunks. A micro-batch that is run again writes the same version again."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct(F.col(order).alias("o"), "text")).alias("m"))
        pages = latest.select("doc_id", F.lit(1).alias("page"), F.col("m.text").alias("text"))
        chunks = chunk_documents(assembled(pages), budget=budget).withColumn("search_text", search_text(F.col("content")))
        chunk_table(spark, target).replace(chunks, number, pages, "ingest")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
