"""Parse, chunk, index: three streams, each fed by what the one before it has committed.

Every stage reads an inbox of document ids. A micro-batch works on its documents as frames, replaces their rows in the
stage's table, and then puts the ids into the next stage's inbox. Documents with an error that may pass come back to the
stage's own inbox until they have been tried often enough; other errors are permanent. All of a micro-batch's steps can be
repeated: tables take the same commit again, and an inbox takes a batch's ids once, in a folder that is moved there whole. So a
stage that dies goes on where it was, and what it did twice shows nowhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import search_text
from lodestar.operators.analytics import scanned_guard
from lodestar.operators.catalog import fake_embedding
from lodestar.operators.chunking import CHUNK, Budget, assembled, chunk_documents
from lodestar.session import written
from lodestar.sources.files import decoded
from lodestar.sources.versioned import VersionedTable

#: How often a document is tried (fixed value).
TRIES = 3
UPLOAD = "document_id long, name string, content binary"
PAGE = "document_id long, page long, text string"
STORED_CHUNK = CHUNK.replace("doc_id", "document_id") + ", search_text string"
POINT = "document_id long, id string, vector array<double>"
STATUS = "document_id long, status_key string, attempt int, error string"
INBOX = "document_id long, attempt int"
ERROR = "document_id long, error string, permanent boolean"


@dataclass(frozen=True)
class Stage:
    """work(chain, ids): the rows for the stage's table, and errors (document_id, error, permanent)."""

    name: str
    done: str
    schema: str
    work: Callable[[Chain, DataFrame], tuple[DataFrame, DataFrame]]


class Chain:
    def __init__(self, spark: SparkSession, root: str, stages: list[Stage] | None = None, tries: int = TRIES, files: int = 100) -> None:
        self.spark, self.root, self.tries, self.files = spark, root, tries, files
        self.stages = stages or [PARSE, CHUNKS, POINTS]
        self.status = VersionedTable(spark, f"{root}/status", "document_id", STATUS)
        self.uploads = VersionedTable(spark, f"{root}/uploads", "document_id", UPLOAD)

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}", "document_id", next(s.schema for s in self.stages if s.name == name))

    def upload(self, uploads: DataFrame, number: int, writer: str = "upload") -> None:
        """Stores uploads (document_id, name, content) and puts them at the head of the chain."""
        self.uploads.replace(uploads, number, writer=writer)
        self.status.replace(self._as(uploads, "uploaded", F.lit(0), F.lit(None)), number, writer=writer)
        self._put(self.stages[0].name, f"{writer}-{number}", uploads.select("document_id", F.lit(1).alias("attempt")))

    @staticmethod
    def _as(ids: DataFrame, status: str, attempt, error) -> DataFrame:
        return ids.select("document_id", F.lit(status).alias("status_key"), attempt.cast("int").alias("attempt"), error.cast("string").alias("error"))

    def _put(self, stage: str, name: str, ids: DataFrame) -> None:
        """Adds ids to an inbox in one move; does nothing if that was done before."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        to, made = path(f"{self.root}/inbox/{stage}/{name}"), path(f"{self.root}/making/{stage}/{name}")
        if not fs.exists(to):
            ids.filter("document_id IS NOT NULL").write.mode("overwrite").parquet(str(made))
            fs.mkdirs(to.getParent())
            fs.rename(made, to)

    def run(self, name: str) -> None:
        """Works off what the stage's inbox holds, retries with it."""
        i = next(i for i, s in enumerate(self.stages) if s.name == name)
        stage, after = self.stages[i], self.stages[i + 1] if i + 1 < len(self.stages) else None
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/inbox/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        came_back: list[int] = []

        def write(batch: DataFrame, number: int) -> None:
            ids = written(batch.groupBy("document_id").agg(F.max("attempt").alias("attempt")), "ids")
            rows, errors = stage.work(self, ids)
            errors = written(errors.groupBy("document_id").agg(F.max("permanent").alias("permanent"), F.min("error").alias("error")).join(ids, "document_id"), "errors")
            good = written(ids.join(errors, "document_id", "left_anti"), "good")
            self.table(name).replace(rows.join(good.select("document_id"), "document_id", "left_semi"), number, good, name)
            final = errors.filter(F.col("permanent") | (F.col("attempt") >= self.tries))
            again = errors.join(final, "document_id", "left_anti")
            states = self._as(good, stage.done, F.col("attempt"), F.lit(None)).unionByName(self._as(final, "failed", F.col("attempt"), F.col("error"))).unionByName(self._as(again, "waiting", F.col("attempt"), F.col("error")))
            self.status.replace(states, number, writer=name)
            if after is not None:
                self._put(after.name, f"{name}-{number}", good.select("document_id", F.lit(1).alias("attempt")))
            if not again.isEmpty():
                came_back.append(number)
                self._put(name, f"{name}-{number}", again.select("document_id", (F.col("attempt") + 1).alias("attempt")))

        while True:  # a run takes what was there when it began; retries come while it runs
            came_back.clear()
            source = self.spark.readStream.schema(INBOX).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", self.files).parquet(f"{self.root}/inbox/{name}")
            source.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.root}/checkpoints/{name}").trigger(availableNow=True).start().awaitTermination()
            if not came_back:
                return

    def run_all(self) -> None:
        for s in self.stages:
            self.run(s.name)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for document_id, content in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([document_id.as_py()]), pa.array([decoded(content.as_py() or b"")], pa.string())], ["document_id", "text"])


def parse(chain: Chain, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of the uploads, split at form feeds. Unknown encodings, and pages almost without text, as scans have them, are
    permanent errors; an upload that is not there yet may come."""
    own = chain.uploads.read().join(ids.select("document_id"), "document_id", "left_semi")
    texts = written(own.select("document_id", "content").mapInArrow(_texts, "document_id long, text string"), "texts")
    parts = F.split("text", "\f", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    pages = texts.filter("text IS NOT NULL").select("document_id", F.posexplode(parts).alias("i", "text")).select("document_id", (F.col("i") + 1).cast("long").alias("page"), "text")
    bad = texts.filter("text IS NULL").select("document_id", F.lit("encoding").alias("error"), F.lit(True).alias("permanent"))
    scans = scanned_guard(pages, key="document_id").filter("rejected").select("document_id", F.lit("scanned").alias("error"), F.lit(True).alias("permanent"))
    empty = texts.filter("text = ''").select("document_id", F.lit("scanned").alias("error"), F.lit(True).alias("permanent"))
    missing = ids.join(own.select("document_id"), "document_id", "left_anti").select("document_id", F.lit("no upload").alias("error"), F.lit(False).alias("permanent"))
    return pages, bad.unionByName(scans).unionByName(empty).unionByName(missing)


def chunks(chain: Chain, ids: DataFrame, budget: Budget = Budget()) -> tuple[DataFrame, DataFrame]:
    """Chunks of the pages, with their search text."""
    pages = chain.table("parse").read().join(ids.select("document_id"), "document_id", "left_semi").withColumnRenamed("document_id", "doc_id")
    found = chunk_documents(assembled(pages), budget=budget).withColumn("search_text", search_text(F.col("content")))
    return found.withColumnRenamed("doc_id", "document_id"), chain.spark.createDataFrame([], ERROR)


def points(chain: Chain, ids: DataFrame, embed: Callable = fake_embedding) -> tuple[DataFrame, DataFrame]:
    """A vector for each chunk."""
    own = chain.table("chunk").read().join(ids.select("document_id"), "document_id", "left_semi")
    key = F.concat(F.col("document_id").cast("string"), F.lit("/"), F.col("chunk_index").cast("string"))
    return own.select("document_id", key.alias("id"), embed(F.col("content")).alias("vector")), chain.spark.createDataFrame([], ERROR)


PARSE, CHUNKS, POINTS = Stage("parse", "parsed", PAGE, parse), Stage("chunk", "chunked", STORED_CHUNK, chunks), Stage("index", "indexed", POINT, points)
