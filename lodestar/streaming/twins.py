"""Uploads with equal content, found as they come: state by hash, forgotten after a while without another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lodestar.sources.versioned import VersionedTable
from lodestar.streaming.conversations import ROCKS

TWIN = "sha256 string, document_id long, first_id long, n long"


def twins_of(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, twin_id): the other documents (document_id, sha256) with the content of those asked for. Rows, not lists:
    a group of copies is never gathered. Hashes that nobody asked for are dropped before the join."""
    own = documents.join(asked.select("document_id"), "document_id", "left_semi").select(F.col("document_id").alias("_own"), F.col("sha256").alias("_sha"))
    d = documents.join(own, F.col("sha256") == F.col("_sha")).filter("document_id <> _own")
    return d.select(F.col("_own").alias("document_id"), F.col("document_id").alias("twin_id"))


class Twins(StatefulProcessor):
    """Keeps the least id and the number of the documents of a hash, and their ids to know those that come again."""

    def __init__(self, expiry: int) -> None:
        self.expiry = expiry

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "document_id long", "at long")
        self.total = handle.getValueState("total", "n long, first long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, first, last = self.total.get() or (0, None, 0)
        new = []
        for frame in rows:
            for document_id, at in frame[["document_id", "at"]].itertuples(index=False):
                last = max(last, int(at))
                if not self.known.containsKey((int(document_id),)):
                    self.known.updateValue((int(document_id),), (int(at),))
                    n, first = n + 1, int(document_id) if first is None else min(first, int(document_id))
                    new.append(int(document_id))
        self.total.update((n, first, last))
        self.handle.registerTimer(last + self.expiry)
        if new:
            yield pd.DataFrame({"sha256": key[0], "document_id": new, "first_id": first, "n": n})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.total.get()
        if state and state[2] + self.expiry <= expiredTimerInfo.getExpiryTimeInMs():
            self.known.clear()
            self.total.clear()
        return iter(())


def twin_stream(uploads: DataFrame, expiry: int = 7 * 86_400_000, delay: str = "1 hour") -> DataFrame:
    """uploads (document_id, sha256, created_at): each new document once, with the least id and the number of documents known to
    have its content by then (n above 1: it has twins). A hash is forgotten ``expiry`` milliseconds after its last upload."""
    d = uploads.filter("document_id IS NOT NULL AND sha256 IS NOT NULL AND created_at IS NOT NULL").withWatermark("created_at", delay).withColumn("at", F.unix_millis("created_at"))
    return d.groupBy("sha256").transformWithStateInPandas(Twins(expiry), TWIN, "Update", "EventTime")


def first_uploads(uploads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first upload of each content within ``delay``; others of that time are passed over."""
    return uploads.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["sha256"])


def run_twins(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 100, **how) -> StreamingQuery:
    """Follows Parquet files of uploads and keeps a table by document at ``target``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    uploads = spark.readStream.schema("document_id long, sha256 string, created_at timestamp").option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        twin_table(batch.sparkSession, target).replace(batch, number, writer="twins")

    return twin_stream(uploads, **how).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def twin_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, "document_id", TWIN)


def latest_twins(found: DataFrame) -> DataFrame:
    """(sha256, first_id, n) by hash, of the rows of twin_table(): what the last upload of each knew."""
    w = Window.partitionBy("sha256").orderBy(F.col("n").desc(), "document_id")
    return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("sha256", "first_id", "n")
