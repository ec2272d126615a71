"""Tables in which a key's rows are replaced as a whole: pages, chunks, vectors.

Rows are only ever added, in a folder for each commit; a second, small table says which keys a commit wrote. A key's rows
are those of its last commit. So a write costs what it brings, not what is there; a reader never sees a half-written one,
since keys are written last; and a key without rows is gone.

A commit is named by its writer, what it does and its number, and takes its place in the order when it is first begun. The
same commit again, after a failure, writes the same folders and keeps its place, so that it undoes nothing that came later;
writers of different names never meet in one folder, and commits that begin at once are ordered by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        """schema: of the rows, as DDL; it holds the key."""
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    def replace(self, rows: DataFrame, version: int, keys: DataFrame | None = None, writer: str = "main") -> None:
        """Replaces the rows of ``keys`` (those of the rows, if not given) by ``rows``. Null keys are left out."""
        own = (rows if keys is None else keys).select(self.key)
        commit, place = self._begun(f"{writer}-replace-{version}")
        if place is not None:
            rows.filter(F.col(self.key).isNotNull()).withColumn("_place", F.lit(place)).write.mode("overwrite").parquet(f"{self.path}/rows/commit={commit}")
            self._wrote(own, commit, place)

    def delete(self, keys: DataFrame, version: int, writer: str = "main") -> None:
        commit, place = self._begun(f"{writer}-delete-{version}")
        if place is not None:
            self._wrote(keys.select(self.key), commit, place)

    def _wrote(self, keys: DataFrame, commit: str, place: int) -> None:
        own = keys.filter(F.col(self.key).isNotNull()).distinct().withColumn("_place", F.lit(place))
        own.write.mode("overwrite").parquet(f"{self.path}/keys/commit={commit}")

    def _begun(self, commit: str) -> tuple[str, int | None]:
        """The commit and its place: given once, in a file that only one writer can create. None for one that was compacted."""
        fs, names = self._files("places")
        taken = dict(reversed(x.split("@")) for x in names)  # commit: place
        if commit not in taken:
            places = [int(x) for x in taken.values()]
            taken[commit] = str(max(places, default=0) + 1)
            fs.create(self._at(f"places/{taken[commit]}@{commit}"), True).close()
        done = max((int(x) for x in self._files("compacted")[1]), default=0)
        place = int(taken[commit])
        return commit, None if place <= done else place

    def compact(self) -> None:
        """Writes the live rows as one commit in place of all that are there, whose folders go. For when no writer is at work;
        readers that began before must have ended. Commits from before do nothing if they are run again."""
        fs, names = self._files("places")
        if not names:
            return
        last = max(int(x.split("@")[0]) for x in names)
        old = {part: self._files(part)[1] for part in ("rows", "keys")}
        live, commit = self.read(), f"commit=compact-{last}"
        if commit in old["keys"]:
            return
        live.withColumn("_place", F.lit(last)).write.mode("overwrite").parquet(f"{self.path}/rows/{commit}")
        self._wrote(self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{commit}").select(self.key), f"compact-{last}", last)
        for part, folders in old.items():
            for x in folders:
                fs.delete(self._at(f"{part}/{x}"), True)
        fs.create(self._at(f"compacted/{last}"), True).close()

    def read(self) -> DataFrame:
        if not self._files("keys")[1]:
            return self.spark.createDataFrame([], self.schema)
        kind = next(f.dataType.simpleString() for f in self.spark.createDataFrame([], self.schema).schema if f.name == self.key)
        keys = self.spark.read.schema(f"`{self.key}` {kind}, _place long, commit string").parquet(f"{self.path}/keys")
        last = keys.groupBy(self.key).agg(F.max(F.struct("_place", "commit")).alias("_last")).select(self.key, "_last.commit")
        if not self._files("rows")[1]:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, _place long, commit string").parquet(f"{self.path}/rows")
        return rows.join(last, [self.key, "commit"], "left_semi").drop("commit", "_place")

    def there(self) -> bool:
        return bool(self._files("keys")[1])

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self, part: str):
        """The file system, and the names in a folder of the table."""
        path = self._at(part)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []


def purge(tables: list[VersionedTable], keys: DataFrame, version: int, writer: str = "main") -> None:
    """Removes keys from every table, such as one for each embedding model."""
    for t in tables:
        t.delete(keys, version, writer)


def cascade(documents: DataFrame, ids: DataFrame, tables: list[VersionedTable], version: int, deletable: tuple[str, ...], writer: str = "main") -> DataFrame:
    """Deletes documents (document_id, status_key) that may be deleted, in the order of ``tables`` (vectors, chunks, pages);
    gives the documents that are left."""
    gone = documents.join(ids.select("document_id"), "document_id", "left_semi").filter(F.col("status_key").isin(*deletable)).select("document_id")
    for t in tables:
        t.delete(gone.withColumnRenamed("document_id", t.key), version, writer)
    return documents.join(gone, "document_id", "left_anti")


def stored_uploads(uploads: DataFrame, at: str) -> DataFrame:
    """Rows for new uploads (name, content): a path by year, month and hash, the hash, the size and the first state."""
    when = F.lit(at).cast("timestamp")
    d = uploads.withColumn("sha256", F.sha2("content", 256))
    path = F.concat(F.lit("documents/"), F.date_format(when, "yyyy/MM"), F.lit("/"), F.col("sha256"))
    return d.select("name", path.alias("path"), F.octet_length("content").cast("long").alias("size"), "sha256", F.lit("uploaded").alias("status_key"), when.alias("created_at"))


def append_by_day(log: DataFrame, path: str, batch: int) -> None:
    """Appends rows (created_at, ...) under their day and the batch's number; the same batch again replaces itself."""
    d = log.withColumn("day", F.to_date("created_at")).withColumn("batch", F.lit(batch))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def exchange_rows(exchanges: DataFrame) -> DataFrame:
    """The user's and the assistant's message of each exchange (conversation_id, turn, question, answer)."""
    pair = F.array(F.struct((2 * F.col("turn")).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct((2 * F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return exchanges.select("conversation_id", F.inline(pair))
