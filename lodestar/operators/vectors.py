"""A stored vector index that is searched exactly: unit vectors by model and by the nearest of a few centres.

A cell's vectors lie within an angle of its centre. A question at another angle from the centre can't be nearer to any of
them than the difference, so its cosine with them is bounded. A search first looks into each question's nearest cells, which
gives a k-th score, and then reads the other cells whose bound reaches it: cells are partitions, so the rest is not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.catalog import canonical_model
from lodestar.operators.retrieval import CANDIDATES, dense_hits, ranked
from lodestar.session import written
from lodestar.sources.versioned import VersionedTable

#: Vectors in a cell, about; centres of a model, at most (they are broadcast: 4 bytes times their length each).
CELL, MOST_CENTRES = 2000, 4096
_ROW = "id long, document_id long, model string, cell int, angle double, vector array<float>"


def _assigned(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The vectors as unit vectors with their nearest centre and the angle to it; others than finite ones of norm above 0
    and of their model's length are left out."""
    for batch in batches:
        rows = []
        for id_, document, model, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            centres = shared.value.get(model)
            if centres is None or v is None or len(v) != centres.shape[1] or None in v:
                continue
            x = np.array(v, float)
            norm = np.sqrt(x @ x)
            if not 0 < norm < np.inf:
                continue
            near = centres @ (x / norm)
            cell = int(near.argmax())
            rows.append((id_, document, model, cell, float(np.arccos(np.clip(near[cell], -1, 1))), x / norm))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _ROW.split(", ")])


class VectorIndex:
    """points (id, document_id, vector, model). ``build`` settles the centres; ``upsert`` and ``purge`` go by document."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.rows = VersionedTable(spark, f"{path}/rows", "document_id", _ROW)

    def build(self, points: DataFrame, number: int, cell: int = CELL, writer: str = "main") -> None:
        """Samples the centres, about one for ``cell`` vectors of a model, of the model's usual length, and adds the points."""
        d = self._points(points).filter("vector IS NOT NULL AND size(vector) > 0")
        sizes = d.groupBy("model", F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).groupBy("model").agg(F.max(F.struct("n", "size")).alias("m")).select("model", "m.size", "m.n").collect()
        parts = []
        for r in sizes:  # a row for each model
            own = d.filter(F.col("model").eqNullSafe(F.lit(r["model"])) & (F.size("vector") == r["size"])).orderBy(F.xxhash64("id")).limit(max(1, min(MOST_CENTRES, r["n"] // cell)))
            parts.append(own.select("model", F.col("vector").cast("array<double>").alias("vector")))
        for i, p in enumerate(parts):
            p.write.mode("overwrite" if i == 0 else "append").parquet(f"{self.path}/centres")
        self.upsert(points, number, writer)

    def upsert(self, points: DataFrame, number: int, writer: str = "main") -> None:
        """Replaces the vectors of the points' documents, of all models."""
        shared = self.spark.sparkContext.broadcast(self.centres())
        d = self._points(points)
        self.rows.replace(d.mapInArrow(partial(_assigned, shared=shared), _ROW), number, d, writer)

    def purge(self, documents: DataFrame, number: int, writer: str = "main") -> None:
        self.rows.delete(documents, number, writer)

    def centres(self) -> dict[str | None, np.ndarray]:
        out: dict[str | None, list] = {}
        for r in self.spark.read.schema("model string, vector array<double>").parquet(f"{self.path}/centres").collect():
            v = np.array(r["vector"], float)
            if (n := np.sqrt(v @ v)) > 0:
                out.setdefault(r["model"], []).append(v / n)
        return {m: np.stack(v) for m, v in out.items()}

    @staticmethod
    def _points(points: DataFrame) -> DataFrame:
        return points.select(F.col("id").cast("long").alias("id"), F.col("document_id").cast("long").alias("document_id"), canonical_model(F.col("model")).alias("model"), F.col("vector").cast("array<double>").alias("vector"))

    def optimize(self) -> None:
        """Writes the live vectors by model and cell, sorted, for searches to read by partition; to be run after updates."""
        live = written(self.rows.read(), "vectors")
        live.repartition("model", "cell").write.mode("overwrite").partitionBy("model", "cell").parquet(f"{self.path}/cells")
        live.groupBy("model", "cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/radii")

    def read(self, model: str, cells: list[int]) -> DataFrame:
        """The vectors of some cells of a model; others are not read."""
        stored = self.spark.read.schema("id long, document_id long, angle double, vector array<float>, model string, cell int").parquet(f"{self.path}/cells")
        return stored.filter((F.col("model") == model) & F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int = CANDIDATES, threshold: float | None = None, stats: dict | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k best of each question (query_id, vector, model) strictly above the threshold, as an
        exhaustive search over the stored vectors gives them. The questions, whose vectors are collected, are a batch."""
        asked = queries.select("query_id", "vector", canonical_model(F.col("model")).alias("model")).filter("vector IS NOT NULL")
        centres, out = self.centres(), None
        sizes = {(r["model"], r["cell"]): r for r in self.spark.read.parquet(f"{self.path}/radii").collect()}
        rows = asked.collect()
        for model in sorted({r["model"] for r in rows if r["model"] in centres}):
            c = centres[model]
            own = [r for r in rows if r["model"] == model and len(r["vector"]) == c.shape[1] and None not in r["vector"]]
            q = np.array([r["vector"] for r in own], float)
            norm = np.sqrt((q * q).sum(1, keepdims=True))
            q = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
            cells = np.array(sorted(cell for m, cell in sizes if m == model), np.int64)
            if not len(own) or not len(cells):
                continue
            radius = np.array([sizes[model, x]["radius"] for x in cells.tolist()])
            angle = np.arccos(np.clip(q @ c[cells].T, -1, 1))
            bound = np.cos(np.maximum(0, angle - radius[None, :] - 1e-6))  # single precision keeps six digits
            near = self._first(angle, np.array([sizes[model, x]["n"] for x in cells.tolist()]), k)
            first = sorted({int(x) for x in cells[np.unique(near.nonzero()[1])]})
            mine = asked.filter(F.col("model") == model)
            held = written(ranked(dense_hits(mine, self.read(model, first), k, threshold, exclude_self=False), k), "near")
            kth = {r["query_id"]: r["score"] for r in held.groupBy("query_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).collect()}
            cut = np.array([kth.get(r["query_id"], -np.inf) for r in own])
            cut = np.maximum(cut, threshold) if threshold is not None else cut
            more = sorted({int(x) for x in cells[np.unique((bound >= cut[:, None] - 1e-6).nonzero()[1])]} - set(first))
            found = held.drop("rank")
            if more:
                found = found.unionByName(dense_hits(mine, self.read(model, more), k, threshold, exclude_self=False))
            out = found if out is None else out.unionByName(found)
            if stats is not None:
                stats[model] = (len(first) + len(more), len(cells))
        if out is None:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank long")
        return ranked(out, k).withColumn("score", F.round("score", 6))

    @staticmethod
    def _first(angle: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
        """For each question its nearest cells, until they hold k vectors."""
        order = np.argsort(angle, 1)
        before = np.cumsum(n[order], 1) - n[order]
        near = np.zeros(angle.shape, bool)
        np.put_along_axis(near, order, before < k, 1)
        return near
