"""Plug points: chunking as a table function for SQL, and scorers and embedders as functions over batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.chunking import CHUNK, Budget, Packer, _page, chunk_spans

#: Texts that a model is given at once (fixed value).
BATCH = 16
Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[str, list[str]], list[float]]


def register_chunker(spark: SparkSession, name: str = "chunk", strategy: str = "structure", budget: Budget = Budget()) -> None:
    """Makes ``SELECT * FROM chunk(TABLE(pages) PARTITION BY doc_id ORDER BY page)`` give chunk_documents() of assembled() pages
    (doc_id, page, text). A document's pages come to one call in order, and its chunks leave when it ends."""

    class Chunker:
        def __init__(self) -> None:
            self.doc_id, self.pages, self.parts, self.at = None, [], [], 0

        def eval(self, row) -> None:
            text = row["text"] or ""
            self.doc_id = row["doc_id"]
            if text or self.parts:  # empty pages at the start leave nothing
                if text:
                    self.pages.append((self.at, row["page"]))
                self.parts.append(text)
                self.at += len(text) + 1

        def terminate(self):
            if self.doc_id is None:
                return
            text, packer = "\n".join(self.parts), None
            starts, numbers = [s for s, _ in self.pages], [p for _, p in self.pages]
            packer = Packer(text, budget)
            for i, (a, b, section) in enumerate(chunk_spans(text, strategy, budget)):
                yield self.doc_id, i, text[a:b], b - a, packer.cost(a, b), _page(starts, numbers, a), _page(starts, numbers, max(a, b - 1)), section, budget.label(strategy)

    spark.udtf.register(name, F.udtf(Chunker, returnType=CHUNK))


def embedded(texts: DataFrame, embed: Embedder, size: int, prefix: str = "", batch: int = BATCH) -> DataFrame:
    """texts (id, text) with vector and fault. ``embed`` is called with at most ``batch`` texts, each behind the prefix, and must give a
    vector of ``size`` numbers for each. Blank texts are not sent; a call that fails, or gives another number of vectors,
    faults its texts only: blank_text, failed, wrong_count, wrong_size. The caller decides whether to try them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).to_pylist()
            vectors, faults = [None] * len(values), ["blank_text"] * len(values)
            full = [i for i, t in enumerate(values) if t and t.strip()]
            for start in range(0, len(full), batch):
                own = full[start : start + batch]
                try:
                    got, fault = embed([prefix + values[i] for i in own]), None
                    fault = "wrong_count" if len(got) != len(own) else None
                except Exception:  # a model may fail in any way; the texts say so
                    fault = "failed"
                for k, i in enumerate(own):
                    faults[i] = fault or (None if len(got[k]) == size else "wrong_size")
                    vectors[i] = None if faults[i] else [float(x) for x in got[k]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vectors, pa.list_(pa.float64())), pa.array(faults, pa.string())], ["id", "text", "vector", "fault"])

    d = texts.select("id", "text")
    return d.mapInArrow(run, f"id {dict(d.dtypes)['id']}, text string, vector array<double>, fault string")


def scored_candidates(candidates: DataFrame, score: Scorer, least: int = 1) -> DataFrame:
    """candidates (query_id, question, id, text, rank), a question's few in one group, with score, final_rank and degraded. ``score`` is
    called once a question with its texts in order of rank. A call that fails, or gives another number of scores or one that
    is no number, leaves the question's order as it was, degraded."""

    def run(key, group):
        rows = sorted(group.select(["id", "text", "rank", "question"]).to_pylist(), key=lambda r: (r["rank"], r["id"]))
        try:
            got = [float(x) for x in score(rows[0]["question"] or "", [r["text"] or "" for r in rows])]
            good = len(got) == len(rows) and all(x == x for x in got)
        except Exception:  # as above
            good = False
        order = sorted(range(len(rows)), key=lambda i: -got[i]) if good else range(len(rows))
        out = [(key[0].as_py(), rows[i]["id"], rows[i]["rank"], got[i] if good else None, n, not good) for n, i in enumerate(order, 1)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["query_id", "id", "rank", "score", "final_rank", "degraded"])

    d = candidates.select(F.col("query_id").cast("long").alias("query_id"), "question", F.col("id").cast("long").alias("id"), "text", F.col("rank").cast("long").alias("rank"))
    return d.groupBy("query_id").applyInArrow(run, "query_id long, id long, rank long, score double, final_rank long, degraded boolean")
