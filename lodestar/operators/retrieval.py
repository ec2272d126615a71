"""Retrieval for batches of questions: dense, keyword and exact lists, rank fusion, gate and rerank.

Every list is a frame (query_id, id, score, rank). Questions are taken in blocks of a fixed number, which are broadcast one
after the other; the collection is never collected, and each of its Arrow batches sends on a question's k best only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import search_text
from lodestar.operators.postings import keyword_hits
from lodestar.operators.terms import holding, question_terms

RRF_K, CANDIDATES = 60, 20
#: Questions with vectors that one pass over the collection holds in memory; more take several passes.
QUERY_BLOCK = 4096
#: Scores that a task holds at once: a block's questions meet a batch of points in slices; no result depends on it.
CELLS = 1 << 20
#: Digits that scores are ranked by: beyond them, sums of equal terms in another order differ.
DIGITS = 12


def ranked(df: DataFrame, k: int | None = None, order: Column | None = None) -> DataFrame:
    """Adds rank by score descending, then id, within a query; at most k."""
    w = Window.partitionBy("query_id").orderBy(*([order] if order is not None else []), F.col("score").desc(), F.col("id"))
    out = df.withColumn("rank", F.row_number().over(w).cast("long"))
    return out if k is None else out.filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[list[dict]]:
    """The questions in blocks of at most ``size``; an iterator over partitions, so that the driver holds one of them."""
    rows = []
    for row in queries.toLocalIterator():
        rows.append(row.asDict())
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's k best finite scores; ties at the border are kept whole, since ranks by id are
    settled afterwards."""
    cut = np.partition(score, score.shape[1] - k, 1)[:, score.shape[1] - k][:, None] if score.shape[1] > k else np.full((len(score), 1), -np.inf)
    return np.nonzero((score >= cut) & (score > -np.inf))


def _vectors(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors of that length."""
    size = np.diff(column.offsets.to_numpy())
    size[column.is_null().to_numpy(zero_copy_only=False)] = -1
    at = np.flatnonzero(size == width)
    first = column.offsets.to_numpy()[:-1][at]
    flat = column.values.to_numpy(zero_copy_only=False)
    return at, flat[first[:, None] + np.arange(width)].astype(float)


def _groups(rows: list[dict]) -> list[tuple[str | None, int, np.ndarray, np.ndarray]]:
    """(model, length, ids, unit vectors) of the questions, by model and length."""
    groups: dict[tuple, list[dict]] = {}
    for r in rows:
        if r["vector"] and None not in r["vector"]:
            groups.setdefault((r.get("model"), len(r["vector"])), []).append(r)
    return [(model, size, np.array([r["query_id"] for r in own], np.int64), _unit(np.array([r["vector"] for r in own], float))) for (model, size), own in groups.items()]


def dense(queries: DataFrame, points: DataFrame, k: int = CANDIDATES, threshold: float | None = None, exclude_self: bool = True) -> DataFrame:
    """(query_id, id, score, rank): dense_hits(), ranked; score is rounded to six digits for output only."""
    return ranked(dense_hits(queries, points, k, threshold, exclude_self), k).withColumn("score", F.round("score", 6))


def dense_hits(queries: DataFrame, points: DataFrame, k: int, threshold: float | None = None, exclude_self: bool = True) -> DataFrame:
    """(query_id, id, score): among these rows are the k points of highest cosine of each question, strictly above the threshold.

    queries (query_id, vector), points (id, vector); where both have a model, a question meets the points of its model only.
    Each Arrow batch of points is multiplied by a block of questions and sends on its own k best, so a question's list is
    reduced before it is shuffled. A question meets the points of its length. Vectors of norm 0, or that hold nulls,
    match nothing.
    """
    spark, parts = points.sparkSession, []
    models = ["model"] if "model" in queries.columns and "model" in points.columns else []
    for rows in _blocks(queries.select("query_id", "vector", *models).filter("vector IS NOT NULL")):
        block = spark.sparkContext.broadcast(_groups(rows))

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _searched(batch, block.value, k, threshold, exclude_self, bool(models))

        parts.append(points.select(F.col("id").cast("long").alias("id"), "vector", *models).filter("id IS NOT NULL").mapInArrow(search, "query_id long, id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _searched(batch: pa.RecordBatch, groups: list[tuple], k: int, threshold: float | None, exclude_self: bool, by_model: bool) -> Iterator[pa.RecordBatch]:
    """The k best points of a batch (id, vector, model) for each question of _groups()."""
    for model, size, qid, q in groups:
        at, m = _vectors(batch.column(1), size)
        if by_model:
            own = np.array([x == model for x in batch.column(2).take(pa.array(at)).to_pylist()], bool)
            at, m = at[own], m[own]
        if not len(at):
            continue
        pid, m, step = batch.column(0).to_numpy()[at], _unit(m).T, max(1, CELLS // len(at))
        for first in range(0, len(qid), step):
            ask = qid[first : first + step]
            score = np.round(q[first : first + step] @ m, DIGITS)
            score[np.isnan(score)] = -np.inf
            if exclude_self:
                score[ask[:, None] == pid[None, :]] = -np.inf
            if threshold is not None:
                score[score <= threshold] = -np.inf
            r, c = _best(score, k)
            yield pa.RecordBatch.from_arrays([pa.array(ask[r]), pa.array(pid[c]), pa.array(score[r, c])], ["query_id", "id", "score"])


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)


def keyword(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, id, score, rank) by tf-idf over character pairs: sum of tf x ln(1 + N / df) over a question's distinct pairs;
    score is rounded to four digits for output only. The texts are read once for any usual number of questions."""
    return ranked(keyword_hits(queries, chunks, k), k).withColumn("score", F.round("score", 4))


def exact(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id): chunks that contain a question's whole search text. Empty and null questions match nothing."""
    whole = queries.select("query_id", F.array(search_text(F.coalesce("text", F.lit("")))).alias("terms"))
    return holding(whole, chunks).select("query_id", "id").distinct()


def exact_search(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, id, score, rank): chunks that hold any of a question's exact terms, by the number of terms, then id."""
    terms = queries.filter("text IS NOT NULL").select("query_id", question_terms(F.col("text")).alias("terms"))
    return ranked(holding(terms, chunks, k), k)


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, first, lists, dense_score): reciprocal-rank fusion, sum of 1 / (k + rank). ``first`` is the
    first place where the id stands, by list and rank, and settles ties; ``lists`` are the lists that have it; dense_score
    is its score in the first list."""
    parts = [x.select("query_id", "id", "rank", F.lit(i).alias("list"), (F.col("score") if i == 0 else F.lit(None).cast("double")).alias("s")) for i, x in enumerate(lists)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank")).alias("first"), F.collect_set("list").alias("lists"), F.max("s").alias("dense_score")
    )


def hybrid(dense_list: DataFrame, keyword_list: DataFrame, exact_list: DataFrame, top_k: int = 5, policy: str = "exact_only", thresholded: bool = True, mode: str = "hybrid") -> DataFrame:
    """(query_id, id, score, rank, dense_score). Lists fuse in the order dense, keyword, exact. An id counts only if a
    dense or exact list has it, or any list does under policy ``allow`` or without threshold. A query with a threshold
    and neither dense nor exact hits gets nothing, but in mode ``keyword`` under policy ``allow``. Each list is computed once, and all is one shuffle by query."""
    fused = fuse([dense_list, keyword_list, exact_list]).withColumn("strong", F.exists("lists", lambda x: x != 1))
    if thresholded:
        if not (mode == "keyword" and policy == "allow"):
            fused = fused.withColumn("_open", F.max("strong").over(Window.partitionBy("query_id"))).filter("_open")
        if policy != "allow":
            fused = fused.filter("strong")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first", "id")
    return fused.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top_k).select("query_id", "id", "score", "rank", "dense_score")


def rerank(candidates: DataFrame, question: str = "question", text: str = "text", top_k: int = 5, keep_exact: bool = True, min_score: int | None = None, prefix: tuple[str, str] | None = None) -> DataFrame:
    """Adds rerank_score (distinct characters of the question that the text has), final_rank and degraded; at most top_k rows a
    query. With keep_exact, exact rows take the first places, and need no min_score, but the final order is the reranker's.
    prefix names columns of a document's name and section that the reranker reads before the text. Questions that can't
    be scored, null ones, keep the first stage's order and are degraded."""
    content = F.col(text)
    if prefix:
        content = F.concat(F.concat_ws(" ", *prefix), F.lit("："), content)
    letters = F.array_distinct(F.split(F.regexp_replace(F.lower(question), r"\s", ""), ""))
    d = candidates.withColumn("_text", F.lower(content))
    d = d.withColumn("rerank_score", F.size(F.filter(letters, lambda c: F.contains(F.col("_text"), c))).cast("long")).drop("_text")
    d = d.withColumns({"degraded": F.col(question).isNull(), "rerank_score": F.when(F.col(question).isNotNull(), F.col("rerank_score"))})
    if min_score is not None:
        passes = (F.col("rerank_score") >= min_score) | F.col("degraded")
        d = d.filter(passes | F.col("exact") if keep_exact else passes)
    order = [F.col("rerank_score").desc(), F.col("rank")]
    first = [F.col("exact").desc()] if keep_exact else []
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*first, *order))).filter(F.col("_r") <= top_k).drop("_r")
    return d.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
