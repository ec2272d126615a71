"""Retrieval as one operator: modes, models and their thresholds, widening, gate, live documents and reranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.catalog import canonical_model, eligible
from lodestar.operators.retrieval import CANDIDATES, RRF_K, dense_hits, exact_search, fuse, keyword, ranked, rerank
from lodestar.session import written


@dataclass(frozen=True)
class Options:
    """policy: what keyword hits alone may do, ``exact_only`` or ``allow``. thresholds: by model, without ``:latest``; none are
    applied if it is None. candidates: how many the first stage takes from a list at least, and how many are reranked."""

    mode: str = "hybrid"
    policy: str = "exact_only"
    top_k: int = 5
    thresholds: dict[str, float] | None = None
    dense_candidates: int = CANDIDATES
    keyword_candidates: int = CANDIDATES
    rrf_k: int = RRF_K
    rerank: bool = False
    rerank_candidates: int = CANDIDATES
    keep_exact: bool = True
    min_score: int | None = None
    prefix: tuple[str, str] | None = None

    @property
    def first_stage(self) -> int:
        """Reranking needs as many as it reranks, even if fewer are asked for."""
        return max(self.top_k, self.rerank_candidates) if self.rerank else self.top_k


@dataclass(frozen=True)
class Retrieved:
    """rows: the chunks of each question in their final order. report: one row a question, answered or not."""

    rows: DataFrame
    report: DataFrame


def _no_hits(spark) -> DataFrame:
    return spark.createDataFrame([], "query_id long, id long, score double, rank long")


def retrieve(queries: DataFrame, chunks: DataFrame, documents: DataFrame, points: DataFrame | None = None, options: Options = Options()) -> Retrieved:
    """queries (query_id, text, vector, model), chunks (id, document_id, text, ...), documents (document_id, status_key, ...) and
    points (id, vector, model). Only chunks of indexed documents are found; the dense list, which does not know states, is
    taken first and then passed over for them, so that live ids fill the places. Ids alone are ranked and cut; texts
    join what is left. A question whose model has no threshold is an error where thresholds are applied.

    rows: query_id, id, score (cosine in mode ``dense``, else the fused score), dense_rank, dense_score, keyword_rank,
    keyword_score, exact, retrieval_rank, final_rank, rerank_score, and the chunk's other columns. report: query_id,
    threshold, dense_top_score (with or without threshold), gated.
    """
    o, spark = options, queries.sparkSession
    asked = queries.select("query_id", "text", *([] if points is None else ["vector"]), *([canonical_model(F.col("model")).alias("model")] if "model" in queries.columns else []))
    limit = F.lit(None).cast("double")
    if o.thresholds is not None and o.mode != "keyword":
        known = F.create_map(*(x for m, t in o.thresholds.items() for x in (F.lit(m), F.lit(float(t))))) if o.thresholds else F.create_map().cast("map<string,double>")
        limit = F.coalesce(F.try_element_at(known, F.col("model")), F.raise_error(F.concat(F.lit("no threshold for model "), F.coalesce("model", F.lit("null")))).cast("double"))
    asked = asked.withColumn("threshold", limit)
    thresholded = o.thresholds is not None

    found = _no_hits(spark)
    if o.mode != "keyword":
        k = o.first_stage if o.mode == "dense" else max(o.first_stage, o.dense_candidates)
        own = points.select("id", "vector", *([canonical_model(F.col("model")).alias("model")] if "model" in points.columns else []))
        found = written(ranked(dense_hits(asked, own, k, exclude_self=False), k), "dense")
    dense_list = found
    if thresholded:
        dense_list = found.join(asked.select("query_id", "threshold"), "query_id").filter(F.col("score") > F.col("threshold")).drop("threshold")
    keyword_list = exact_list = _no_hits(spark)
    if o.mode != "dense":
        live = eligible(chunks, documents)
        keyword_list = written(keyword(asked, live, o.keyword_candidates), "keyword")
        exact_list = written(exact_search(asked, live, o.keyword_candidates), "exact")

    fused = fuse([dense_list, keyword_list, exact_list], o.rrf_k).withColumn("strong", F.exists("lists", lambda x: x != 1))
    if thresholded:
        if not (o.mode == "keyword" and o.policy == "allow"):
            fused = fused.withColumn("_open", F.max("strong").over(Window.partitionBy("query_id"))).filter("_open")
        if o.policy != "allow":
            fused = fused.filter("strong")
    indexed = documents.filter("status_key = 'indexed'").select("document_id")
    places = chunks.select("id", "document_id").join(indexed, "document_id", "left_semi").select("id")
    order = [F.col("first")] if o.mode == "dense" else [F.col("score").desc(), F.col("first"), F.col("id")]
    fused = fused.join(places, "id", "left_semi").withColumn("retrieval_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).filter(F.col("retrieval_rank") <= o.first_stage)
    lists = [x.select("query_id", "id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"_{name}")) for name, x in (("dense", dense_list), ("keyword", keyword_list))]
    for x in lists:
        fused = fused.join(x, ["query_id", "id"], "left")
    score = F.round("_dense", 6) if o.mode == "dense" else F.col("score")
    cut = fused.select("query_id", "id", score.alias("score"), "dense_rank", F.round("_dense", 6).alias("dense_score"), "keyword_rank", F.col("_keyword").alias("keyword_score"), F.array_contains("lists", 2).alias("exact"), "retrieval_rank")
    rows = cut.join(chunks, "id")
    if not o.rerank:
        rows = rows.withColumns({"final_rank": F.col("retrieval_rank"), "rerank_score": F.lit(None).cast("long")}).filter(F.col("final_rank") <= o.top_k)
    else:
        rows = _reranked(rows.join(asked.select("query_id", F.col("text").alias("_question")), "query_id"), o)
    top = found.groupBy("query_id").agg(F.round(F.max("score"), 6).alias("dense_top_score"))
    report = asked.select("query_id", "threshold").join(top, "query_id", "left")
    answered = cut.select("query_id").distinct().withColumn("_some", F.lit(True))
    report = report.join(answered, "query_id", "left").select("query_id", "threshold", "dense_top_score", F.col("_some").isNull().alias("gated"))
    return Retrieved(rows, report)


def _reranked(rows: DataFrame, o: Options) -> DataFrame:
    """The head reranked, what it leaves room for, and then the tail as the first stage has it."""
    head = rows.withColumn("rank", F.col("retrieval_rank")).filter(F.col("retrieval_rank") <= o.rerank_candidates)
    head = rerank(head, "_question", "text", min(o.top_k, o.rerank_candidates), o.keep_exact, o.min_score, o.prefix).drop("rank", "degraded").withColumn("_part", F.lit(0))
    tail = rows.filter(F.col("retrieval_rank") > o.rerank_candidates).withColumns({"final_rank": F.col("retrieval_rank"), "rerank_score": F.lit(None).cast("long"), "_part": F.lit(1)})
    w = Window.partitionBy("query_id").orderBy("_part", "final_rank")
    both = head.unionByName(tail).withColumn("final_rank", F.row_number().over(w).cast("long"))
    return both.filter(F.col("final_rank") <= o.top_k).drop("_part", "_question")
