"""Evaluation of retrieval, answers and conversations against what was expected, and the rows that are logged and sent on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.answers import section_matches
from lodestar.functions.text import neutral_tags
from lodestar.operators.citations import REASONS


def first_hits(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank, hit_score, first_stage_rank) of each question in ``expected`` (query_id, expected array<struct<document,
    section>>): of the first of its rows (query_id, final_rank, retrieval_rank, document, section, dense_score, score) that is
    one of the expected; nulls for a miss. The score is the cosine where there is one. Rows are reduced before they meet."""
    e = expected.select("query_id", "expected")
    hit = F.exists("expected", lambda x: (x["document"] == F.col("document")) & section_matches(x["section"], F.col("section")))
    first = F.struct("final_rank", F.coalesce("dense_score", "score").alias("hit_score"), "retrieval_rank")
    found = rows.join(e, "query_id").filter(hit).groupBy("query_id").agg(F.min_by(first, "final_rank").alias("m"))
    found = found.select("query_id", F.col("m.final_rank").alias("rank"), "m.hit_score", F.col("m.retrieval_rank").alias("first_stage_rank"))
    return e.select("query_id").join(found, "query_id", "left")


def threshold_report(questions: DataFrame) -> DataFrame:
    """(line, right, wrong): no-answer questions without candidates, answerable ones with some, and answerable ones with an expected
    chunk in their context. questions (type, has_candidates, in_context); a null verdict is wrong."""
    empty = F.coalesce(F.col("type") == "no_answer", F.lit(False))
    lines = [("no_answer_rejected", empty, ~F.col("has_candidates")), ("answerable_passed", ~empty, F.col("has_candidates")), ("answerable_in_context", ~empty, F.col("in_context"))]
    one = questions.agg(*(x for name, of, right in lines for x in (F.count_if(of & F.coalesce(right, F.lit(False))).alias(name), F.count_if(of).alias(f"of_{name}"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("line"), F.col(name).alias("right"), (F.col(f"of_{name}") - F.col(name)).alias("wrong")) for name, _, _ in lines))))


def score_distribution(questions: DataFrame) -> DataFrame:
    """(answerable, n, least, mean, most) of the best cosine; questions (type, top_score), null scores left out."""
    d = questions.filter("top_score IS NOT NULL").withColumn("answerable", ~F.coalesce(F.col("type") == "no_answer", F.lit(False)))
    r = lambda c, name: F.round(c, 6).alias(name)
    return d.groupBy("answerable").agg(F.count(F.lit(1)).alias("n"), r(F.min("top_score"), "least"), r(F.avg("top_score"), "mean"), r(F.max("top_score"), "most"))


def citation_metrics(answers: DataFrame) -> DataFrame:
    """One row: how many of the answered questions cite, how many of those with a verdict hit, citations per answered question, invalid
    references by reason, and no-answer questions that show no source. answers (type, status, citations array, invalid
    array<struct<reason, ...>>, hit); a null status is a question that failed. Rates are null over nothing."""
    answered, empty = F.col("status") == "answered", (F.col("type") == "no_answer") & F.col("status").isNotNull()
    n = F.coalesce(F.size("citations"), F.lit(0))
    judged = answered & F.col("hit").isNotNull()
    rate = lambda part, whole: F.round(F.try_divide(F.count_if(part).cast("double"), F.count_if(whole)), 6)
    found = F.transform("invalid", lambda x: x["reason"])
    counts = [F.coalesce(F.sum(F.size(found) - F.size(F.array_remove(found, r))), F.lit(0)).cast("long").alias(r) for r in REASONS]
    return answers.agg(
        F.count_if(answered).alias("answered"), rate(answered & (n > 0), answered).alias("citation_rate"), rate(judged & F.col("hit"), judged).alias("hit_rate"),
        F.round(F.avg(F.when(answered, n)), 6).alias("mean_citations"), *counts, F.count_if(empty).alias("no_answer"), F.count_if(empty & (n == 0)).alias("no_answer_without_sources"),
    )


def conversation_costs(cases: DataFrame) -> DataFrame:
    """One row of what follow-up questions cost: cases (status, rewrite_ms, retrieval_ms, finish, rewrite_tokens, input_tokens,
    kept_turns, window_turns); rewrites that were skipped have no time and no tokens. Percentiles by nearest rank."""
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY rewrite_ms)")
    status = F.coalesce(F.col("status"), F.lit("skipped"))
    return cases.agg(
        F.count_if(status != "skipped").alias("rewritten"), F.count_if(status == "unchanged").alias("unchanged"), F.count_if(status.startswith("fallback")).alias("fallbacks"),
        F.count_if(F.col("kept_turns") < F.col("window_turns")).alias("shortened"), p(0.5).alias("rewrite_p50"), p(0.95).alias("rewrite_p95"),
        F.round(F.coalesce(F.avg("retrieval_ms"), F.lit(0))).cast("long").alias("retrieval_mean"), F.count_if(F.col("finish") == "length").alias("cut"),
        F.max("rewrite_tokens").alias("most_rewrite_tokens"), F.max("input_tokens").alias("most_input_tokens"),
    )


def index_check(documents: DataFrame, chunks: DataFrame, points: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, n_chunks, n_points, result): equal, not_indexed (no point though there are chunks) or mismatch, of each document; and
    orphan for points whose document is gone. Both sides are counted before they are joined."""
    c = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
    p = points.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_points"))
    d = documents.select(key).withColumn("_there", F.lit(True)).join(p, key, "full").join(c, key, "left")
    d = d.fillna(0, ["n_chunks", "n_points"])
    result = F.when(F.col("_there").isNull(), "orphan").when(F.col("n_chunks") == F.col("n_points"), "equal").when(F.col("n_points") == 0, "not_indexed").otherwise("mismatch")
    return d.select(key, "n_chunks", "n_points", result.alias("result"))


def page_spread(chunks: DataFrame, key: str = "doc_id", limit: int = 600) -> DataFrame:
    """(key, n, least, mean, most, over, across) of chunks (token_count, page_start, page_end): across are those on several pages."""
    t = F.col("token_count")
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("least"), F.round(F.avg(t), 6).alias("mean"), F.max(t).alias("most"), F.count_if(t > limit).alias("over"), F.count_if(F.col("page_end") > F.col("page_start")).alias("across"))


def reference_context(hits: DataFrame, budget: int = 6000) -> DataFrame:
    """(query_id, context, refs array<long>, dropped): numbered blocks in order of rank, with neutral tags, up to the first that
    overflows the budget; the first always stays. hits (query_id, rank, text); a question's few hits are one row."""
    w = Window.partitionBy("query_id").orderBy("rank")
    d = hits.withColumn("_i", F.row_number().over(w))
    d = d.withColumn("_block", F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("] "), neutral_tags(F.coalesce("text", F.lit("")), "reference")))
    d = d.withColumn("_stays", (F.sum(F.char_length("_block")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= budget) | (F.col("_i") == 1))
    g = d.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("_stays"), F.struct("_i", "_block")))).alias("b"), F.count_if(~F.col("_stays")).alias("dropped"))
    return g.select("query_id", F.array_join("b._block", "\n").alias("context"), F.transform("b._i", lambda i: i.cast("long")).alias("refs"), "dropped")


#: Columns of the query log that an answer has under another name, or as a list that is counted.
_COUNTED = {"passed_count": "chunks", "citation_count": "citations", "invalid_ref_count": "invalid"}
_TAKEN = (
    "conversation_id", "question", "rewritten_question", "rewrite_status_key", "rewrite_ms", "top1_score", "score_threshold", "status_key", "llm_called", "uncited", "embedding_model", "provider", "model",
    "input_tokens", "output_tokens", "retrieval_ms", "reranked", "rerank_degraded", "rerank_ms", "llm_ms",
)


def log_rows(answers: DataFrame, source: str, at: Column) -> DataFrame:
    """The query log's rows of answers: scores as decimal(6,4), lists as their sizes, where and when it was asked."""
    scores = {c: F.col(c).cast("decimal(6,4)").alias(c) for c in ("top1_score", "score_threshold")}
    counts = [F.greatest(F.coalesce(F.size(of), F.lit(0)), F.lit(0)).alias(c) for c, of in _COUNTED.items()]
    return answers.select(*(scores.get(c, F.col(c)) for c in _TAKEN), *counts, F.lit(source).alias("source_key"), at.alias("created_at"))


def appended(messages: DataFrame, conversations: DataFrame, exchanges: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The new messages of exchanges (conversation_id, number, question, rewritten_question, rewrite_status_key, answer,
    status_key) behind those that are there (conversation_id, turn), and the conversations with the time of those touched
    set. Exchanges of unknown conversations are left out. Only the conversations' last turns are joined."""
    last = messages.join(exchanges.select("conversation_id").distinct(), "conversation_id", "left_semi").groupBy("conversation_id").agg(F.max("turn").alias("_last"))
    own = exchanges.join(conversations.select("conversation_id"), "conversation_id", "left_semi").join(last, "conversation_id", "left")
    w = Window.partitionBy("conversation_id").orderBy("number")
    first = F.coalesce(F.col("_last"), F.lit(-1)) + 2 * F.row_number().over(w) - 1
    own = own.withColumn("_first", first.cast("long"))
    none = F.lit(None).cast("string")
    pair = F.array(
        F.struct(F.col("_first").alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text"), F.col("rewritten_question").alias("rewritten_question"), F.col("rewrite_status_key").alias("rewrite_status_key"), none.alias("status_key")),
        F.struct((F.col("_first") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"), none.alias("rewritten_question"), none.alias("rewrite_status_key"), F.col("status_key").alias("status_key")),
    )
    rows = own.select("conversation_id", F.inline(pair)).withColumn("created_at", at)
    touched = own.select("conversation_id").distinct().withColumn("_touched", F.lit(True))
    return rows, conversations.join(touched, "conversation_id", "left").withColumn("updated_at", F.when(F.col("_touched"), at).otherwise(F.col("updated_at"))).drop("_touched")
