"""Evaluation, query-log statistics, conversation windows, chunks, context and index reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import CJK, token_estimate
from lodestar.operators.chunking import Budget, chunk_documents


def log_window(log: DataFrame, since: str, until: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows of [since, until) whose event_type is not excluded; the predicates reach the scan."""
    out = log.filter((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp")))
    return out.filter(~F.col("event_type").isin(*exclude)) if exclude else out


def distribution(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts of every value of the domain, zeros kept, nulls and others ignored."""
    values = df.sparkSession.createDataFrame([(x,) for x in domain], f"{column} string")
    return values.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rate(part: str, whole: str):
    """count_if(part) / count_if(whole), null without attempts."""
    return F.round(F.try_divide(F.count_if(F.expr(part)).cast("double"), F.count_if(F.expr(whole)).cast("double")), 6)


def nearest_rank(df: DataFrame, key: str, value: str) -> DataFrame:
    """p50 and p95 by nearest rank, nulls skipped."""
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY {value})")
    return df.groupBy(key).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.count(value).alias("n"))


def stage_percentiles(log: DataFrame, stages: dict[str, str], total: str = "total") -> DataFrame:
    """(stage, p50, p95, n) of each stage's column and of their sum, in which a missing stage is 0; nulls are skipped
    elsewhere. One pass: stages become rows before they are grouped."""
    sums = sum((F.coalesce(F.col(c), F.lit(0)) for c in stages.values()), F.lit(0))
    parts = F.array(*(F.struct(F.lit(k).alias("stage"), F.col(c).cast("double").alias("ms")) for k, c in stages.items()), F.struct(F.lit(total).alias("stage"), sums.cast("double").alias("ms")))
    return nearest_rank(log.select(F.inline(parts)), "stage", "ms")


def recall_report(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20), skip: tuple[str, ...] = ("no_answer",)) -> DataFrame:
    """Recall@K and MRR over ``all`` answerable questions and by type: ranks (query_id, type, rank null for a miss). Questions
    of the types in ``skip`` have nothing to find and are left out; without others there are no rows but none for ``all``."""
    d = ranks.filter(F.col("type").isNull() | ~F.col("type").isin(*skip)) if skip else ranks
    recalls = [F.round(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"recall_{k}") for k in ks]
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")
    out = d.rollup("type").agg(F.grouping("type").alias("_all"), F.count(F.lit(1)).alias("n"), *recalls, mrr)
    return out.withColumn("type", F.when(F.col("_all") == 1, "all").otherwise(F.col("type"))).drop("_all")


def threshold_confusion(questions: DataFrame) -> DataFrame:
    """One row of counts: no_answer rejected, answerable passed, and errors of either kind. questions (type, has_candidates);
    those without a verdict (null) count nowhere."""
    empty, open_ = F.col("type") == "no_answer", F.col("has_candidates")
    return questions.agg(
        F.count_if(empty & ~open_).alias("no_answer_rejected"), F.count_if(empty & open_.isNotNull()).alias("no_answer"), F.count_if(~empty & open_).alias("answerable_passed"),
        F.count_if(~empty & open_.isNotNull()).alias("answerable"), F.count_if(open_ == empty).alias("errors"))


def token_ratios(probes: DataFrame, key: str | None = None) -> DataFrame:
    """Actual tokens per character and per estimated token, over all rows or by key: probes (chars, estimated, actual)."""
    ratio = lambda a, b: F.round(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), 6)
    columns = [ratio("actual", "chars").alias("per_char"), ratio("actual", "estimated").alias("per_estimate")]
    return (probes.groupBy(key) if key else probes).agg(*columns)


def answer_summary(results: DataFrame) -> DataFrame:
    """By type: results (type, passed, blocked, truncated, failed, tokens, ms) as counts and means."""
    counts = [F.count_if(F.col(c)).alias(f"n_{c}") for c in ("passed", "blocked", "truncated", "failed")]
    return results.groupBy("type").agg(F.count(F.lit(1)).alias("n"), *counts, F.round(F.avg("tokens"), 6).alias("avg_tokens"), F.round(F.avg("ms"), 6).alias("avg_ms"))


def degraded_latency(log: DataFrame, key: str) -> DataFrame:
    """By key: p50 and p95 of rerank_ms over reranked rows only, and how many rows were degraded."""
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY CASE WHEN reranked THEN rerank_ms END)")
    return log.groupBy(key).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.count_if("reranked").alias("n_reranked"), F.count_if("degraded").alias("n_degraded"))


def message_faults(messages: DataFrame) -> DataFrame:
    """(conv_id, fault): blank (a message without text), late_system (a system message behind another role), last_not_user,
    or ok; the first that holds. Conversations are reduced by partial aggregates; none is gathered."""
    other = F.col("role") != "system"
    d = messages.groupBy("conv_id").agg(
        F.max(F.btrim(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.min(F.when(other, F.col("turn"))).alias("first"), F.max(F.when(~other, F.col("turn"))).alias("system"), F.max_by("role", "turn").alias("last"))
    return d.select("conv_id", F.when(F.col("blank"), "blank").when(F.col("system") > F.col("first"), "late_system").when(F.col("last") != "user", "last_not_user").otherwise("ok").alias("fault"))


def turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): user rows with an assistant row right behind them. Where messages have a status,
    answers that were interrupted make no turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = messages.filter(F.col("role").isin("user", "assistant"))
    status = F.lead("status").over(w) if "status" in messages.columns else F.lit(None).cast("string")
    d = d.withColumns({"_r": F.lead("role").over(w), "_s": status, "answer": F.lead("text").over(w)})
    return d.filter("role = 'user' AND _r = 'assistant' AND NOT _s <=> 'interrupted'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def recent_turns(messages: DataFrame, n: int = 5) -> DataFrame:
    """The last n turns, with their position from the end."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns(messages).withColumn("back", F.row_number().over(w).cast("long")).filter(F.col("back") <= n)


def history_window(messages: DataFrame, n: int = 5, budget: int = 1500) -> DataFrame:
    """recent_turns() without the oldest while the characters exceed the budget; the newest always stays, its answer cut
    to what the budget leaves."""
    d = recent_turns(messages, n).withColumn("size", F.length("question") + F.length("answer"))
    w = Window.partitionBy("conv_id").orderBy("back").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("chars", F.sum("size").over(w)).filter((F.col("chars") <= budget) | (F.col("back") == 1))
    room = F.greatest(F.lit(0), budget - F.length("question"))
    return d.select("conv_id", "turn", "back", "question", F.when(F.col("chars") > budget, F.substring(F.col("answer"), F.lit(1), room)).otherwise(F.col("answer")).alias("answer"))


def context_blocks(hits: DataFrame, budget: int = 6000) -> DataFrame:
    """Blocks ``[rank] text`` in order of rank up to the first that overflows the budget; the first always stays."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = hits.withColumn("block", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text")))
    d = d.withColumn("chars", F.sum(F.length("block")).over(w).cast("long"))
    return d.filter((F.col("chars") <= budget) | (F.col("rank") == 1))


def fixed_chunks(docs: DataFrame, size: int = 2000, stride: int = 1700) -> DataFrame:
    """(doc_id, chunk_index, content): windows of 600 tokens, 90 of overlap. Texts without wide characters, at 0.3 tokens a
    character, are cut natively; those with some, which cost other tokens, as chunk_documents does. A chunk exists if it is the
    first or the one before it stops short of the end; white space at its ends is trimmed, and blank chunks have no number.
    """
    n = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(stride))).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.btrim(F.substring(F.col("text"), i * stride + 1, F.lit(size)), F.lit(" \t\n\r\0\x0b")))
    full, wide = docs.filter(F.col("text").isNotNull()), F.col("text").rlike(CJK)
    narrow = full.filter(~wide).select("doc_id", F.posexplode(F.filter(windows, lambda x: x != "")).alias("i", "content")).select("doc_id", F.col("i").cast("long").alias("chunk_index"), "content")
    budget = Budget(round(size * 0.3), 1 - stride / size)
    cut = chunk_documents(full.filter(wide).select("doc_id", "text", F.array().cast("array<struct<page:long,start:long>>").alias("pages")), "fixed", budget)
    return narrow.unionByName(cut.select("doc_id", "chunk_index", "content"))


def chunk_stats(chunks: DataFrame, limit: int = 600) -> DataFrame:
    t = token_estimate(F.col("content"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("least"), F.round(F.avg(t), 6).alias("mean"), F.max(t).alias("most"), F.count_if(t > limit).alias("over"))


def reconcile(docs: DataFrame, points: DataFrame) -> DataFrame:
    """documents against points: n_points and status ok, or missing with none."""
    p = points.groupBy(F.col("vec_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(p, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_points"), F.when(F.col("n").isNull(), "missing").otherwise("ok").alias("status"))


def same_hash(docs: DataFrame) -> DataFrame:
    """Documents that share their SHA-256 with others: the least id and the number of copies, for each hash."""
    d = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def scanned_guard(pages: DataFrame, least: int = 20, key: str = "doc_id") -> DataFrame:
    """Documents whose pages have fewer characters other than white space, on average, than pages of text would."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]", ""))
    d = pages.groupBy(key).agg(F.avg(n).alias("mean"))
    return d.select(key, F.round("mean", 6).alias("mean_visible"), (F.col("mean") < least).alias("rejected"))
