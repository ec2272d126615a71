"""A pipeline over ``documents``: quality rules, toxicity, near-duplicate removal, source mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents. ``run`` writes each stage's result as Parquet to the shared folder and reads it for the next, so
that a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import jaccard, mixing, packing, quality, toxicity
from lodestar.llm.common import filtered, stored, table


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are too frequent in their source. Null texts have no words and
    go; null sources are a source; repeated rows are judged alike. No rows give none."""
    kept = filtered(quality.quality_rules(docs, keep=("lang", "source")), "kept")
    return _documents(kept.withColumnRenamed("clean_text", "text"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Null texts score as empty ones; repeated rows score alike; a score of exactly 0.3 is
    toxic. No rows give none."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=("text", "lang", "source"))
    return _documents(scored.filter("predicted = 0"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that links connect, one row stays: that with the least doc_id (null last), then the first."""
    rows = stored(docs.withColumns({"_row": F.monotonically_increasing_id(), "_own": F.col("doc_id")}), "rows")
    linked = jaccard.jaccard_join(rows, doc_id="_row", keep=("_own",)).filter("n_links > 0")
    linked = stored(linked.select(F.col("doc_id").alias("gone"), "component_id", "_own"), "linked")
    stays = linked.groupBy("component_id").agg(F.min(F.struct(F.col("_own").isNull(), "_own", "gone")).alias("m")).select(F.col("m.gone").alias("stays"))
    gone = stored(linked.select("gone").join(stays, F.col("gone") == F.col("stays"), "left_anti"), "near-duplicates")  # its size decides whether Spark broadcasts it
    return _documents(rows.join(gone, F.col("_row") == F.col("gone"), "left_anti"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: what the mix takes of a document once, and what it takes of it a second time. Null texts are never
    taken; null sources come last; repeated rows each take part, ties in any order. No rows give none."""
    mix = mixing.Mixture(docs, keep_text=True, keep=("lang",)).documents()
    return _documents(mix.withColumnsRenamed({"_source": "source", "_keep_lang": "lang"}))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in the sequences. A null text is the end token alone; equal rows each get
    their own place. No rows give none."""
    return packing.best_fit_packing(docs, packing.word_tokenizer(), with_ids=False)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the softmax, the permutations or the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
