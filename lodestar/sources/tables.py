"""Tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUESTION = "id STRING, type STRING, question STRING, expected ARRAY<STRUCT<document: STRING, section: STRING>>, expected_answer STRING"
CONVERSATION = "id STRING, type STRING, history ARRAY<STRUCT<question: STRING, answer: STRING>>, question STRING, expected ARRAY<STRUCT<document: STRING, section: STRING>>, expected_rewrite STRING, note STRING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """JSONL questions; a malformed line fails the read."""
    return spark.read.schema(QUESTION).option("mode", "FAILFAST").json(path)


def conversation_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONVERSATION).option("mode", "FAILFAST").json(path)
