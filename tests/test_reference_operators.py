"""Goldens for text functions, fusion, windows, budgets and statistics."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import analytics as an
from lodestar.operators import retrieval as rt
from lodestar.sources.tables import question_set


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_text_functions(spark):
    assert one(spark, tx.halfwidth, "ＡＢ－１２３，中") == ["AB-123，中"]
    assert one(spark, tx.token_estimate, "中文ab", "", "a" * 2001) == [3, 0, 601]
    assert one(spark, tx.is_page_number, "- 3 -", "第 3 頁", "Page 3 of 9", "Rule 3", "") == [True, True, True, False, False]
    assert one(spark, tx.line_signature, " 第 12 頁 ", " Title ") == ["第#頁", "Title"]
    assert one(spark, tx.clean_lines, "a\t b  \r\nc d") == ["a b\nc d"]
    assert one(spark, tx.search_text, "  HR-01  Form X ") == ["hr01 form x"]
    assert one(spark, tx.exact_terms, "form hr01 and b2 x9z hr01") == [["hr01", "x9z"]]
    assert one(spark, tx.bigrams, "abc", "a") == [["ab", "bc"], []]
    assert one(spark, tx.line_signature, "Page 12 of 30", "2024-01") == ["Page#of#", "#-#"]
    assert one(spark, lambda c: tx.clean_lines(c, keeps_layout=True), "a\t b  \r\nc") == ["a\t b  \nc"]
    assert one(spark, tx.squeeze_blank_lines, "\n\na\n\n\n\nb\n") == ["a\n\nb"]
    assert one(spark, lambda c: tx.neutral_tags(c, "reference"), "<Reference>x</reference>") == ["＜reference＞x＜/reference＞"]
    assert one(spark, tx.redact_secrets, "key sk-abcdefghijk") == ["key sk-***"]


def ranks(spark, *ids):
    return spark.createDataFrame([(1, i, 1.0 - k / 10, k + 1) for k, i in enumerate(ids)], "query_id long, id long, score double, rank long")


def test_fusion_keeps_first_appearance(spark):
    got = rt.hybrid(ranks(spark, 101, 88), ranks(spark, 205, 7, 101), ranks(spark), thresholded=False).orderBy("rank").collect()
    assert [r.id for r in got] == [101, 205, 88, 7]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 63, abs=1e-9)


def test_gate(spark):
    none = ranks(spark)
    assert rt.hybrid(none, ranks(spark, 1, 2), none).count() == 0
    assert rt.hybrid(none, ranks(spark, 1, 2), none, policy="allow").count() == 0
    assert [r.id for r in rt.hybrid(none, ranks(spark, 1, 2), ranks(spark, 2)).collect()] == [2]
    assert rt.hybrid(none, ranks(spark, 1, 2), ranks(spark, 2), policy="allow").count() == 2


def test_dense_is_strict_and_breaks_ties_by_id(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.id, r.score) for r in rt.dense(queries, points, k=2).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0)]
    assert {r.id for r in rt.dense(queries, points, threshold=0.0).collect()} == {1, 3}


def test_history(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "lost"), (1, 4, "user", "q2"), (1, 5, "assistant", "a" * 50), (1, 6, "assistant", "later")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.question, r.back) for r in an.recent_turns(m).orderBy("back").collect()] == [("q2", 1), ("q1", 2)]
    got = an.history_window(m, budget=10).collect()
    assert [(r.question, r.answer) for r in got] == [("q2", "a" * 8)]


def test_context_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, 1, "a" * 50), (1, 2, "b" * 30), (1, 3, "c")], "query_id long, rank long, text string")
    assert [r.rank for r in an.context_blocks(hits, 60).collect()] == [1]
    assert [r.rank for r in an.context_blocks(hits, 10).collect()] == [1]


def test_statistics(spark):
    log = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 6, 7, 10)] + [("a", None)], "k string, v double")
    r = an.nearest_rank(log, "k", "v").first()
    assert (r.p50, r.p95, r.n) == (4.0, 10.0, 8)
    report = {x.type: x for x in an.recall_report(spark.createDataFrame([(1, "x", 1), (2, "x", 4), (3, "x", None)], "query_id long, type string, rank long")).collect()}
    assert report["all"].mrr == pytest.approx((1 + 0.25) / 3, abs=1e-6) and report["x"].recall_3 == pytest.approx(1 / 3, abs=1e-6)
    assert {x.k: x.n for x in an.distribution(log, "k", ["a", "b"]).collect()} == {"a": 9, "b": 0}
    assert log.agg(an.rate("k = 'z'", "k = 'y'")).first()[0] is None


def test_fixed_chunks_overlap(spark):
    got = an.fixed_chunks(spark.createDataFrame([(1, "x" * 3700), (2, "x" * 3701), (3, "  "), (4, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.chunk_index, len(r.content)) for r in got) == [(1, 0, 2000), (1, 1, 2000), (2, 0, 2000), (2, 1, 2000), (2, 2, 301)]


def test_question_set(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "a", "type": "exact", "question": "q", "expected": [{"document": "d", "section": None}]}) + "\n\n")
    assert [r.expected[0].document for r in question_set(spark, str(tmp_path / "q.jsonl")).collect()] == ["d"]


def test_zero_vectors_take_no_place(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, vector array<double>")
    rows = [(10 + i, [0.0, 0.0]) for i in range(4)] + [(20 + i, [1.0, float(i)]) for i in range(4)]
    points = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    got = rt.dense(q, points, 3).collect()
    assert sorted((r.query_id, r.rank, r.id) for r in got) == [(1, 1, 20), (1, 2, 21), (1, 3, 22)]
