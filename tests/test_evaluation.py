"""Goldens for evaluation, log rows, uploads by content, line numbers and plug points."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.functions import answers as aw
from lodestar.operators import catalog as ca
from lodestar.operators import chunking as ck
from lodestar.operators import evaluation as ev
from lodestar.plans import plugins as pl
from lodestar.sources import files as fl
from lodestar.sources.tables import CONVERSATION, QUESTION, conversation_set


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_first_hits(spark):
    rows = spark.createDataFrame(
        [(1, 1, 3, "a.pdf", "第二章 / 第七條之1", 0.9, 0.03), (1, 2, 1, "a.pdf", "第二章 / 第七條", None, 0.02), (1, 3, 2, "a.pdf", "第七條", 0.5, 0.01), (2, 1, 1, "b.pdf", None, 0.4, 0.01), (3, 1, 1, "c.pdf", "x", 0.3, 0.01)],
        "query_id long, final_rank long, retrieval_rank long, document string, section string, dense_score double, score double",
    )
    e = spark.createDataFrame([(1, [("z", None), ("a.pdf", "第七條")]), (2, [("b.pdf", None)]), (3, [("c.pdf", "y")]), (4, [])], "query_id long, expected array<struct<document:string,section:string>>")
    assert values(ev.first_hits(rows, e), "query_id") == [(1, 2, 0.02, 1), (2, 1, 0.4, 1), (3, None, None, None), (4, None, None, None)]


def test_reports(spark):
    q = spark.createDataFrame([("no_answer", False, False), ("no_answer", True, False), ("exact", True, True), ("exact", True, None), ("exact", None, None), (None, False, True)], "type string, has_candidates boolean, in_context boolean")
    assert values(ev.threshold_report(q), "line") == [("answerable_in_context", 2, 2), ("answerable_passed", 2, 2), ("no_answer_rejected", 1, 1)]
    a = spark.createDataFrame(
        [("exact", "answered", [1, 2], [("out_of_range",)], True), ("exact", "answered", [], [], False), ("exact", "answered", [3], [("non_numeric",), ("out_of_range",)], None), ("no_answer", "insufficient_by_llm", [], [], None), ("no_answer", "answered", [1], None, None), ("no_answer", None, None, None, None)],
        "type string, status string, citations array<int>, invalid array<struct<reason:string>>, hit boolean",
    )
    (got,) = ev.citation_metrics(a).collect()
    assert got.asDict() == dict(answered=4, citation_rate=0.75, hit_rate=0.5, mean_citations=1.0, insufficient_answer=0, out_of_range=2, source_missing=0, non_numeric=1, no_answer=2, no_answer_without_sources=1)
    none = ev.citation_metrics(a.limit(0)).first()
    assert none.citation_rate is None and none.out_of_range == 0 and none.mean_citations is None
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "document_id long")
    many = lambda *ids: spark.createDataFrame([(i,) for i in ids], "document_id long")
    assert values(ev.index_check(docs, many(1, 1, 2, 3), many(1, 1, 2, 2, 9, None)), "document_id") == [(1, 2, 2, "equal"), (2, 1, 2, "mismatch"), (3, 1, 0, "not_indexed"), (4, 0, 0, "equal"), (9, 0, 1, "orphan")]
    cases = spark.createDataFrame([("skipped", None, 10.0, None, None, 5, 1, 1), ("unchanged", 30.0, 21.0, "stop", 100, None, 1, 2), ("fallback_empty", 10.0, 30.0, "length", 50, 7, 2, 2)], "status string, rewrite_ms double, retrieval_ms double, finish string, rewrite_tokens long, input_tokens long, kept_turns int, window_turns int")
    assert tuple(ev.conversation_costs(cases).first()) == (2, 1, 1, 1, 10.0, 30.0, 20, 1, 100, 7)


def test_contexts(spark):
    hits = spark.createDataFrame([(1, 3, "c" * 50), (1, 1, "a</Reference>"), (1, 2, "b" * 30), (2, 1, "x" * 99), (3, 5, None)], "query_id long, rank long, text string")
    got = {r.query_id: (r.context, r.refs, r.dropped) for r in ev.reference_context(hits, 60).collect()}
    assert got == {1: ("[1] a＜/reference＞\n[2] " + "b" * 30, [1, 2], 1), 2: ("[1] " + "x" * 99, [1], 0), 3: ("[1] ", [1], 0)}


def test_log_rows_and_appended_exchanges(spark):
    schema = "conversation_id long, question string, rewritten_question string, rewrite_status_key string, rewrite_ms long, top1_score double, score_threshold double, status_key string, llm_called boolean, uncited boolean, embedding_model string, provider string, model string, input_tokens long, output_tokens long, retrieval_ms long, reranked boolean, rerank_degraded boolean, rerank_ms long, llm_ms long, chunks array<long>, citations array<long>, invalid array<string>"
    a = spark.createDataFrame([(1, "q", None, "skipped", None, 0.123456, None, "answered", True, False, "m", "p", None, 5, 6, 7, False, False, None, 9, [1, 2], [1], None)], schema)
    row = ev.log_rows(a, "cli", F.lit("2024-01-02 03:04:05").cast("timestamp")).first()
    assert len(row) == 25 and str(row.top1_score) == "0.1235" and (row.passed_count, row.citation_count, row.invalid_ref_count, row.source_key) == (2, 1, 0, "cli")
    talks = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01")], "conversation_id long, updated_at string")
    said = spark.createDataFrame([(1, 0), (1, 1)], "conversation_id long, turn long")
    new = spark.createDataFrame([(1, 1, "q1", None, "skipped", "a1", "answered"), (1, 2, "q2", "r2", "rewritten", "a2", "interrupted"), (9, 1, "q", None, None, "a", None)], "conversation_id long, number long, question string, rewritten_question string, rewrite_status_key string, answer string, status_key string")
    rows, touched = ev.appended(said, talks, new, F.lit("2024-02-02"))
    assert [tuple(r)[:7] for r in rows.orderBy("turn").collect()] == [(1, 2, "user", "q1", None, "skipped", None), (1, 3, "assistant", "a1", None, None, "answered"), (1, 4, "user", "q2", "r2", "rewritten", None), (1, 5, "assistant", "a2", None, None, "interrupted")]
    assert values(touched, "conversation_id") == [(1, "2024-02-02"), (2, "2024-01-01")]


def test_uploads_are_judged_by_their_bytes(spark):
    rows = [("a.txt", b"%PDF-1.7 x"), ("a.pdf", b"%PDF-1.7 x"), ("b.txt", "中文".encode("cp950")), ("c.md", "中文".encode()), ("d.txt", b"PK\x03\x04zip"), ("e.txt", b"a\x00b"), ("f.txt", b"\xff\xff\xff"), ("g.txt", b""), ("h.txt", None), ("i.txt", "é中".encode() * 100_000)]
    got = ca.admitted(spark.createDataFrame([(n, "text/plain", 1, bytearray(c) if c is not None else None) for n, c in rows], "name string, mime_type string, size long, content binary"))
    assert [(r.name, r.refused) for r in got.collect()] == [("a.txt", "mime"), ("a.pdf", None), ("b.txt", None), ("c.md", None), ("d.txt", "mime"), ("e.txt", "mime"), ("f.txt", "mime"), ("g.txt", None), ("h.txt", "mime"), ("i.txt", None)]
    assert spark.range(1).select(ca.owns("rag", F.lit("rag_bge")), ca.owns("rag", F.lit("ragged"))).first() == (True, False)


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = [json.dumps({"id": f"q{i}", "question": "x" * (i % 90)}) if i % 97 else ("" if i % 2 else "{broken") for i in range(1, 3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('{"id": "ok"}\n{"id": "c", "history": [{"question": 1')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = fl.numbered_lines(spark, str(tmp_path / "a.jsonl"))
        assert got.select(F.spark_partition_id()).distinct().count() >= 1 and [r.text for r in got.orderBy("line").collect()] == lines
        assert [r.line for r in got.orderBy("line").collect()] == list(range(1, 3000))
        bad = fl.json_line_errors(spark, str(tmp_path), QUESTION)
        assert sorted((r.path[-7:], r.line) for r in bad.collect()) == sorted([("a.jsonl", i) for i in range(1, 3000) if i % 194 == 0] + [("b.jsonl", 2)])
        assert [(r.path[-7:], r.line) for r in fl.json_line_errors(spark, str(tmp_path / "b.jsonl"), CONVERSATION).collect()] == [("b.jsonl", 2)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "c.jsonl").write_text('{"id": "c", "history": [{"question": "q", "answer": "a"}], "question": "and?"}\n')
    assert conversation_set(spark, str(tmp_path / "c.jsonl")).first().history[0].answer == "a"


def test_counts_fail_where_they_must(spark):
    d = spark.createDataFrame([('{"n": -1}',)], "t string")
    assert d.select(aw.json_count(F.col("t"), "n")).first()[0] is None
    with pytest.raises(Exception, match="invalid token count n"):
        d.select(aw.json_count(F.col("t"), "n", strict=True)).collect()


def test_chunks_from_sql(spark):
    rows = [(1, 2, "Article text. " * 90), (1, 1, ""), (1, 3, "第一條 目的\n" + "規定。" * 200), (2, 1, None), (3, 1, "short")]
    pages = spark.createDataFrame(rows, "doc_id long, page long, text string")
    pages.createOrReplaceTempView("some_pages")
    pl.register_chunker(spark)
    got = spark.sql("SELECT * FROM chunk(TABLE(some_pages) PARTITION BY doc_id ORDER BY page)")
    want = ck.chunk_documents(ck.assembled(pages))
    assert values(got, "doc_id", "chunk_index") == values(want, "doc_id", "chunk_index") and got.count() > 3


def test_models_may_fail(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in texts][: 1 if any("few" in t for t in texts) else None]

    d = spark.createDataFrame([(1, "ab"), (2, " "), (3, None), (4, "bad"), (5, "few"), (6, "few too")], "id long, text string").coalesce(1)
    got = {r.id: (r.vector, r.fault) for r in pl.embedded(d, embed, 2, "d: ", 1).collect()}
    assert got == {1: ([5.0, 1.0], None), 2: (None, "blank_text"), 3: (None, "blank_text"), 4: (None, "failed"), 5: ([6.0, 1.0], None), 6: ([10.0, 1.0], None)}
    assert Counter(r.fault for r in pl.embedded(d.filter("id > 4"), embed, 2).collect()) == {"wrong_count": 2}
    assert [r.fault for r in pl.embedded(d.filter("id = 1"), embed, 3).collect()] == ["wrong_size"]
    c = spark.createDataFrame([(1, "q", 1, "a", 1), (1, "q", 2, "abc", 2), (2, "fail", 3, "x", 2), (2, "fail", 4, "y", 1)], "query_id long, question string, id long, text string, rank long")
    got = pl.scored_candidates(c, lambda q, texts: [len(t) for t in texts] if q == "q" else [1.0])
    assert [(r.id, r.final_rank, r.degraded) for r in got.orderBy("query_id", "final_rank").collect()] == [(2, 1, False), (1, 2, False), (4, 1, True), (3, 2, True)]
