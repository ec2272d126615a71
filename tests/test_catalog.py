"""Catalog, sinks, sources and incremental ingest on small tables."""

import zlib
from math import sin

import pytest
from pyspark.sql import functions as F

from lodestar.operators import catalog as ca
from lodestar.sources import files as fl
from lodestar.sources import versioned as vs
from lodestar.streaming.ingest import chunk_table, ingest_chunks


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_models_and_thresholds(spark):
    m = spark.createDataFrame([("bge-m3:latest",), ("Qwen3-Embedding:0.6b",)], "m string")
    assert [r[0] for r in m.select(ca.collection_name("rag", F.col("m"))).collect()] == ["rag_bge_m3", "rag_qwen3_embedding_0_6b"]
    hits = spark.createDataFrame([(1, 1, "a:latest", 0.5), (1, 2, "a", 0.6), (1, 3, "b", 0.45)], "query_id long, id long, model string, score double")
    t = spark.createDataFrame([("a", 0.5), ("b", 0.4)], "model string, threshold double")
    assert [(r.id, r["rank"]) for r in ca.above_model_threshold(hits, t, 5).orderBy("rank").collect()] == [(2, 1), (3, 2)]
    with pytest.raises(Exception, match="no threshold for model"):
        ca.above_model_threshold(hits, t.limit(1), 5).collect()


def test_eligibility_and_listing(spark):
    docs = spark.createDataFrame([(i, "indexed" if i % 2 else "failed") for i in range(1, 7)], "document_id long, status_key string")
    chunks = spark.createDataFrame([(10 + i, i) for i in (1, 1, 2, 3, 9)], "id long, document_id long")
    assert values(ca.eligible(chunks, docs).select("document_id"), "document_id") == [(1,), (1,), (3,)]
    assert ca.with_documents(chunks, docs).count() == 3 and ca.having_chunks(docs, chunks).count() == 3
    assert [tuple(r)[::2] for r in ca.listing(docs, chunks, 2, 3).collect()] == [(3, 1), (2, 1), (1, 2)]
    hits = spark.createDataFrame([(1, 11, 1), (1, 99, 2), (1, 13, 3)], "query_id long, id long, rank long")
    assert values(ca.first_live(hits, chunks, 2).select("id", "retrieval_rank"), "retrieval_rank") == [(11, 1), (13, 2)]
    assert values(ca.head_and_tail(hits.filter("rank = 2"), hits, 2, 5).select("id", "rank"), "rank") == [(99, 1), (13, 2)]


def test_states(spark):
    docs = spark.createDataFrame([(1, "uploaded"), (2, "parsed"), (3, "parsing")], "document_id long, status_key string")
    asked = spark.createDataFrame([(1, "uploaded", "parsing"), (2, "uploaded", "parsing"), (3, "parsing", "indexed")], "document_id long, from_key string, to_key string")
    assert values(ca.moved(docs, asked), "document_id") == [(1, "parsing"), (2, "parsed"), (3, "parsing")]


def test_uploads(spark):
    rows = [("a.pdf", "application/pdf", 1), ("a.exe", "application/pdf", 1), ("a.txt", "application/pdf", 1), ("A.MD", "text/plain", 8192 * 1024 + 1), ("noext", "text/plain", 1), (None, None, None)]
    got = ca.admitted(spark.createDataFrame(rows, "name string, mime_type string, size long")).withColumn("parser", ca.parser_for(F.col("mime_type"), F.col("name")))
    assert [(r.refused, r.parser) for r in got.collect()] == [(None, "pdf"), ("extension", "pdf"), ("mime", "pdf"), ("size", "markdown"), ("extension", "text"), ("extension", None)]
    kept = vs.stored_uploads(spark.createDataFrame([("a", bytearray(b"xy"))], "name string, content binary"), "2024-03-05").first()
    assert kept.path.startswith("documents/2024/03/") and kept.size == 2 and kept.status_key == "uploaded"


def test_embeddings(spark):
    got = spark.createDataFrame([("中",)], "t string").select(ca.fake_embedding(F.col("t"))).first()[0]
    want = [sin(zlib.crc32("中".encode()) + i) for i in range(8)]
    assert got == pytest.approx([x / sum(y * y for y in want) ** 0.5 for x in want])
    rows = [("a", [1.0]), ("  ", [1.0, 2.0]), ("b", None), ("c", [1.0, 2.0])]
    assert [r.fault for r in ca.checked_vectors(spark.createDataFrame(rows, "text string, vector array<double>"), 2).collect()] == ["wrong_size", "blank_text", "no_vector", None]


def test_document_context(spark):
    pages = spark.createDataFrame([(1, 2, "b</document>"), (1, 1, None)], "doc_id long, page int, text string")
    assert ca.document_context(pages).first().context == "【第 1 頁】\n\n\n【第 2 頁】\nb＜/document＞"


def test_versioned_tables(spark, tmp_path):
    t = vs.VersionedTable(spark, str(tmp_path / "t"), "k", "k long, v string")
    row = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert t.read().count() == 0
    t.replace(row((1, "a"), (1, "b"), (2, "c"), (None, "x")), 1)
    t.replace(row((1, "d")), 2)
    t.replace(row((1, "d")), 2)
    assert values(t.read(), "k", "v") == [(1, "d"), (2, "c")]
    t.replace(row(), 3, row((2, None)))
    assert values(t.read(), "k") == [(1, "d")]
    docs = spark.createDataFrame([(1, "indexed"), (2, "parsing")], "document_id long, status_key string")
    assert values(vs.cascade(docs, docs, [t], 4, ca.DELETABLE), "document_id") == [(2, "parsing")] and t.read().count() == 0
    vs.purge([t], row((1, None)), 5)
    log = spark.createDataFrame([("2024-01-01 10:00:00", 1), ("2024-01-02 10:00:00", 2)], "created_at string, n int").withColumn("created_at", F.to_timestamp("created_at"))
    for _ in range(2):
        vs.append_by_day(log, str(tmp_path / "log"), 1)
    vs.append_by_day(log, str(tmp_path / "log"), 2)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    pair = vs.exchange_rows(spark.createDataFrame([(1, 3, "q", "a")], "conversation_id long, turn long, question string, answer string"))
    assert values(pair, "turn") == [(1, 6, "user", "q"), (1, 7, "assistant", "a")]


def test_ingest(spark, tmp_path):
    schema, at = "doc_id long, text string, version long", str(tmp_path / "in")

    def run(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        ingest_chunks(spark, at, schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return values(chunk_table(spark, str(tmp_path / "out")).read().select("doc_id", "content"), "doc_id", "content")

    assert run((1, "old", 1), (1, "new", 2), (1, "older", 0), (2, "two", 1), (None, "x", 1)) == [(1, "new"), (2, "two")]
    assert run((2, None, 2), (3, "three", 1)) == [(1, "new"), (3, "three")]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhi")
    (tmp_path / "b.md").write_bytes("中".encode("cp950"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xff")
    (tmp_path / "d.bin").write_bytes(b"x")
    got = {r.path[-5:]: (r.text, r.preserves_layout, r.error) for r in fl.text_pages(spark, str(tmp_path)).collect()}
    assert got == {"a.txt"[-5:]: ("hi", False, None), "/b.md": ("中", True, None), "c.txt": (None, False, "encoding")}
    pages = fl.form_feed_pages(spark.createDataFrame([(1, "a\f\fb\f"), (2, "c")], "doc_id long, text string"))
    assert values(pages, "doc_id", "page") == [(1, 1, "a"), (1, 2, ""), (1, 3, "b"), (2, 1, "c")]
    (tmp_path / "q.jsonl").write_text('{"id": "a"}\n\n{bad\n')
    assert [(r.line, r.text) for r in fl.json_line_errors(spark, str(tmp_path / "q.jsonl"), "id STRING").collect()] == [(3, "{bad")]


def test_documents_as_a_source(spark, tmp_path):
    from lodestar.sources.documents import register_documents

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhi")
    (tmp_path / "b.md").write_bytes("中".encode("cp950"))
    (tmp_path / "sub" / "c.txt").write_bytes(b"\xff\xff")
    (tmp_path / "sub" / "d.pages").write_bytes(b"one\f\fthree\f")
    (tmp_path / "e.bin").write_bytes(b"x")
    (tmp_path / "f.txt").write_bytes(b"x" * 200)
    register_documents(spark)
    read = lambda **o: spark.read.format("lodestar_documents").options(**o).load(str(tmp_path))
    got = sorted((r.path.rpartition("/")[2], r.page, r.text, r.preserves_layout, r.error) for r in read(most=100).collect())
    assert got == [("a.txt", 1, "hi", False, None), ("b.md", 1, "中", True, None), ("c.txt", None, None, False, "encoding"), ("d.pages", 1, "one", False, None), ("d.pages", 2, "", False, None), ("d.pages", 3, "three", False, None), ("e.bin", None, None, None, "no parser"), ("f.txt", None, None, False, "size")]
    assert read(bytes=1).rdd.getNumPartitions() == 6 and read().rdd.getNumPartitions() == 1
    text = {(r.path.rpartition("/")[2], r.text) for r in read().filter("error IS NULL AND NOT path LIKE '%pages'").collect()}
    assert text == {(r.path.rpartition("/")[2], r.text) for r in fl.text_pages(spark, str(tmp_path)).filter("error IS NULL").collect()}
