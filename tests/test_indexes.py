"""Exact terms, keyword postings and the vector index against plain searches, and versioned tables with several writers."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import postings
from lodestar.operators import retrieval as rt
from lodestar.operators import retrieve as rv
from lodestar.operators.postings import KeywordIndex, keyword_hits
from lodestar.operators.terms import holding
from lodestar.operators.vectors import VectorIndex
from lodestar.sources.versioned import VersionedTable


def chunks(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def hits(df):
    return sorted((r.query_id, r.id, round(r.score, 4)) for r in df.collect())


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [rng.choice("aeioubcdst") + rng.choice("aeiou") + rng.choice("nrst中文") for _ in range(60)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 60])))) for i in range(n)]


def test_exact_terms_are_found_and_ranked(spark):
    rows = [(1, "Form HR-2026 and 第十二條 here"), (2, "hr2026"), (3, "the “red lamp” stands, hr2026, 第12條"), (4, None), (5, "red lamps"), (None, "hr2026"), (6, "第12條之1")]
    asked = spark.createDataFrame([(1, "What of HR-2026 and 第12條?"), (2, '“red lamp”'), (3, "no terms"), (4, None), (5, "「a\\b」「 中」")], "query_id long, text string")
    got = [(r.query_id, r.id, r.score, r["rank"]) for r in rt.exact_search(asked, chunks(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2.0, 1), (1, 3, 2.0, 2), (1, 2, 1.0, 3), (1, 6, 1.0, 4), (2, 3, 1.0, 1), (2, 5, 1.0, 2)]
    assert [(r.query_id, r.id) for r in rt.exact_search(asked, chunks(spark, rows), 1).orderBy("query_id").collect()] == [(1, 1), (2, 3)]


def test_terms_in_many_batches_and_the_cut(spark):
    rows = texts(300)
    terms = [(q, [w for w in rows[q * 7][1].split()[:3]] + ["", "absent"]) for q in range(30)]
    asked = spark.createDataFrame(terms, "query_id long, terms array<string>")
    want = sorted((q, i, float(sum(t in x for t in set(own) - {""}))) for q, own in terms for i, x in rows if any(t in x for t in set(own) - {""}))
    for how in ({}, {"chars": 20}, {"pairs": 2}):
        assert hits(holding(asked, chunks(spark, rows), **how)) == want
    cut = rt.ranked(holding(asked, chunks(spark, rows), 4), 4)
    assert [(r.query_id, r.id) for r in cut.orderBy("query_id", "rank").collect()] == [(q, i) for q in range(30) for _, i in sorted((-n, i) for p, i, n in want if p == q)[:4]]


def plain_keyword(asked, rows, k):
    pairs = lambda t: Counter(t[i : i + 2] for i in range(len(t) - 1))
    tf = {i: pairs(t) for i, t in rows if t is not None and i is not None}
    df = Counter(p for c in tf.values() for p in c)
    n, out = len(rows), []
    for q, t in asked:
        score = {i: round(sum(c[p] * math.log(1 + n / df[p]) for p in pairs(t) if p in df), 9) for i, c in tf.items()}
        out += [(q, i, round(s, 4)) for i, s in sorted(((i, s) for i, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k]]
    return sorted(out)


def normal(rows):
    return [(i, t.replace(" 中", "中").replace(" 文", "文").replace("中 ", "中").replace("文 ", "文")) for i, t in rows]


def test_keyword_hits_and_index_are_the_plain_search(spark, tmp_path):
    rows = texts(700)
    asked = [(q, rows[q * 31][1]) for q in range(20)] + [(90, "x"), (91, "qqqqzz")]
    questions = spark.createDataFrame([*asked, (92, None), (93, "")], "query_id long, text string")
    want = plain_keyword(normal(asked), normal(rows), 5)
    for size in (7, 1000):
        assert hits(rt.ranked(keyword_hits(questions, chunks(spark, rows), 5, size), 5)) == want
    index = KeywordIndex(spark, str(tmp_path / "index"))
    assert index.search(questions).count() == 0
    index.add(chunks(spark, rows[:400]), 1)
    index.add(chunks(spark, rows[350:]), 2)
    index.add(chunks(spark, rows[350:]), 2)
    assert hits(rt.ranked(index.search(questions, 5), 5)) == want
    index.delete(spark.createDataFrame([(i,) for i in range(0, 700, 3)], "id long"), 3)
    index.add(chunks(spark, [(1, "a new text altogether"), (5, None)]), 4)
    index.add(chunks(spark, rows[350:]), 2)  # a replay undoes nothing
    left = [(i, "a new text altogether" if i == 1 else t) for i, t in rows if i % 3 and i != 5]
    assert hits(rt.ranked(index.search(questions, 5), 5)) == plain_keyword(normal(asked), normal(left), 5)


def test_index_reads_the_buckets_of_its_questions(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"))
    index.add(chunks(spark, texts(50)), 1)
    plan = index.blocks([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket ").replace("[bucket ", "[bucket") or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def vectors(n, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    out = [(i, i // 3, [x + rng.gauss(0, 0.15) for x in rng.choice(centres)], "m:latest" if i % 5 else "other") for i in range(n)]
    return [*out, (9001, 900, [0.0] * 6, "m"), (9002, 900, None, "m"), (9003, 901, [1.0, 2.0], "m")]


POINT = "id long, document_id long, vector array<double>, model string"


@pytest.mark.parametrize("threshold", [None, 0.97])
def test_vector_index_is_the_exhaustive_search(spark, tmp_path, threshold):
    rows = vectors(900)
    points = spark.createDataFrame(rows, POINT)
    asked = spark.createDataFrame([(i, rows[i * 11][2], "m" if i % 2 else "other") for i in range(12)] + [(50, [0.0] * 6, "m"), (51, None, "m"), (52, [1.0] * 6, "none")], "query_id long, vector array<double>, model string")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(points.filter("id < 600 OR id > 9000"), 1, cell=25)
    index.upsert(points.filter("document_id >= 190"), 2)
    index.purge(spark.createDataFrame([(7,), (8,)], "document_id long"), 3)
    index.optimize()
    stats = {}
    got = index.search(asked, 4, threshold, stats)
    live = points.filter("document_id NOT IN (7, 8)").withColumn("model", F.regexp_replace("model", ":latest", ""))
    want = rt.dense(asked, live, 4, threshold, exclude_self=False)
    key = lambda df: [(r.query_id, r.id, r["rank"]) for r in df.orderBy("query_id", "rank").collect()]
    assert key(got) == key(want) and got.count() > 5
    index.search(asked.filter("query_id = 1"), 4, threshold, stats)
    assert 0 < stats["m"][0] < stats["m"][1]
    plan = index.read("m", [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "model#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_dense_meets_each_length_and_model(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0, 0.0], "a"), (3, [0.0, 1.0, 0.0], "a"), (4, [1.0, 1.0, 0.0], "b")], "id long, vector array<double>, model string").coalesce(1)
    asked = spark.createDataFrame([(10, [1.0, 0.0], "a"), (11, [1.0, 0.0, 0.0], "a"), (12, [1.0, 0.0, 0.0], "b")], "query_id long, vector array<double>, model string")
    assert [(r.query_id, r.id) for r in rt.dense(asked, points, 1).orderBy("query_id").collect()] == [(10, 1), (11, 2), (12, 4)]
    assert {r.id for r in rt.dense(asked.drop("model"), points, 5).filter("query_id = 12").collect()} == {2, 3, 4}


def test_commits_keep_their_place(spark, tmp_path):
    row = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    read = lambda t: sorted((r.k, r.v) for r in t.read().collect())
    t = VersionedTable(spark, str(tmp_path / "t"), "k", "k long, v string")
    t.replace(row((1, "a"), (2, "b")), 1)
    t.delete(row((2, None)), 1)
    assert read(t) == [(1, "a")]
    t.replace(row((3, "c")), 1, writer="stream")
    t.replace(row((1, "a"), (2, "b")), 1)
    assert read(t) == [(1, "a"), (3, "c")]
    t.compact()
    t.compact()
    assert read(t) == [(1, "a"), (3, "c")]
    t.replace(row((1, "a"), (2, "b")), 1)
    assert read(t) == [(1, "a"), (3, "c")]
    t.replace(row((3, "d"), (4, "e")), 2, writer="stream")
    assert read(t) == [(1, "a"), (3, "d"), (4, "e")]


def test_retrieve_gate_live_documents_and_models(spark):
    docs = spark.createDataFrame([(1, "indexed"), (2, "failed"), (3, "indexed")], "document_id long, status_key string")
    pieces = spark.createDataFrame([(1, 1, "alpha beta hr2026"), (2, 2, "alpha hr2026"), (3, 3, "gamma delta"), (4, 3, "alpha gamma")], "id long, document_id long, text string")
    points = spark.createDataFrame([(1, [1.0, 0.1], "m"), (2, [1.0, 0.0], "m"), (3, [0.0, 1.0], "m"), (4, [0.6, 0.8], "m:latest")], "id long, vector array<double>, model string")
    asked = spark.createDataFrame([(1, "alpha hr-2026", [1.0, 0.0], "m:latest"), (2, "alpha", [-1.0, 0.0], "m"), (3, None, [0.0, 1.0], "m")], "query_id long, text string, vector array<double>, model string")

    def run(**o):
        got = rv.retrieve(asked, pieces, docs, points, rv.Options(**o))
        return [(r.query_id, r.id, r.final_rank) for r in got.rows.orderBy("query_id", "final_rank").collect()], {r.query_id: (r.gated, r.dense_top_score) for r in got.report.collect()}

    rows, report = run(thresholds={"m": 0.5})
    assert rows == [(1, 1, 1), (1, 4, 2), (3, 3, 1), (3, 4, 2)]
    assert report == {1: (False, 1.0), 2: (True, 0.0), 3: (False, 1.0)}
    assert run(thresholds={"m": 0.5}, mode="dense", top_k=1)[0] == [(3, 3, 1)]  # the one that was taken for question 1 is not indexed
    assert run(thresholds={"m": 0.5}, mode="dense", top_k=2)[0] == [(1, 1, 1), (3, 3, 1), (3, 4, 2)]
    assert run(mode="keyword", policy="allow", thresholds={})[0][-2:] == [(2, 1, 1), (2, 4, 2)]
    assert run(mode="keyword", thresholds={})[0] == [(1, 1, 1)]
    assert run(thresholds={"m": 0.5}, rerank=True, rerank_candidates=1, top_k=2)[0] == [(1, 1, 1), (1, 4, 2), (3, 3, 1), (3, 4, 2)]
    with pytest.raises(Exception, match="no threshold for model m"):
        run(thresholds={"x": 0.5})


def test_dense_search_holds_a_slice_of_the_scores():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(8000, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(8000)), pa.array(vectors.tolist())], ["id", "vector"])
    groups = rt._groups([{"query_id": i, "vector": v.tolist()} for i, v in enumerate(vectors[:3000])])
    tracemalloc.start()
    got = [(q, i, s) for b in rt._searched(batch, groups, 3, None, True, False) for q, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all scores would be 192 MB
    unit = vectors / np.sqrt((vectors**2).sum(1, keepdims=True))
    for q in (0, 1, 1500, 2999):
        score = np.round(unit @ unit[q], 12)
        score[q] = -np.inf
        assert sorted(i for own, i, _ in got if own == q) == sorted(np.argsort(-score)[:3].tolist())
    assert len(got) == 9000


def test_blocks_of_long_texts_hold_fewer(monkeypatch):
    monkeypatch.setattr(postings, "CHARS", 1000)
    sizes = [5000, 900, 900, 400, 400, 400, *[3] * 700, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(["中" * n for n in sizes])], ["id", "t"])
    parts = [p.column(0).to_pylist() for p in postings._parts(batch)]
    assert [i for p in parts for i in p] == list(range(len(sizes)))
    assert all(len(p) == 1 or len(p) <= postings.BLOCK and sum(sizes[i] for i in p) <= 1000 for p in parts)
    assert [len(p) for p in parts] == [1, 1, 1, 2, 201, 256, 245]
