"""Streams against the batch operators, in any order of arrival and after restarts."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import analytics as an
from lodestar.streaming import chain as ch
from lodestar.streaming import twins as tw
from lodestar.streaming.conversations import last_final, run_windows, turns_of, window_of, window_table

MESSAGES = "conv_id long, turn long, role string, text string, status string, created_at string"


def messages(seed, n=30):
    rng, out = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 2, 7, 16, 30])):
            role = "user" if t % 2 == 0 else "assistant"
            role = rng.choice([role, role, role, "user", "assistant", "system"])
            status = "interrupted" if role == "assistant" and rng.random() < 0.2 else None
            out.append((c, t, role, None if rng.random() < 0.05 else f"{role} {c} {t} " + "x" * rng.choice([3, 30, 100, 400, 2000]), status, f"2024-01-01 {t // 6:02d}:{t % 6}0:00"))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, MESSAGES).withColumn("created_at", F.to_timestamp("created_at"))


def test_windows_follow_the_batch_operator_in_any_order_and_after_a_restart(spark, tmp_path):
    rows = messages(4)
    order = rows[:]
    random.Random(1).shuffle(order)
    source, target, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")

    def run(some):
        frame(spark, some).coalesce(1).write.mode("append").parquet(source)
        run_windows(spark, source, target, at, files=1, delay="30 days").awaitTermination()

    third = len(order) // 3
    for part in (order[:third], order[third : 2 * third], order[2 * third :] + order[:5]):
        run(part)
    got = {(r.conv_id, r.turn, r.back, r.question, r.answer) for r in window_table(spark, target).read().collect()}
    batch = an.history_window(frame(spark, rows).fillna({"text": ""}))
    want = {(r.conv_id, r.turn, r.back, r.question, r.answer) for r in batch.collect()}
    assert got == want and len(want) > 20


def test_unanswered_questions_are_told_once(spark, tmp_path):
    source, target, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")

    def run(*rows):
        frame(spark, list(rows)).coalesce(1).write.mode("append").parquet(source)
        run_windows(spark, source, target, at, delay="0 seconds", patience=60_000).awaitTermination()

    run((1, 0, "user", "first?", None, "2024-01-01 00:00:00"), (2, 0, "user", "second?", None, "2024-01-01 00:00:00"), (2, 1, "assistant", "yes.", None, "2024-01-01 00:00:10"))
    run((3, 0, "user", "later?", None, "2024-01-01 01:00:00"))
    run((3, 1, "assistant", "late.", None, "2024-01-01 01:00:30"), (4, 0, "user", "x", None, "2024-01-01 03:00:00"))
    told = sorted((r.conv_id, r.turn, r.question) for r in spark.read.parquet(f"{target}/unanswered").collect())
    assert told == [(1, 0, "first?")]


def test_state_forgets_what_no_window_needs():
    many = [(t, "user" if t % 2 == 0 else "assistant", f"{t}", None, t) for t in range(100)]
    assert [m[0] for m in last_final(many, 3, 90)] == list(range(84, 100))
    assert last_final(many, 3, 0) == many
    assert window_of(last_final(many, 3, 90), 3, 1500) == window_of(many, 3, 1500)
    assert [t for _, t, _, _ in turns_of([(0, "user", "a", None, 0), (1, "assistant", "b", "interrupted", 1), (2, "user", "c", None, 2), (3, "assistant", "d", None, 3), (4, "assistant", "e", None, 4)])] == [2]


def uploads(spark, rows):
    return spark.createDataFrame(rows, ch.UPLOAD)


TEXT = "第一條 目的\n" + "規定內容。" * 60 + "\f" + "Article text that is long enough. " * 80
FILES = [(1, "a.txt", TEXT.encode()), (2, "b.txt", ("中文內容。" * 300).encode("cp950")), (3, "c.txt", b"\xff\xfe\xff" * 9), (4, "d.txt", b"ab\fc"), (5, "e.txt", b""), (6, "f.txt", TEXT.encode() * 2)]


def tables(chain):
    out = [sorted(map(str, chain.table(s.name).read().collect())) for s in chain.stages]
    return [*out, sorted((r.document_id, r.status_key, r.error) for r in chain.status.read().collect())]


def test_a_chain_that_dies_in_the_middle_ends_with_the_same_tables(spark, tmp_path):
    whole = ch.Chain(spark, str(tmp_path / "whole"))
    whole.upload(uploads(spark, FILES), 1)
    whole.run_all()
    want = tables(whole)
    assert want[-1] == [(1, "indexed", None), (2, "indexed", None), (3, "failed", "encoding"), (4, "failed", "scanned"), (5, "failed", "scanned"), (6, "indexed", None)]
    assert all(want[:3]) and "search_text" in want[1][0]
    deaths = ["before", "after"]

    def dying(chain, ids):
        rows, errors = ch.chunks(chain, ids)
        if deaths and deaths[0] == "before":
            deaths.pop(0)
            raise RuntimeError("killed")
        return rows, errors

    class Dying(ch.Chain):
        def _put(self, stage, name, ids):
            if stage == "index" and deaths:  # the chunks are written, the next inbox is not
                deaths.pop(0)
                raise RuntimeError("killed")
            super()._put(stage, name, ids)

    chain = Dying(spark, str(tmp_path / "dying"), [ch.PARSE, ch.Stage("chunk", "chunked", ch.STORED_CHUNK, dying), ch.POINTS], files=2)
    chain.upload(uploads(spark, FILES[:3]), 1)
    for _ in range(2):
        chain.upload(uploads(spark, FILES[3:]), 2)
    chain.run("parse")
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            chain.run("chunk")
    chain.run("chunk")
    chain.run("index")
    assert not deaths and tables(chain) == want
    chain.upload(uploads(spark, [(1, "a.txt", b"A text of its own, new and long enough.")]), 3)
    chain.run_all()
    assert [r.content for r in chain.table("chunk").read().filter("document_id = 1").collect()] == ["A text of its own, new and long enough."]


def test_retries_are_limited_and_errors_that_pass_pass(spark, tmp_path):
    tried = []

    def flaky(chain, ids):
        rows = ids.select("document_id", F.lit(1).cast("long").alias("page"), F.lit("x").alias("text"))
        tried.append(sorted((r.document_id, r.attempt) for r in ids.collect()))
        bad = ids.filter("document_id = 1 OR document_id = 2 AND attempt < 3").select("document_id", F.lit("busy").alias("error"), F.lit(False).alias("permanent"))
        return rows, bad

    chain = ch.Chain(spark, str(tmp_path / "c"), [ch.Stage("parse", "parsed", ch.PAGE, flaky)])
    chain.upload(uploads(spark, [(i, "n", b"x") for i in (1, 2, 3)]), 1)
    chain.run("parse")
    assert tried == [[(1, 1), (2, 1), (3, 1)], [(1, 2), (2, 2)], [(1, 3), (2, 3)]]
    assert sorted((r.document_id, r.status_key, r.attempt, r.error) for r in chain.status.read().collect()) == [(1, "failed", 3, "busy"), (2, "parsed", 3, None), (3, "parsed", 1, None)]


def test_twins_are_found_late_and_forgotten(spark, tmp_path):
    source, target, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    schema = "document_id long, sha256 string, created_at string"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).withColumn("created_at", F.to_timestamp("created_at")).coalesce(1).write.mode("append").parquet(source)
        tw.run_twins(spark, source, target, at, expiry=3_600_000, delay="0 seconds").awaitTermination()
        return sorted((r.document_id, r.first_id, r.n) for r in tw.twin_table(spark, target).read().collect())

    assert run((5, "a", "2024-01-01 00:00:00"), (6, "b", "2024-01-01 00:00:00"), (6, "b", "2024-01-01 00:00:00")) == [(5, 5, 1), (6, 6, 1)]
    assert run((4, "a", "2024-01-01 00:30:00"), (5, "a", "2024-01-01 00:31:00")) == [(4, 4, 2), (5, 5, 1), (6, 6, 1)]
    run((7, "c", "2024-01-01 09:00:00"))
    assert (8, 8, 1) in run((8, "a", "2024-01-01 09:10:00"))
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, None)], "document_id long, sha256 string")
    asked = spark.createDataFrame([(2,), (4,), (5,)], "document_id long")
    assert sorted(map(tuple, tw.twins_of(asked, docs).collect())) == [(2, 1), (2, 3)]
