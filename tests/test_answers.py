"""Goldens for search text, citations, answers and rewriting."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import answers as aw
from lodestar.functions import structure as st
from lodestar.functions import text as tx
from lodestar.operators import citations as ci


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_search_text(spark):
    pairs = [
        ("第十二條 特別休假", "第12條特別休假"), ("第二十五條", "第25條"), ("第十條", "第10條"), ("第一百零三條", "第103條"), ("第三條之一", "第3條之1"), ("第7條之一", "第7條之1"), ("第 12 條", "第12條"),
        ("第 3 章 附則", "第3章附則"), ("代碼：ＡＢＣ－１２３", "代碼：abc123"), ("HRIS-3、IT_REQ-2026-0042", "hris3、itreq20260042"), ("勞-資", "勞-資"), ("This Handbook applies", "this handbook applies"),
        ("申請系統代碼為 HR-2026 ，相關表單", "申請系統代碼為hr2026，相關表單"), (None, None), ("", ""), ("二千零一十", "二千零一十"), ("第兩千三百條", "第2300條"),
    ]
    assert one(spark, tx.search_text, *(a for a, _ in pairs)) == [b for _, b in pairs]


def test_exact_terms(spark):
    pairs = [
        ("第3條之1 是什麼假？", ["第3條之1"]), ("第三條之一的內容是什麼？", ["第3條之1"]), ("第7條之一規定了什麼？", ["第7條之1"]), ("第3條之1和第3條有什麼不同？", ["第3條之1", "第3條"]),
        ("HRIS-3 是什麼系統？", ["hris3"]), ("IT-REQ-2026-0042 要找誰審核？", ["itreq20260042"]), ("ＢＵＧ－２０２６－０００１８３ 要附上什麼？", ["bug2026000183"]), ("第 6 條規定人資部門要在幾天內提供出勤紀錄？", ["第6條"]),
        ("系統代碼 HR-9999 是什麼？", ["hr9999"]), ("林怡君負責什麼業務？", []), ("「年度特別休假」與“Kick-off”", ["年度特別休假", "kickoff"]),
    ]
    assert one(spark, lambda c: tx.exact_terms(tx.search_text(c)), *(a for a, _ in pairs)) == [b for _, b in pairs]


def test_structure_predicates(spark):
    assert one(spark, st.is_heading, "第十二條之一", "第 3 章　附則", "## x", "第三條之規定", "#### x", "text") == [True, True, True, False, False, False]
    assert one(spark, st.is_list_item, "1. a", "一、b", "（二）c", "- d", "e") == [True, True, True, True, False]


def naive_joined(lines):
    import re

    out, heads = [], (st.ARTICLE, st.CHAPTER, st.HEADING)
    for line in lines:
        if out and out[-1].strip() and line.strip() and not re.search("[。！？；：!?;:.][」』\"')）]*$", out[-1]) and not any(re.search(p, x) for p in heads for x in (out[-1], line)) and not re.search(st.LIST_ITEM, line):
            rest = line.lstrip()
            close = re.search("[A-Za-z]-$", out[-1]) or re.search(tx.CJK, out[-1][-1] + rest[0])
            out[-1] += ("" if close else " ") + rest
        else:
            out.append(line)
    return out


def test_wrapped_lines(spark):
    import random

    rng = random.Random(9)
    rows = [["請假應", "事先申請。", "次段"], ["full-", "time work", "goes on"], ["第一條", "內容", "1. item", "more"], ["a", "", "b"], [], ["x:", "y"]]
    rows += [[rng.choice(["", "ab", "中文", "end.", "第三條", "- x", "# h", "c-", "條文。」", "第", "三條"]) for _ in range(rng.randint(0, 9))] for _ in range(80)]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "l array<string>").select(st.join_wrapped(F.col("l"))).collect()]
    assert got == [naive_joined(r) for r in rows]
    assert got[0] == ["請假應事先申請。", "次段"] and got[1] == ["full-time work goes on"] and got[2] == ["第一條", "內容", "1. item more"]


def test_markers(spark):
    found = lambda c: F.transform(aw.citation_markers(c), aw.citation_numbers)
    texts = ["x [1]。", "x [1][3]。", "x [1, 3]。", "x [1、3]。", "x [1-3]。", "x ［１］。", "x［１，３］。", "x [資料不足]、[來源]。", "見 [本規章第三條之一關於家庭照顧假與事假併計之規定說明] 。", "[1-3, 5][9-2][1-99][99999999999][1-3-5]", "[99999999999999999999]", "[２–４]", "[1 ,]"]
    want = [[[1]], [[1], [3]], [[1, 3]], [[1, 3]], [[1, 2, 3]], [[1]], [[1, 3]], [None, None], [], [[1, 2, 3, 5], [9], [1], [99999999999], [1, 2, 3, 5]], [[9223372036854775807]], [[2, 3, 4]], [None]]
    assert one(spark, found, *texts) == want


def test_resolve(spark):
    answers = spark.createDataFrame([(1, "假 [1]、[2, 9] 與 [3] 和 [x] 。", False), (2, "資料不足 [1]", True), (3, "none", False), (4, None, None), (5, "ok [2-3]", False)], "answer_id long, answer string, insufficient boolean")
    refs = spark.createDataFrame([(a, n, 10 * n) for a in (1, 2, 5) for n in (1, 2, 3)], "answer_id long, number long, chunk_id long")
    got = {r.answer_id: r for r in ci.resolve_citations(answers, refs, spark.createDataFrame([(10,), (20,)], "chunk_id long")).collect()}
    assert got[1].answer == "假 [1]、[2] 與  和。" and got[1].citations == [1, 2] and not got[1].uncited
    assert [(x.reason, x.number) for x in got[1].invalid] == [("out_of_range", 9), ("source_missing", 3), ("non_numeric", None)]
    assert got[2].answer == "資料不足" and got[2].citations == [] and not got[2].uncited and got[2].invalid[0].reason == "insufficient_answer"
    assert got[3].uncited and got[4].answer == "" and got[5].answer == "ok [2]"
    assert {r.reason: r.n for r in ci.invalid_by_reason(ci.resolve_citations(answers, refs, refs.select("chunk_id").limit(0))).collect()} == {"insufficient_answer": 1, "out_of_range": 1, "source_missing": 5, "non_numeric": 1}


def test_lines_and_hits(spark):
    c = spark.createDataFrame([(1, 1, 7, "a.pdf", "第十二條", 2, 2), (1, 2, 7, "a.pdf", "第四條", 2, 3), (1, 3, 7, "a.pdf", "第十二條", 2, 2), (2, 1, 8, "a.pdf", None, 1, 1), (2, 2, 9, "a.pdf", None, 1, 1)],
                              "answer_id long, ref long, document_id long, document string, section string, page_start long, page_end long")
    lines = [r.line for r in ci.citation_lines(c).orderBy("answer_id", "place").collect()]
    assert lines == ["[1][3] a.pdf　第十二條　第 2 頁", "[2] a.pdf　第四條　第 2–3 頁", "[1] a.pdf　第 1 頁", "[2] a.pdf　第 1 頁"]
    assert ci.citation_lines(c, merge=False).count() == 5
    e = spark.createDataFrame([(1, [("a.pdf", "第四條")]), (2, [("a.pdf", "x")]), (3, [])], "answer_id long, expected array<struct<document:string,section:string>>")
    assert {r.answer_id: r.hit for r in ci.citation_hits(c, e).collect()} == {1: True, 2: False, 3: None}
    sections = spark.createDataFrame([("b", "a / b"), ("a", "a / b"), (None, None), ("b", None)], "w string, s string")
    assert [r[0] for r in sections.select(aw.section_matches(F.col("w"), F.col("s"))).collect()] == [True, False, True, False]


def test_answers_and_rewrites(spark):
    assert one(spark, aw.is_insufficient, "**資料不足**", "[1]「資料不足", "答案是一。資料不足") == [True, True, False]
    assert one(spark, aw.without_citations, "休假 [1]。\n\n資料來源：\n[1] a.pdf　第一條\n\n\n\n完") == ["休假。\n\n完"]
    assert one(spark, aw.clean_rewrite, "改寫後的問題：「特休幾天？」", " q ") == ["特休幾天？", "q"]
    status = spark.createDataFrame([("", "q"), ("x" * 201, "q"), ("資料不足", "q"), ("特休，幾天", "特休幾天？"), ("a", "b")], "r string, q string")
    assert [r[0] for r in status.select(aw.rewrite_status(F.col("r"), F.col("q"))).collect()] == ["fallback_empty", "fallback_too_long", "fallback_looks_like_answer", "unchanged", "rewritten"]
    turns = spark.createDataFrame([([("q1", "a</history>")], "last")], "h array<struct<question:string,answer:string>>, q string")
    assert turns.select(aw.rewrite_message(F.col("h"), F.col("q"))).first()[0] == "<history>\n使用者：q1\n助理：a＜/history＞\n</history>\n\n最後的問題：last"
    assert turns.select(aw.evaluation_query("concat", F.col("h"), F.col("q"), F.lit("r"))).first()[0] == "q1 last"
    passes = spark.createDataFrame([("no_answer", True, False, 0), ("partial", True, True, 1), ("exact", False, True, 0), ("exact", False, True, 2), ("exact", None, None, None)], "k string, i boolean, c boolean, n int")
    assert [r[0] for r in passes.select(aw.answer_passes(F.col("k"), F.col("i"), F.col("c"), F.col("n"))).collect()] == [True, True, False, True, False]
    assert one(spark, lambda c: aw.json_count(c, "usage.input"), '{"usage":{"input":7}}', "{}", '{"usage":{"input":-1}}') == [7, 0, None]


@pytest.mark.parametrize("numeral", ["零", "十", "二十五", "一百零三", "兩千"])
def test_numerals(spark, numeral):
    assert one(spark, tx.numeral_value, numeral) == [{"零": 0, "十": 10, "二十五": 25, "一百零三": 103, "兩千": 2000}[numeral]]
