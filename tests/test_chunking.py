"""Goldens with one character as one token, and a splitter that prices every range anew."""

import math
import random

import pytest

from lodestar.operators import chunking as ch

TWENTY = ch.Budget(20, 0.3, 3, 1.0, 1.0)


def split(text, budget=TWENTY):
    packer = ch.Packer(text, budget)
    return [text[a:b].rstrip() for a, b in packer.merged_tail(packer.pack(0, len(text)))]


def test_packing_goldens():
    a, b, c = "甲甲甲甲甲甲甲甲。", "乙乙乙乙乙乙乙乙。", "丙丙丙丙丙丙丙丙。"
    assert split("短短一句話。") == ["短短一句話。"]
    assert split(f"{a}\n\n{b}\n\n{c}") == [a, f"{b}\n\n{c}"]
    assert split("甲甲甲甲。乙乙乙乙。丙丙丙丙。丁丁丁丁。戊戊戊戊。") == ["甲甲甲甲。乙乙乙乙。丙丙丙丙。丁丁丁丁。", "丁丁丁丁。戊戊戊戊。"]
    assert split("甲甲。乙乙乙乙乙乙乙。丙丙丙丙丙丙丙丙丙。", ch.Budget(12, 0.5, 3, 1.0, 1.0)) == ["甲甲。乙乙乙乙乙乙乙。", "丙丙丙丙丙丙丙丙丙。"]
    assert split("第四條\n\n" + "甲乙丙丁戊。" * 6)[0].startswith("第四條\n\n甲乙丙丁戊。")
    assert split("第四條\n\n甲乙丙丁戊己。庚辛壬癸子丑。寅卯辰巳午。", ch.Budget(20, 0.3, 8, 1.0, 1.0))[0].startswith("第四條\n\n甲乙丙丁戊己。")
    tail = split(f"{a}{b}{c}丁。")
    assert tail[-1].endswith("丁。") and "|".join(tail).count("丁") == 1
    assert all(len(x) <= 20 for x in split("甲乙丙丁戊己庚。" * 10 + "\n\n" + "一二三四五六七八九十" * 5))
    packer = ch.Packer("一二三四五六七八九十" * 3, ch.Budget(10, 5.0, 0, 1.0, 1.0))
    starts = [s for s, _ in packer.hard(0, 30)]
    assert starts == sorted(set(starts)) and ch.Packer("甲甲甲甲。" * 5, TWENTY).hard(0, 25)[0] == (0, 20)


def naive_hard(text, budget, overlap):
    price = lambda a, b: math.ceil(sum(budget.wide if ch._WIDE.match(x) else budget.other for x in text[a:b]) - 1e-9)
    out, a = [], 0
    while a < len(text):
        b = a + 1
        while b < len(text) and price(a, b + 1) <= budget.most:
            b += 1
        out.append((a, b))
        if b == len(text):
            break
        n = b
        while n - 1 > a + 1 and price(n - 1, b) <= overlap:
            n -= 1
        a = n
    return out


def test_hard_windows_match_the_naive_ones():
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice("ab 中，x") for _ in range(rng.randint(1, 90)))
        budget = ch.Budget(rng.randint(1, 12), 0.25, 2, 1.0, 0.5)
        overlap = rng.randint(0, 6)
        assert ch.Packer(text, budget, overlap).hard(0, len(text)) == naive_hard(text, budget, overlap)


def test_chunks_cover_the_text():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "句子。", "\n", "\n\n", "end! ", "x" * 9, "# Head\n", "第一條\n"]) for _ in range(rng.randint(0, 60)))
        for strategy in ("structure", "recursive", "fixed"):
            spans = ch.chunk_spans(text, strategy, TWENTY)
            packer = ch.Packer(text, TWENTY)
            assert all(packer.cost(a, b) <= 20 for a, b, _ in spans)
            covered = {i for a, b, _ in spans for i in range(a, b)}
            assert strategy == "structure" or all(i in covered or text[i] in ch.BLANK for i in range(len(text)))


def parts(text):
    return [(text[a:b], section) for a, b, section in ch.segments(text)]


@pytest.mark.parametrize("heading", ["第十二條", "第 12 條", "第12條", "第十二條之一", "第12條之1"])
def test_articles(heading):
    assert parts(f"前言\n{heading}\n內容") == [("前言", None), (f"{heading}\n內容", heading)]


def test_segments():
    for text in ("第一條\n依第三條規定辦理。", "第一條\n其計算依\n第三條規定辦理。", "第一條\n第三條之規定不適用之。", "第一條\n第三條之一規定辦理。", "# 範例\n```\n# 這是註解\n```"):
        assert len(parts(text)) == 1
    assert parts("第二章　請假\n第三條\n事假內容\n第三條之一\n家庭照顧假內容") == [("第三條\n事假內容", "第二章 請假 / 第三條"), ("第三條之一\n家庭照顧假內容", "第二章 請假 / 第三條之一")]
    assert parts("第一章 總則\n第一條\n內容\n第 3 章 附則\n附則前言")[1][1] == "第 3 章 附則"
    assert parts("第五條 請假程序\n內容")[0][1] == "第五條 請假程序"
    assert parts("第五條 員工應事先以系統提出申請。\n內容")[0][1] == "第五條"
    assert len(parts("第一條\n甲\n第二條\n乙\n第三條\n丙")) == 3
    assert [s for _, s in parts("# 手冊\n說明\n## 報到\n### 第一天\n內容\n## 設備\n內容")] == ["手冊", "手冊 / 報到 / 第一天", "手冊 / 設備"]
    assert parts("第一段。\n\n第二段。") == [("第一段。\n\n第二段。", None)] and parts("") == []


def test_chunk_documents(spark):
    rows = [(1, 2, "b" * 30), (1, 1, ""), (1, 3, None), (1, 4, "第一條\nc"), (2, 1, None), (None, 1, "x")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    joined = {r.doc_id: r for r in ch.assembled(pages).collect()}
    assert joined[1].text == "b" * 30 + "\n\n第一條\nc" and [tuple(p) for p in joined[1].pages] == [(2, 0), (4, 32)] and joined[2].text == ""
    got = ch.chunk_documents(ch.assembled(pages), budget=ch.Budget(600, 0.15, 2)).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page_start, r.page_end, r.section, r.token_count) for r in got] == [(0, 2, 2, None, 9), (1, 4, 4, "第一條", 4)]
    assert got[0].chunk_strategy == "structure_v2:max600:ov15"
    assert ch.chunk_documents(ch.assembled(pages.limit(0))).count() == 0


def test_pages_of_rows(spark):
    rng = random.Random(3)
    pages = [(d, i + 1, s) for d in (1, 2, 3) for i, s in enumerate(sorted(rng.sample(range(5, 3000), 12)))]
    offsets = [(d, rng.randrange(0, 3500), i) for i, d in enumerate([1, 2, 3, 4, None] * 30)]
    p = spark.createDataFrame(pages, "doc_id long, page int, start long")
    o = spark.createDataFrame(offsets, "doc_id long, at long, k int")
    for span in (64, 1 << 20):
        got = {r.k: r.page for r in ch.pages_at(o, p, span).collect()}
        for d, at, k in offsets:
            own = [(s, n) for e, n, s in pages if e == d]
            want = max([x for x in own if x[0] <= at], default=min(own, default=(0, 1)))[1]
            assert got[k] == want
        assert len(got) == len(offsets)
