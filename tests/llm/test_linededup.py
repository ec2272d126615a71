"""Line deduplication against a plain count, through the broadcast and through the join, with full and with roomy filters."""

import hashlib
import random

import pytest

from lodestar.llm import linededup

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, row string, digest string, gone int, n long"
COMMON = "a line that many documents share"


def rows():
    rng = random.Random(5)
    lines = [f"line number {i} of the pool, long enough" for i in range(40)]
    out = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.4 else f"own line {i} {j} that nobody else has" for j in range(rng.randrange(1, 12)))) for i in range(60)]
    out += [(100 + i, f"  {COMMON.upper() if i % 2 else COMMON}\t\n{COMMON}\r\nshort\nshort\n") for i in range(30)]
    out += [(200, None), (201, ""), (202, "\n\n"), (203, "é" * 19 + "\nx"), (204, "é" * 20), (205, "é" * 20), (206, "É" * 20), (207, " " + "é" * 20), (208, "x" * 19), (209, "x" * 19), (210, "x" * 19), (211, "\x1f" + "y" * 30), (212, "y" * 30)]
    out += [(300, "a row that is there three times"), (300, "a row that is there three times"), (300, "a row that is there three times")]
    out += [(None, "only rows without an id hold this one"), (None, "only rows without an id hold this one"), (None, f"only rows without an id hold this one\n{COMMON}"), (400, "z" * 200_000 + f"\n{COMMON}")]
    return out


def plain(data):
    def key(line):
        k = line.strip(WHITE)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    holders = {}
    for r, (doc_id, text) in enumerate(data):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append((doc_id is not None, doc_id or 0))
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for doc_id, text in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), (doc_id is not None, doc_id or 0)) == (doc_id is not None, doc_id or 0)]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"broadcast_keys": 0}, {"max_bits": 1 << 16}, {"broadcast_keys": 3, "max_bits": 1 << 11}])
def test_lines_go_as_in_a_plain_count(spark, monkeypatch, how):
    monkeypatch.setattr(linededup, "HOT", 40)
    data = rows()
    d = spark.createDataFrame([(i, t, "en", "r", "d", 1, 2) for i, t in data], SCHEMA).repartition(5)
    got = linededup.line_dedup(d, keep=("lang", "gone"), **how).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(data)
    assert all(r.lang == "en" and r.gone == 1 for r in got)
    assert sum(r.n_dropped for r in got) > 60


def test_only_suspects_are_sent(spark):
    d = spark.createDataFrame([(i, f"line {i} that no other document has\n{COMMON if i % 50 == 0 else i}") for i in range(400)], "doc_id long, text string").repartition(4)
    seen = linededup.twice_seen(d, "text", 1 << 16, 20)
    own = [linededup.line_digests([f"line {i} that no other document has".encode()], 20)[1][0] for i in range(400)]
    assert linededup._suspected(own, seen).sum() < 20
    assert linededup._suspected(linededup.line_digests([COMMON.encode()], 20)[1], seen).all()


def test_no_rows(spark):
    assert linededup.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
