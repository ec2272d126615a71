"""The manifest against a plain tree, with one level a step and with the whole tree in a step, broadcast and joined."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, n int, `hash` string, more int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, more=0):
    n = r["n_chars"] + more if r["n_chars"] is not None else None
    return h(*(field(x) for x in (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def climb(level, at):
    """(root, siblings with their sides) of a plain tree of pairs."""
    path = []
    while len(level) > 1:
        other = at ^ 1
        path.append((level[other], at % 2 == 1) if other < len(level) else (None, False))
        level, at = [h(*level[i : i + 2]) for i in range(0, len(level), 2)], at // 2
    return level[0], path


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    subroots = [climb([leaf(r) for r in groups[x]], 0)[0] for x in langs]
    out = []
    for i, lang in enumerate(langs):
        for j, r in enumerate(groups[lang]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            path = climb([leaf(x) for x in groups[lang]], j)[1] + climb(subroots, i)[1]
            root, now = climb(subroots, 0)[0], leaf(r, int(hit))
            for s, left in path:
                now = h(now) if s is None else h(s, now) if left else h(now, s)
            out.append((r["doc_id"], leaf(r), subroots[i], root, h(*(s for s, _ in path if s is not None)), now, now == root))
    return sorted(out, key=str)


def rows(n):
    out = [dict(doc_id=i * 3 % 97, text=f"text {i} ü\n中" * (i % 4), lang=("en", "de", None, "zz", "en")[i % 5], source=None if i % 6 == 0 else f"s{i % 3}", n_chars=None if i % 7 == 0 else i) for i in range(n)]
    return [*out, dict(doc_id=None, text=None, lang="en", source=None, n_chars=None), dict(doc_id=None, text="x", lang="fr", source="s", n_chars=1), *out[:2]]


def found(spark, data, **how):
    d = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "t", 1, 2, "h", 3) for r in data], SCHEMA)
    n = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = manifest.manifest(d, F.struct("doc_id", "source", "lang", n.alias("n_chars"), "text"), **how)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("n, how", [(40, {"levels": 1, "broadcast_nodes": 0}), (90, {"levels": 2}), (90, {})])
def test_manifest_is_the_plain_tree(spark, n, how):
    data = rows(n)
    got = found(spark, data, **how)
    assert got == plain(data)
    assert {r[-1] for r in got} == {True, False}
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_one_leaf_and_none(spark):
    one = [dict(doc_id=1, text="only", lang=None, source="s", n_chars=4)]
    (got,) = found(spark, one)
    assert got == (1, leaf(one[0]), leaf(one[0]), leaf(one[0]), h(), leaf(one[0]), True)
    assert found(spark, []) == []


def test_a_long_text_counts_bytes(spark):
    data = [dict(doc_id=5, text="é" * 100_000, lang="fr", source="s", n_chars=100_000), dict(doc_id=6, text="", lang="fr", source="", n_chars=0)]
    assert found(spark, data) == plain(data)
