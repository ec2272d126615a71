"""The pipeline's stages on nulls, repeated rows and ids, empty tables and extra columns, and run() against its parts."""

import collections

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lodestar.llm import packing

from .test_operators import LONG, NEAR, brute_quality, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, size long, copies int"


def texts():
    rng = np.random.default_rng(12)
    out = [(i, " ".join(f"w{i}_{j}" for j in range(int(rng.integers(20, 300))))) for i in range(40)]
    out += [(100, LONG), (101, LONG), (102, NEAR), (103, LONG + " and a few more words"), (104, None), (105, ""), (106, "too short"), (None, "no id " + out[3][1][:300] + " x" * 3), (5, "a second text of id 5 " + out[7][1][:50] + " ".join(f"q{j}" for j in range(30)))]
    return [*out, (100, LONG), (107, ("the same eight words stand here again now " * 30))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en" if i else None, None if i == 3 else f"s{(i or 0) % 3}", 0, "r", 1, 2) for i, t in texts()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def rows(df):
    return sorted(map(str, df.collect()))


def test_run_is_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    good = [(i, t) for i, t in texts() if brute_quality(t)[0] >= 20 and 100 * brute_quality(t)[4] <= 30 * brute_quality(t)[0]]
    kept = cp.quality_stage(spark, docs, tables)
    assert kept.columns == COLUMNS and collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(good)
    kept = cp.toxicity_stage(spark, kept, tables)
    assert kept.columns == COLUMNS and kept.count() == len(good)
    kept = cp.near_duplicate_stage(spark, kept, tables)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    alike = lambda a, b: 100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(a) | shingles(b))
    assert not any(alike(got[i][1], got[j][1]) for i in range(len(got)) for j in range(i))
    assert all(any(alike(t, u) for _, u in got) or t == NEAR for _, t in good) and (100, LONG) in got and sum(i == 5 for i, _ in got) == 2
    mixed = cp.mixing_stage(spark, kept, tables)
    assert mixed.columns == COLUMNS and all(r.n_chars == len(r.text) for r in mixed.collect())
    words = collections.Counter()
    for r in mixed.collect():
        words[str(r.doc_id)] += len(r.text.split())
    sizes = collections.Counter()
    for i, t in got:
        sizes[str(i)] += len(t.split())
    assert all(n <= 2 * sizes[i] for i, n in words.items()) and sum(words.values()) >= sum(sizes.values())
    pieces = cp.packing_stage(spark, mixed, tables)
    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    want = collections.Counter()
    for r in mixed.collect():
        want[str(r.doc_id)] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    own = collections.Counter()
    for r in pieces.collect():
        own[str(r.doc_id)] += r.length
    assert own == want
    assert rows(cp.run(spark, tables)) == rows(pieces)


def test_empty_tables(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, tables).count() == 0


def test_names_of_stages():
    assert [name for name, _ in cp.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "source mixing", "best-fit packing"] and cp.ORACLE_SQL is None
