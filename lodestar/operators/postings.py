"""Keyword search over postings of character pairs: made for one batch of questions, or stored as an index.

Texts are taken in blocks of a few hundred, of fewer if they are long, longest first. A block's postings are, for each pair, the texts that have it
and how often, as arrays in a binary row. A question's score can't exceed the sum over its pairs of weight times the
block's greatest count, so a task passes over a block for every question whose k-th score so far is above that bound.

Index: rows are split by bucket of the pair and partitioned by it, so that a batch of questions reads the buckets of its
pairs only. Which row of which block an id stands in is kept in a VersionedTable: a text that is replaced or deleted leaves
its postings behind, masked, and counts nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import search_text
from lodestar.session import written
from lodestar.sources.versioned import VersionedTable

#: Texts in a block, buckets of pairs, and questions of one pass (with about 12 bytes for each of their pairs).
BLOCK, BUCKETS, QUESTIONS = 256, 64, 32_768
#: Characters in a block of more than one text, which bound what a task holds.
CHARS = 1 << 20
CANDIDATES = 20
_ROW = "block string, most long, bucket int, ids array<long>, pairs binary, starts binary, places binary, counts binary"
_HIT = "query_id long, id long, score double"


def pairs_of(text: str) -> np.ndarray:
    """All overlapping pairs of characters as numbers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return (codes[:-1] << 21) | codes[1:]


def _bucket(pairs: np.ndarray) -> np.ndarray:
    return (pairs ^ (pairs >> 21)) % BUCKETS


def _places(known: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The places of pairs in ``known``, -1 for others. Pairs of ASCII characters are looked up in a table."""
    if not len(known):
        return np.full(len(pairs), -1)
    table = np.full(1 << 14, -1)
    ascii_known = np.flatnonzero((known >> 21 < 128) & (known & 0x1FFFFF < 128))
    table[(known[ascii_known] >> 21 << 7) | (known[ascii_known] & 127)] = ascii_known
    first, second = pairs >> 21, pairs & 0x1FFFFF
    plain = (first | second) < 128
    out = np.where(plain, table[((first << 7) | second) & 0x3FFF], -1)
    other = np.flatnonzero(~plain)
    if len(other):
        at = np.minimum(np.searchsorted(known, pairs[other]), len(known) - 1)
        out[other] = np.where(known[at] == pairs[other], at, -1)
    return out


def _postings(texts: list[str], known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(pair, place, count) of the pairs (those in ``known``, sorted, if given), by pair and place; and the longest text."""
    found = [pairs_of(t) for t in texts]
    flat, row = np.concatenate(found) if found else np.empty(0, np.int64), np.repeat(np.arange(len(found)), [len(x) for x in found])
    if known is not None:
        at = _places(known, flat)
        hit = at >= 0
        key = at[hit] * len(found) + row[hit]
        if len(known) * len(found) <= 8 * len(key):  # dense enough to be counted in a table
            table = np.bincount(key, minlength=1)
            key = np.flatnonzero(table)
            count = table[key]
        else:
            key, count = np.unique(key, return_counts=True)
        return known[key // len(found)] if len(key) else key, key % max(len(found), 1), count, max(map(len, found), default=0)
    own, at = np.unique(flat, return_inverse=True)
    key, count = np.unique(at * len(found) + row, return_counts=True)
    return own[key // len(found)] if len(key) else key, key % max(len(found), 1), count, max(map(len, found), default=0)


def _packed(pair: np.ndarray, place: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
    return pair[first].astype("<i8").tobytes(), np.append(first, len(pair)).astype("<i4").tobytes(), place.astype("<i2").tobytes(), count.astype("<i4").tobytes()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch (id, text) in parts of at most BLOCK texts and, beyond one text, CHARS characters."""
    size, at = pc.utf8_length(batch.column(1)).to_numpy(), 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[at : at + BLOCK], dtype=np.int64), CHARS, "right")))
        yield batch.slice(at, n)
        at += n


def _made(batches: Iterator[pa.RecordBatch], shared, name: str, split: bool) -> Iterator[pa.RecordBatch]:
    """Block rows of the texts: bucket -1 holds the ids; the postings are in it too unless they are split by bucket."""
    known, number = shared.value if shared is not None else None, 0
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    names = [x.split()[0] for x in _ROW.split(", ")]
    for batch in batches:
        for part in _parts(batch):
            pair, place, count, most = _postings(part.column(1).to_pylist(), known)
            block, ids = f"{name}-{TaskContext.get().partitionId()}-{number}", part.column(0).to_pylist()
            number += 1
            rows = [(block, most, -1, ids, *((None,) * 4 if split else _packed(pair, place, count)))]
            if split:
                bucket = _bucket(pair)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
                for b in range(BUCKETS):
                    own = order[cuts[b] : cuts[b + 1]]
                    if len(own):
                        rows.append((block, most, b, None, *_packed(pair[own], place[own], count[own])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def block_rows(texts: DataFrame, shared=None, name: str = "", split: bool = False) -> DataFrame:
    """texts (id, t), t being search text, as block rows; longest texts of a partition first."""
    ordered = texts.withColumn("_n", F.length("t")).sortWithinPartitions(F.col("_n").desc()).select("id", "t")
    return ordered.mapInArrow(partial(_made, shared=shared, name=name, split=split), _ROW)


class _Questions:
    """A batch of questions: their ids, and their pairs as places in the sorted distinct pairs."""

    def __init__(self, rows: list) -> None:
        self.ids = np.array([r["query_id"] for r in rows], np.int64)
        asked = [np.unique(pairs_of(r["t"])) for r in rows]
        self.known = np.unique(np.concatenate(asked)) if asked else np.empty(0, np.int64)
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in asked]))).astype(np.int64)
        self.pairs = np.searchsorted(self.known, np.concatenate(asked)) if asked else np.empty(0, np.int64)
        self.weight = np.zeros(len(self.known))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[tuple]]]:
    """(ids, [(pairs, starts, places, counts)]) of each block; its rows are neighbours, the one with the ids first."""
    block = ids = None
    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c) for c in ("block", "ids", "pairs", "starts", "places", "counts")]
        for row in range(batch.num_rows):  # a batch's postings are never copied as a whole
            name, own, *data = (c[row].as_py() for c in columns)
            if name != block:
                if block is not None and ids is not None:
                    yield ids, held
                block, ids, held = name, None, []
            if own is not None:
                ids = own
            if data[0]:
                held.append(tuple(np.frombuffer(x, k) for x, k in zip(data, ("<i8", "<i4", "<i2", "<i4"), strict=True)))
    if block is not None and ids is not None:
        yield ids, held


def _asked(known: np.ndarray, ids: list[int | None], rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of the pairs in known, place of the text, count) of the postings that are asked for and live; live places."""
    live = np.array([i is not None for i in ids])
    out = []
    for pair, starts, places, counts in rows:
        at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        hit = np.flatnonzero(known[at] == pair) if len(known) else np.empty(0, np.int64)
        size = starts[hit + 1] - starts[hit]
        flat = np.repeat(starts[hit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        keep = live[places[flat]]
        out.append((np.repeat(at[hit], size)[keep], places[flat][keep].astype(np.int64), counts[flat][keep]))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (live,)
    return *(np.concatenate(x) for x in zip(*out, strict=True)), live


def _frequencies(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    n = np.zeros(len(shared.value.known), np.int64)
    for ids, rows in _blocks(batches):
        n += np.bincount(_asked(shared.value.known, ids, rows)[0], minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pair", "n"])


def _scored(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """A task's k best of each question, ties at the border kept whole."""
    q = shared.value
    n = len(q.ids)
    full = np.flatnonzero(np.diff(q.starts))
    cut = np.zeros(n)  # each question's k-th score so far; scores below it can't count any more
    best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n
    for ids, rows in _blocks(batches):
        pair, place, count, live = _asked(q.known, ids, rows)
        if not len(pair):
            continue
        own, at = np.unique(pair, return_inverse=True)
        tf = np.zeros((len(own) + 1, len(ids)))  # the last row stays zero, for pairs that the block lacks
        tf[at, place] = count
        row = np.full(len(q.known), len(own))
        row[own] = np.arange(len(own))
        bound = np.zeros(n)
        bound[full] = np.add.reduceat(q.weight[q.pairs] * tf.max(1)[row[q.pairs]], q.starts[full]) if len(full) else 0
        number = np.array([-1 if i is None else i for i in ids], np.int64)
        for i in np.flatnonzero((bound > 0) & (bound * (1 + 1e-9) + 1e-9 >= cut)).tolist():
            p = q.pairs[q.starts[i] : q.starts[i + 1]]
            score = np.round(q.weight[p] @ tf[row[p]], 9)  # sums in another order differ beyond that
            good = np.flatnonzero((score > 0) & (score >= cut[i]) & live)
            if not len(good):
                continue
            score, number_of = score[good], number[good]
            if best[i] is not None:
                score, number_of = np.concatenate((best[i][0], score)), np.concatenate((best[i][1], number_of))
            if len(score) > k:
                cut[i] = np.partition(score, len(score) - k)[len(score) - k]
                keep = score >= cut[i]
                score, number_of = score[keep], number_of[keep]
            best[i] = score, number_of
    some = [i for i in range(n) if best[i] is not None]
    if some:
        sizes = [len(best[i][0]) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids[some], sizes)), pa.array(np.concatenate([best[i][1] for i in some])), pa.array(np.concatenate([best[i][0] for i in some]))], ["query_id", "id", "score"])


def question_batches(queries: DataFrame, size: int = QUESTIONS) -> Iterator[_Questions]:
    """The questions (query_id, text) that have text, in batches; the driver holds one of them."""
    rows = []
    for row in queries.filter("text IS NOT NULL").select("query_id", search_text(F.col("text")).alias("t")).toLocalIterator():
        rows.append(row)
        if len(rows) == size:
            yield _Questions(rows)
            rows = []
    if rows:
        yield _Questions(rows)


def scored(blocks: DataFrame, questions: _Questions, n: int, k: int) -> DataFrame:
    """(query_id, id, score) by tf-idf, sum of tf x ln(1 + n / df) over a question's distinct pairs: what each task's k best are.
    blocks: block rows, of which those of one block are in one partition and the longest come first."""
    sc = blocks.sparkSession.sparkContext
    found = blocks.mapInArrow(partial(_frequencies, shared=sc.broadcast(questions)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    for r in found:
        questions.weight[r["pair"]] = np.log(1 + n / r["n"])
    return blocks.mapInArrow(partial(_scored, shared=sc.broadcast(questions), k=k), _HIT)


def keyword_hits(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES, questions: int = QUESTIONS) -> DataFrame:
    """scored() over all chunks (id, text): one scan of the texts for each batch of questions, which writes the postings of
    the questions' pairs; frequencies and scores come from these. Null ids and texts match nothing, but count in n."""
    texts = chunks.select(F.col("id").cast("long").alias("id"), "text").filter("id IS NOT NULL AND text IS NOT NULL").select("id", search_text(F.col("text")).alias("t"))
    n, out = chunks.count(), None
    for batch in question_batches(queries, questions):
        rows = written(block_rows(texts, chunks.sparkSession.sparkContext.broadcast(batch.known)), "postings")
        found = scored(rows, batch, n, k)
        out = found if out is None else out.unionByName(found)
    return chunks.sparkSession.createDataFrame([], _HIT) if out is None else out


class KeywordIndex:
    """Stored postings, updated by adding: ``add`` and ``delete`` take the number of their commit and its writer, and may be run
    again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.places = VersionedTable(spark, f"{path}/places", "id", "id long, block string, place int, most long")

    def add(self, chunks: DataFrame, number: int, writer: str = "main") -> None:
        """Adds or replaces chunks (id, text); one without text is taken away. Equal ids in one call are chunks each."""
        ids = chunks.select(F.col("id").cast("long").alias("id"), "text").filter("id IS NOT NULL")
        texts = ids.filter("text IS NOT NULL").select("id", search_text(F.col("text")).alias("t"))
        commit = f"{writer}-{number}"
        at = f"{self.path}/postings/commit={commit}"
        block_rows(texts, name=commit, split=True).write.mode("overwrite").partitionBy("bucket").parquet(at)
        own = self.spark.read.schema(_ROW).parquet(at).filter("bucket = -1").select("block", "most", F.posexplode("ids").alias("place", "id"))
        self.places.replace(own.select("id", "block", "place", "most"), number, ids, writer)

    def delete(self, ids: DataFrame, number: int, writer: str = "main") -> None:
        self.places.delete(ids, number, writer)

    def blocks(self, buckets: list[int]) -> DataFrame:
        """Block rows of the buckets, with the ids that live, null for others; a block's rows in one partition, longest first."""
        live = self.places.read()
        width = F.lit(BLOCK)
        ids = live.groupBy("block").agg(F.max("most").alias("most"), F.map_from_entries(F.collect_list(F.struct("place", "id"))).alias("m"))
        ids = ids.select("block", "most", F.lit(-1).alias("bucket"), F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.try_element_at("m", i)).alias("ids"), *(F.lit(None).cast("binary").alias(c) for c in ("pairs", "starts", "places", "counts")))
        if not self.places.there():
            return self.spark.createDataFrame([], _ROW)
        rows = self.spark.read.schema(f"{_ROW}, commit string").parquet(f"{self.path}/postings").filter(F.col("bucket").isin(buckets)).drop("commit")
        return ids.unionByName(rows.select(*ids.columns)).repartition("block").sortWithinPartitions(F.col("most").desc(), "block", "bucket")

    def search(self, queries: DataFrame, k: int = CANDIDATES, questions: int = QUESTIONS) -> DataFrame:
        """(query_id, id, score) as keyword_hits() over the live chunks; reads the buckets of the questions' pairs only."""
        n, out = self.places.read().count(), None
        for batch in question_batches(queries, questions):
            buckets = sorted(set(_bucket(batch.known).tolist()))
            found = scored(written(self.blocks(buckets), "blocks"), batch, n, k)
            out = found if out is None else out.unionByName(found)
        return self.spark.createDataFrame([], _HIT) if out is None else out
