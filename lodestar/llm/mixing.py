"""Mixing sources to target weights.

Each source's words form one stream, in pseudorandom order of its documents, cut into blocks of fixed length. Each
output shard draws how many of its slots go to each source. A source's slots are numbered; slot i is block
permutation(i mod blocks), with another pseudorandom permutation for each pass over the source. Blocks are joined
by their index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import as_bytes, gives_back, mix, stored, table

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words in a block, slots in a shard.
BLOCK, SHARD_SLOTS = 64, 4096
#: Slots that a task makes, about.
TASK_SLOTS = 1 << 18
SEED = 20240607
_U = np.uint64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@gives_back
def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = [len(x.split()) for x in as_bytes(batch.column("_text"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int64())], [*batch.schema.names, "size"])


def with_sizes(df: DataFrame) -> DataFrame:
    """Adds size, the number of words of ``_text``."""
    return df.mapInArrow(_sized, StructType([*df.schema.fields, StructField("size", LongType())]))


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words to take of each source: ``share`` of all, by weight; none above ``cap`` times its size, the excess
    going to the others by weight until none is above."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > cap * sizes[i]}
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        free -= over
    return out


def drawn(need: int, left: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A multinomial draw of ``need`` slots, weighted by what the sources have left; what exceeds that is drawn again from the others."""
    if need == int(left.sum()):
        return left
    got = np.zeros(len(left), np.int64)
    while (lack := need - int(got.sum())) > 0:
        rest = left - got
        got = np.minimum(left, got + rng.multinomial(lack, rest / rest.sum()))
    return got


def draws(slots: np.ndarray, shard_slots: int, seed: int, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot of each source, slots of each source) of the shards from ``begin`` to before ``end``.

    All shards together hold all slots. A run of shards draws what its first half gets, seeded by its bounds, and the second half
    gets what is left; the halves go on alike down to single shards. So a task finds its own shards' counts, and where they begin in
    each source, from the sources' slots alone: it draws on the way down to them and passes over all else.
    """
    runs = [(0, -(-int(slots.sum()) // shard_slots), np.zeros(len(slots), np.int64), slots)]
    while runs:
        low, high, first, own = runs.pop()
        if low >= end or high <= begin or low >= high:
            continue
        if high - low == 1:
            yield low, first, own
            continue
        middle = (low + high) // 2
        got = drawn((middle - low) * shard_slots, own, np.random.Generator(np.random.PCG64([seed, low, high])))
        runs += [(middle, high, first + got, own - got), (low, middle, first, got)]


def _drawn_rows(batches: Iterator[pa.RecordBatch], slots: np.ndarray, blocks: np.ndarray, shard_slots: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, s, first, n, blocks) of the shards whose numbers, without gaps, are in the batches; a batch for each shard."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for shard, first, n in draws(slots, shard_slots, seed, int(ids.min()), int(ids.max()) + 1) if len(ids) else ():
            s = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(s), shard), s, first[s], n[s], blocks[s])], ["shard", "s", "first", "n", "blocks"])


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of [0, size) at each index: a Feistel network over the next even power of two, walked on
    until it falls below size."""
    size = np.maximum(size.astype(np.int64), 1)
    bits = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 0.5)).astype(np.int64)
    half = ((bits + 1) // 2).astype(_U)
    mask = (_U(1) << half) - _U(1)
    out, todo = index.astype(_U).copy(), np.arange(len(index))
    limit, key = size.astype(_U), key.astype(_U)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        high, low = x >> h, x & m
        for r in range(4):
            high, low = low, high ^ (mix(low + k * _U(4) + _U(r)) & m)
        x = (high << h) | low
        out[todo] = x
        todo = todo[x >= limit[todo]]
    return out.astype(np.int64)


def _block_of(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), mix(key.to_numpy().astype(np.int64).view(_U))))


class Mixture:
    """The parts of a mix. ``rows``: documents with their place in their source's stream. ``slots``: (shard, slot,
    source, pass, block). Both are lazy; ``rows`` reads a table written once to the shared folder."""

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep_text: bool = False, keep: tuple[str, ...] = (),
                 weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        spark = df.sparkSession
        d = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("_source"), F.col(text).alias("_text"), *(F.col(k).alias(f"_keep_{k}") for k in keep))
        d = with_sizes(d).withColumn("_th", F.xxhash64("_text")).withColumn("_rid", F.monotonically_increasing_id())
        self.base = stored(d if keep_text else d.drop("_text"), "sizes")
        found = self.base.groupBy("_source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        found.sort(key=lambda r: (r["_source"] is None, (r["_source"] or "").encode("utf-32-be")))
        sizes = [r["size"] for r in found]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, cap)
        blocks = [-(-n // block) for n in sizes]
        slots = [min(int(cap * b), round(t * b / n)) if n else 0 for t, b, n in zip(goal, blocks, sizes, strict=True)]
        self.block, self.cap, self.seed = block, cap, seed
        sources = spark.createDataFrame([(r["_source"], i, n, t, b) for i, (r, n, t, b) in enumerate(zip(found, sizes, goal, blocks, strict=True))], "_name string, s int, source_size long, target double, _blocks long")
        #: Groups in which documents are ordered: about 128 rows of the hottest source each.
        salts = max(1, min(65_536, max((r["n"] for r in found), default=1) // 128))
        d = self.base.join(sources, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name", "_blocks").withColumn("_salt", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_th"), F.lit(salts)))
        sums = d.groupBy("s", "_salt").agg(F.sum("size").alias("_n"))
        sums = sums.select(F.col("s").alias("_gs"), F.col("_salt").alias("_gsalt"), (F.sum("_n").over(Window.partitionBy("s").orderBy("_salt")) - F.col("_n")).alias("_start"))
        own = Window.partitionBy("s", "_salt").orderBy("doc_id", "_th", "size", "_rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        small = [c for c in d.columns if c != "_text"]
        d = d.select(*small).withColumn("_before", F.sum("size").over(own) - F.col("size"))
        self.rows = d.join(sums, (F.col("s") == F.col("_gs")) & (F.col("_salt") == F.col("_gsalt"))).withColumn("start", F.col("_start") + F.col("_before"))
        shards = -(-sum(slots) // shard_slots)
        ids = spark.range(0, shards, 1, max(1, min(shards, sum(slots) // TASK_SLOTS)))
        make = partial(_drawn_rows, slots=np.array(slots, np.int64), blocks=np.array(blocks, np.int64), shard_slots=shard_slots, seed=seed)
        p = ids.mapInArrow(make, "shard long, s long, first long, n long, blocks long")
        p = p.select("shard", "s", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
        p = p.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("long"))
        self.slots = p.select("shard", "s", "slot", "pass", F.pandas_udf(_block_of, "long")(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "s", "pass")).alias("block"))

    def segments(self) -> DataFrame:
        """Each document's share of each block, and how often the mix takes that block (0 without slots)."""
        last = F.col("start") + F.col("size")
        ids = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / self.block), F.floor((last - 1) / self.block)))
        d = self.rows.select("doc_id", "_rid", "s", "size", "source_size", "target", "start", F.explode_outer(ids).alias("block"))
        d = d.withColumn("low", F.greatest(F.col("start"), F.col("block") * self.block) - F.col("start")).withColumn("high", F.least(last, (F.col("block") + 1) * self.block) - F.col("start"))
        times = self.slots.groupBy(F.col("s").alias("_ts"), F.col("block").alias("_tb")).agg(F.count(F.lit(1)).alias("_times")).hint("merge")  # grows with the slots: never broadcast
        return d.join(times, (F.col("s") == F.col("_ts")) & (F.col("block") == F.col("_tb")), "left").withColumn("times", F.coalesce("_times", F.lit(0))).drop("_ts", "_tb", "_times")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken per input row."""
        g = self.segments().groupBy("_rid", "doc_id", "size", "source_size", "target").agg(F.sum(F.coalesce(F.col("high") - F.col("low"), F.lit(0)) * F.col("times")).alias("taken"))
        return g.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))

    def documents(self) -> DataFrame:
        """The mix as documents: a row (doc_id, copy, text, kept columns) for each document and pass, whose text
        has the words of the blocks that are taken more than ``copy`` times. Needs keep_text."""
        s = self.segments().filter("times > 0").select("_rid", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)).alias("copy"), F.struct("low", "high").alias("part"))
        s = s.groupBy(F.col("_rid").alias("_sr"), "copy").agg(F.sort_array(F.collect_list("part")).alias("_parts"))
        d = self.base.join(s, F.col("_rid") == F.col("_sr")).drop("_rid", "_sr", "size", "_th")
        out = d.drop("_parts").withColumnRenamed("_text", "text")
        return d.select(*(c for c in d.columns if c != "_parts"), "_parts").mapInArrow(_assembled, out.schema)


@gives_back
def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        made = []
        for text, parts in zip(as_bytes(batch.column(at)), batch.column("_parts").to_pylist(), strict=True):
            spans, merged = [m.span() for m in _WORD.finditer(text)], []
            for p in parts:
                if merged and merged[-1][1] == p["low"]:
                    merged[-1][1] = p["high"]
                else:
                    merged.append([p["low"], p["high"]])
            whole = merged == [[0, len(spans)]]
            made.append((text if whole else b"\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged)).decode("utf-8", "replace"))
        names = [n for n in batch.schema.names if n != "_parts"]
        arrays = [pa.array(made, pa.string()) if n == "_text" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(arrays, ["text" if n == "_text" else n for n in names])


def mix_sources(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target and taken, one row per input row.

    Sources weigh 5, 2, 1, repeating, in order of code points, null last, and share 150 % of all words; none gives
    more than twice its words, so no document is taken more than twice. A null or empty text has size 0 and is
    taken 0 times. Equal rows each take part. The result depends on the rows' values and the seed only. On the
    driver: one row per source; shards are drawn in tasks.
    """
    return Mixture(df, doc_id, text, source, **options).taken()


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
