"""Helpers that the operators of this subpackage share.

Text rules: a word is a run of bytes other than 0x20 and 0x09-0x0D; lower-casing touches A-Z only.
``bytes.split()`` and ``bytes.lower()`` do exactly that, so the Python side works on UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space between words, for Java's and RE2's regular expressions alike.
SPACE = r"[\x20\x09-\x0D]"
_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
#: A fixed pseudorandom 64-bit value for each byte value.
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only where that is unset in a local
    session, as in tests, a temporary folder is set in its place; a cluster without one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost
    executors, and gives the planner the true size."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more, not even to make anew what a lost executor held."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


def ordered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df sorted by ``order`` (nulls first) over ranges and stored, with ``_at``: unique, and ascending in that order. The bits
    above the 33rd tell the range."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    return stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds pos, the place of a row within its group by ``order``, from 0, and n, the group's rows. Ranges are sorted, and the
    counts of each group in each range give the places where the ranges go on, so that no task sorts a whole group."""
    d = ordered(df, [*group, *order], name).withColumn("_range", F.shiftright("_at", 33))
    runs = d.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*group)
    base = F.sum("_n").over(w.orderBy("_range")) - F.col("_n")
    runs = runs.select(F.col("_range").alias("_r"), *(F.col(g).alias(f"_g_{g}") for g in group), (base - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    same = (F.col("_range") == F.col("_r")) & F.lit(True)
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return d.join(runs, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def filtered(df: DataFrame, condition: Column | str) -> DataFrame:
    """df.filter(condition), for a condition on computed columns. Spark would push it below the projections and compute
    their expressions anew, once for each use; a row number in the condition keeps it above them."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return df.withColumn("_row_number", F.monotonically_increasing_id()).filter(c & (F.col("_row_number") >= 0)).drop("_row_number")


def words(text: Column | str) -> Column:
    """The words of a text, natively; none for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE + "+"), "")


def held_out(doc_id: Column | str, parts: int, part: int = 2) -> Column:
    """True where crc32 of the id as text leaves remainder ``part``; a null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == part, F.lit(False))


def give_back() -> None:
    """Gives memory that is free in this process back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def gives_back(f):
    """A function over a task's batches that, when the task ends, gives freed memory back to the system. A Python worker
    lives on for later tasks and other stages, and would otherwise hold the most that it ever used."""

    @functools.wraps(f)
    def run(batches, *args, **kwargs):
        try:
            yield from f(batches, *args, **kwargs)
        finally:
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS = np.ones(1, _U), np.ones(1, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_PRIME, _INVERSE):
            p = np.full(size, base, _U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS = tuple(made)
    return _POWERS[0][:n], _POWERS[1][:n]


#: Bytes that word_spans takes at once, about: it works in slices that end with a word.
SLICE = 1 << 18


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, in order, and where it starts and ends. The hash is a polynomial over the bytes, read
    off one running sum, so that the work is a few array operations for many words. Memory is bounded by slices and
    the longest word."""
    whole = np.frombuffer(text, np.uint8)
    parts, at = [], 0
    while at < len(whole):
        stop = min(len(whole), at + SLICE)
        if stop < len(whole):
            rest, step = stop, 4096
            while rest < len(whole):
                ahead = whole[rest : rest + step]
                gaps = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
                if len(gaps):
                    rest += int(gaps[0])
                    break
                rest, step = rest + step, 2 * step
            stop = min(rest, len(whole))
        b = whole[at:stop]
        inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        start, end = edge[::2], edge[1::2]
        up, down = _powers(len(b))
        total = np.zeros(len(b) + 1, _U)
        np.cumsum(_BYTE[b] * up, out=total[1:])
        parts.append((mix((total[end] - total[start]) * down[start] + (end - start).astype(_U)), start + at, end + at))
        at = stop
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    return word_spans(text)[0]


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null: empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch, column: int | str, rows: int, most: int):
    """(part of the batch, its texts as bytes): of at most ``rows`` rows and, beyond one text, ``most`` bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = batch.column(column).cast(pa.large_binary())
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        end = at + max(1, int(np.searchsorted(np.cumsum(size[at : at + rows]), most, "right")))
        end = min(end, at + rows, batch.num_rows)
        yield batch.slice(at, end - at), [x or b"" for x in texts.slice(at, end - at).to_pylist()]
        at = end


def count_sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs. Sorts in place."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def add_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of several (keys, counts), keys ascending."""
    if len(parts) == 1:
        return parts[0]
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


#: DuckDB has no crc32: its table of 256 numbers, as a CTE, and the checksum of an expression of ASCII characters by it.
CRC_TABLE_SQL = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, beside crc_table."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295)"
