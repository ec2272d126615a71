"""Line deduplication with two Bloom filters, of hashes seen once and seen twice; only suspected repeats are shuffled.

A text is split at line feeds. A line's key is the line without white space at its ends, in lower case (A-Z), as a digest
of 128 bits. Each task fills a once-seen and a twice-seen filter from its documents and sends the bits that it has set, cut
into segments; where tasks meet, bits that two of them have set are twice-seen too. No key that stands in two documents is
missed, so the keys that the merged filter lacks need no look: only those that it holds are sent, with their doc_id, to be
counted. Keys of enough documents then lose their lines in all documents but that of the largest doc_id.

Each row is a document. Null and empty texts are one empty line. A null doc_id is below all others; of rows that share the
largest doc_id of a key, all keep it. Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gives_back, slices, stored, table

LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
#: Bits of a filter for each line, a power of two in all; at most MAX_BITS (128 MB in each task). Beyond about 70 million
#: lines filters fill up, and more lines that are seen once are suspected and counted: the result stays the same.
BITS_A_LINE, MAX_BITS = 16, 1 << 30
SEGMENTS = 256
#: Hashes that a task holds before it sends its filters' bits, texts and bytes that it takes at once.
HELD, TEXTS, TEXT_BYTES = 1 << 20, 256, 4 << 20
#: Repeated keys that are broadcast (24 bytes each). If there are more, those in over one of HOT of all suspected lines are,
#: which can't be more than HOT, and the others are joined.
BROADCAST_KEYS, HOT = 1_000_000, 100_000


def line_digests(lines: list[bytes], least: int) -> tuple[list[int], list[bytes]]:
    """Places and digests of the lines whose key has at least ``least`` code points."""
    at, found = [], []
    for i, line in enumerate(lines):
        if len(line) >= least:
            key = line.strip().lower()  # of bytes: the six ASCII white-space characters, and A-Z only
            if len(key) >= 4 * least or len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                at.append(i)
                found.append(hashlib.blake2b(key, digest_size=16).digest())
    return at, found


def _places(digests: bytes, bits: int) -> np.ndarray:
    """The filter's two bits for each digest, as rows."""
    shift = np.uint64(64 - bits.bit_length() + 1)
    return (np.frombuffer(digests, "<u8") >> shift).astype(np.int64).reshape(-1, 2)


def _packed(places: np.ndarray) -> bytes:
    """Sorted places as compressed differences, in planes of bytes."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int64)


@gives_back
def _seen(batches: Iterator[pa.RecordBatch], bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """(segment, once, twice): the bits that this task's documents set in either filter."""
    held: list[bytes] = []

    def sent() -> pa.RecordBatch:
        data = np.frombuffer(b"".join(held), "<u8").reshape(-1, 2)
        held.clear()
        order = np.lexsort((data[:, 1], data[:, 0]))
        data = data[order]
        first = np.ones(len(data), bool)
        first[1:] = (data[1:] != data[:-1]).any(1)
        again = np.flatnonzero(~first)
        once, twice = (np.unique(_places(np.ascontiguousarray(x).tobytes(), bits)) for x in (data[first], data[again]))
        width, rows = bits // SEGMENTS, []
        cuts = np.arange(SEGMENTS + 1) * width
        a, b = np.searchsorted(once, cuts), np.searchsorted(twice, cuts)
        for s in range(SEGMENTS):
            if a[s + 1] > a[s]:
                rows.append((s, _packed(once[a[s] : a[s + 1]] - cuts[s]), _packed(twice[b[s] : b[s + 1]] - cuts[s])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["segment", "once", "twice"])

    count = 0
    for batch in batches:
        for _, texts in slices(batch, 0, TEXTS, TEXT_BYTES):
            for text in texts:
                own = set(line_digests(text.split(b"\n"), least)[1])
                held.extend(own)
                count += len(own)
                if count >= HELD:
                    yield sent()
                    count = 0
    if held:
        yield sent()


@gives_back
def _merged(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(segment, twice): bits that two senders have set, or one of them twice."""
    filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for s, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s not in filters:
                filters[s] = np.zeros(bits // SEGMENTS, bool), np.zeros(bits // SEGMENTS, bool)
            seen, again = filters[s]
            places = _unpacked(once)
            again[places[seen[places]]] = True
            seen[places] = True
            again[_unpacked(twice)] = True
    for s, (_, again) in filters.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(np.packbits(again, bitorder="little").tobytes(), 1)], pa.binary())], ["segment", "twice"])


def twice_seen(df: DataFrame, text: str, bits: int, least: int) -> np.ndarray:
    """The filter of keys in two documents or more, as bytes: at most MAX_BITS bits reach the driver."""
    sent = df.select(text).mapInArrow(partial(_seen, bits=bits, least=least), "segment int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    width = bits // SEGMENTS // 8
    for r in sent.repartition("segment").mapInArrow(partial(_merged, bits=bits), "segment int, twice binary").collect():
        out[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return out


def _suspected(found: list[bytes], seen: np.ndarray) -> np.ndarray:
    """Which digests the filter holds."""
    p = _places(b"".join(found), 8 * len(seen))
    return ((seen[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(1)


@gives_back
def _suspects(batches: Iterator[pa.RecordBatch], shared, least: int) -> Iterator[pa.RecordBatch]:
    """(digest, doc_id, row): each document's keys that the filter holds, once each."""
    seen = shared.value
    for batch in batches:
        for part, texts in slices(batch, 1, TEXTS, TEXT_BYTES):
            digests, owner = [], []
            for i, text in enumerate(texts):
                own = list(dict.fromkeys(line_digests(text.split(b"\n"), least)[1]))
                digests += own
                owner += [i] * len(own)
            if digests:
                at = np.flatnonzero(_suspected(digests, seen))
                owner = pa.array(np.array(owner)[at])
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in at.tolist()], pa.binary()), part.column(0).take(owner), part.column(2).take(owner)], ["digest", "doc_id", "row"])


class _Keys:
    """Repeated keys with the doc_id that keeps each, sorted for look-ups. The digests have one length, so that numpy's
    strings compare them in full."""

    def __init__(self, rows: list) -> None:
        rows = sorted((bytes(r["digest"]), r["keeper"]) for r in rows)
        self.digest = np.array([d for d, _ in rows], "S16")
        self.keeper = np.array([k if k is not None else 0 for _, k in rows], np.int64)
        self.none = np.array([k is None for _, k in rows], bool)

    def lost(self, found: list[bytes], doc_id: int | None) -> np.ndarray:
        """Which of a document's keys it loses."""
        own = np.array(found, "S16")
        if not len(self.digest):
            return np.zeros(len(own), bool)
        at = np.minimum(np.searchsorted(self.digest, own), len(self.digest) - 1)
        keeps = self.none[at] if doc_id is None else ~self.none[at] & (self.keeper[at] == doc_id)
        return (self.digest[at] == own) & ~keeps


@gives_back
def _kept(batches: Iterator[pa.RecordBatch], seen, keys, least: int, columns: int) -> Iterator[pa.RecordBatch]:
    seen, keys = seen.value, keys.value
    for batch in batches:
        for part, texts in slices(batch, 1, TEXTS, TEXT_BYTES):
            n, dropped, out = [], [], []
            gone = part.column(2).to_pylist()
            for doc_id, text, other in zip(part.column(0).to_pylist(), texts, gone, strict=True):
                lines = text.split(b"\n")
                at, found = line_digests(lines, least)
                lose: list[int] = []
                if found:
                    sure = np.flatnonzero(_suspected(found, seen))
                    if len(sure):
                        some = [found[i] for i in sure.tolist()]
                        hit = keys.lost(some, doc_id)
                        if other:
                            hit |= np.isin(np.array(some, "S16"), np.array([bytes(x) for x in other], "S16"))
                        lose = [at[i] for i in sure[hit].tolist()]
                n.append(len(lines))
                dropped.append(len(lose))
                if lose:
                    keep = np.ones(len(lines), bool)
                    keep[lose] = False
                    text = b"\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k)
                out.append(text)
            sha = pa.array([hashlib.sha256(x).hexdigest() for x in out])
            more = [part.column(3 + k) for k in range(columns)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), sha, pa.array(out, pa.binary()).cast(pa.string()), *more], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text", *(f"_k{k}" for k in range(columns))])


def line_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, keep: tuple[str, ...] = (), max_bits: int = MAX_BITS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, kept_text of every row, and the columns in ``keep``."""
    spark = df.sparkSession
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    lines = d.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    bits = max(8 * SEGMENTS, min(max_bits, 1 << max(16, (BITS_A_LINE * lines - 1).bit_length())))
    seen = spark.sparkContext.broadcast(twice_seen(d, "text", bits, least_chars))
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))))  # rows alike lose alike
    suspects = d.select("doc_id", "text", row.alias("row")).mapInArrow(partial(_suspects, shared=seen, least=least_chars), "digest binary, doc_id long, row binary")
    suspects = stored(suspects, "suspects")
    repeated = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= least_documents)
    repeated = stored(repeated, "repeated")
    n = repeated.count()
    small = repeated
    rest = None
    if n > broadcast_keys:
        hot = max(least_documents, suspects.count() // HOT)
        small, rest = repeated.filter(F.col("n") > hot), repeated.filter(F.col("n") <= hot)
    keys = spark.sparkContext.broadcast(_Keys(small.select("digest", "keeper").collect()))
    if rest is None:
        d = d.withColumn("gone", F.lit(None).cast("array<binary>"))
    else:
        lost = suspects.join(rest, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("row").agg(F.collect_set("digest").alias("gone"))
        d = d.withColumn("row", row).join(lost, "row", "left")
    d = d.select("doc_id", "text", "gone", *(f"_k{i}" for i in range(len(keep))))
    kept = {f"_k{i}": c for i, c in enumerate(keep)}
    types = "".join(f", {c} {dict(d.dtypes)[c]}" for c in kept)
    out = d.mapInArrow(partial(_kept, seen=seen, keys=keys, least=least_chars, columns=len(keep)), f"doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string{types}")
    return out.withColumnsRenamed(kept)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, r, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT k.*, many.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN many USING (key)) GROUP BY doc_id, r
"""
