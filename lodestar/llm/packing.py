"""Best-fit packing by length-histogram planning.

Documents become token ids, pieces of at most ``capacity`` ids, and a histogram of piece lengths. Best-fit
decreasing runs over the counts of the histogram, not over the pieces: a run says that the pieces of one length
with ranks from a to b fill given places. Each piece then finds its place by its rank within its length.
"""

from __future__ import annotations

import bisect
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gives_back, slices, stored, table, word_spans

CAPACITY = 2048
#: Words, and token ids of them, that a Python worker remembers; it starts anew beyond. No result depends on them.
CACHE_WORDS, CACHE_IDS = 1_000_000, 5_000_000
#: Texts, and bytes of them beyond one text, that are taken apart at once.
TEXTS, TEXT_BYTES = 512, 1 << 18
#: Signs that never join a letter or digit before them in one token (fixed values; the apostrophe may).
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_U = np.uint64
#: Pieces of one length that are ranked together, about.
RANK_ROWS = 256


class WordTokens:
    """Token ids of texts, through a table of words by their 64-bit hashes.

    Right for tokenizers that drop white space, ignore case and mark word ends, as word_bpe_49k.json does: no id of theirs
    depends on a neighbouring word, nor on the case of A-Z. Texts with special tokens' signs are encoded as they are.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, cache_ids: int = CACHE_IDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.limits = cache_words, cache_ids
        self.forget()

    def forget(self) -> None:
        #: The words' hashes, ascending, with their numbers; word n's ids stand in ``pool`` from ``first[n]`` to ``first[n + 1]``.
        self.keys, self.number = np.empty(0, _U), np.empty(0, np.int32)
        self.first, self.pool, self.used = np.zeros(1 << 12, np.int32), np.empty(1 << 14, "<u4"), 0

    @staticmethod
    def _one_word(x: bytes) -> bool:
        t = x.decode("utf-8", "replace")
        return t.isalpha() and t.lower().isalpha() and unicodedata.is_normalized("NFC", t) and unicodedata.is_normalized("NFC", t.lower())

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.keys) > self.limits[0] or self.used > self.limits[1]:
            self.forget()
        special = {i: np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4") for i, t in enumerate(texts) if b"<|" in t}
        texts = [b"" if i in special else t for i, t in enumerate(texts)]
        data = b" ".join(texts).lower()
        keys, first, last = word_spans(data)
        number = self._numbers(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            own, at, again = np.unique(keys[new], return_index=True, return_inverse=True)
            number[new] = len(self.keys) + again
            self._learn(own, [data[a:b] for a, b in zip(first[new[at]].tolist(), last[new[at]].tolist(), strict=True)])
        start = self.first[number]
        size = self.first[number + 1] - start
        ends = np.cumsum(size, dtype=np.int64)
        flat = self.pool[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        words = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
        cut = np.concatenate(([0], ends))[words].tolist()
        return [special[i] if i in special else flat[a:b] for i, (a, b) in enumerate(zip([0, *cut], cut, strict=False))]

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """The words' numbers; -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.number[at], -1)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        parts, known = [], {}
        for w in words:
            core = w.rstrip(_SIGNS)
            if len(core) == len(w) or not core or not (core[-1:].isalnum() or core[-1] > 127 and core.decode("utf-8", "replace")[-1].lower()[-1].isalpha()):
                core = w
            end = w[len(core) :]
            parts.append((core, end))
            known[core] = known[end] = b""
        known.pop(b"", None)
        plain, other = [], []
        for x in known:
            (plain if x.isalpha() and x.isascii() or self._one_word(x) else other).append(x)
        for at in range(0, len(plain), 4096):
            # letters only: a word is one run of tokens, the last of which is a word's end
            part = plain[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            blob, begin = ids.tobytes(), 0
            for x, stop in zip(part, stops, strict=True):
                known[x] = blob[begin:stop]
                begin = stop
        if other:
            for x, got in zip(other, self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in other], add_special_tokens=False), strict=True):
                known[x] = struct.pack(f"<{len(got.ids)}I", *got.ids)
        blobs = [known[core] + known[end] if end else known[core] for core, end in parts]
        flat = np.frombuffer(b"".join(blobs), "<u4")
        have, used = len(self.keys), self.used + len(flat)
        if used > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(flat), self.used), "<u4")])
        if have + len(keys) >= len(self.first):
            self.first = np.concatenate([self.first[: have + 1], np.zeros(max(len(keys), have) + 1, np.int32)])
        self.pool[self.used : used] = flat
        self.first[have + 1 : have + len(keys) + 1] = self.used + np.cumsum([len(x) // 4 for x in blobs])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.number, self.used = np.insert(self.keys, at, keys), np.insert(self.number, at, np.arange(have, have + len(keys))), used


_TOKENS: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


@gives_back
def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens, end = _tokens(path), np.array([end_id], "<u4")
    for batch in batches:
        for part, texts in slices(batch, 1, TEXTS, TEXT_BYTES):
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(part.column(0).to_pylist(), tokens.ids(texts), strict=True):
                blob = np.concatenate((ids, end)).tobytes()
                for piece, start in enumerate(range(0, len(blob), 4 * capacity)):
                    own = blob[start : start + 4 * capacity]
                    for column, value in zip(rows, (doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own), own), strict=True):
                        column.append(value)
            arrays = [pa.array(rows[0], part.schema.field(0).type), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(rows[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)


def token_pieces(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian
    unsigned 32-bit). A document is its ids, then ``end_id``; only longer ones than ``capacity`` are cut. A null
    or empty text is ``end_id`` alone. Narrow: no shuffle."""
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return d.mapInArrow(partial(_cut, path=tokenizer_path, capacity=capacity, end_id=end_id, with_ids=with_ids), schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram {length: count}.

    Rows (length, first_rank, last_rank, sequence, per, offset): the piece of that length with rank r goes to
    sequence + (r - first_rank) // per, at offset + length * ((r - first_rank) % per). Work and rows depend on the
    number of distinct lengths, not on the counts. The tightest sequence that fits takes the next piece, and as
    many more of the same length as it holds, as best fit would do one by one.
    """
    runs, used = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # space left: [(first sequence, how many)]
    spaces: list[int] = []

    def put(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in groups:
                bisect.insort(spaces, space)
                groups[space] = []
            groups[space].append((first, many))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} can't be packed")
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, many = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[i]
            else:
                space, first = capacity, used
                many = -(-left // (capacity // length))
                used += many
            per = space // length
            full = min(many, left // per)
            if full:
                runs.append((length, rank, rank + full * per - 1, first, per, capacity - space))
                put(space - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < many and left:
                runs.append((length, rank, rank + left - 1, first + full, left, capacity - space))
                put(space - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(space, first + full, many - full)
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must give the same rows whenever they are read.

    The histogram (at most ``capacity`` rows) and the plan (a few runs per length) are all that reaches the driver
    and is broadcast. Ranks within a length are counted in salted groups of about RANK_ROWS, so that a length which
    many pieces share is spread; the groups' offsets come from their counts. Among equal rows any order will do.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(counts, capacity)
    lengths = F.broadcast(spark.createDataFrame([(k, n // RANK_ROWS + 1) for k, n in sorted(counts.items())] or [(0, 1)], "length long, _salts long"))
    steps = F.broadcast(spark.createDataFrame(runs or [(0,) * 6], "_l long, _a long, _z long, _s long, _per long, _o long"))
    d = pieces.join(lengths, "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")))
    groups = d.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    groups = groups.select(F.col("length").alias("_gl"), F.col("_salt").alias("_gs"), (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_base"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    d = d.join(groups, (F.col("length") == F.col("_gl")) & (F.col("_salt") == F.col("_gs"))).withColumn("_r", F.col("_r") + F.col("_base"))
    d = d.join(steps, (F.col("length") == F.col("_l")) & (F.col("_r") >= F.col("_a")) & (F.col("_r") <= F.col("_z")))
    k = F.col("_r") - F.col("_a")
    return d.select(*pieces.columns, (F.col("_s") + F.floor(k / F.col("_per"))).cast("long").alias("sequence_id"), (F.col("_o") + F.col("length") * (k % F.col("_per"))).cast("long").alias("offset"))


def best_fit_packing(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """token_pieces() with sequence_id and offset. The pieces are written once, to the shared folder, as the
    histogram and the ranks both need them. An empty table gives no rows; equal rows each get their own place."""
    return place(stored(token_pieces(df, tokenizer_path, doc_id, text, capacity, end_id, with_ids), "pieces"), capacity)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), word_tokenizer(), with_ids=False)
