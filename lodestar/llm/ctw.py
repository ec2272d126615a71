"""LM scoring by context-tree weighting.

A text is coded as its words, lower-cased, with one space between them, then an end byte. Each byte is eight binary
decisions, and a decision's context is the bytes before it, up to ``depth`` of them. Every context holds, for each
decision, a Krichevsky-Trofimov estimate from its counts of zeros and ones; context-tree weighting mixes the estimates
of all depths. As a KT estimate depends on counts alone, the counts come from one aggregation over the corpus. The
result is a code length for each byte in each context, so that a byte is scored by following its context down the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_counts, as_bytes, count_sorted, held_out, stored, table, word_hashes

DEPTH = 5
#: Contexts of a smaller count share their parent's remainder; at 1 all that occur are in the tree.
LEAST_COUNT = 1
#: Contexts of so many bytes at most are one small tree on the driver, bounded by the alphabet; the trees below each of them
#: are worked out in tasks, about BUCKET_GRAMS grams at once.
TOP, BUCKET_GRAMS = 2, 50_000
#: (depth + 1)-grams whose code lengths are broadcast, at most, the most frequent ones; all others are looked up by a join.
HOT_GRAMS = 1 << 21
#: Words whose counts are broadcast; all others are looked up by a join.
HOT_WORDS = 1 << 18
END = 0xFF  # no byte of UTF-8
_U = np.uint64
_CHUNK = 2 << 20
_GRAM, _WORD = 0, 1


def coded(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + bytes([END])


def _gram_keys(data: np.ndarray, depth: int) -> np.ndarray:
    """For each byte: the byte itself in the lowest place, then those before it, the nearest first and highest:
    key = b[-1] << 8*depth | b[-2] << 8*(depth-1) | ... | b[-depth] << 8 | b."""
    n = len(data) - depth
    key = np.zeros(n, _U)
    for d in range(1, depth + 1):
        key = (key << _U(8)) | data[depth - d : depth - d + n]
    return (key << _U(8)) | data[depth:]


def _framed(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after ``depth`` end bytes; and the positions of the bytes to score."""
    pad = bytes([END]) * depth
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size + depth) - size
    at = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
    return data, at


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = as_bytes(batch.column(column))
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= _CHUNK):
                size, end = size + len(texts[end]), end + 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Per task: counts of (depth + 1)-grams and of words, merged as long as they fit in memory."""
    kept: dict[int, list] = {_GRAM: [], _WORD: []}

    def send(kind: int) -> Iterator[pa.RecordBatch]:
        keys, counts = add_counts(kept[kind]) if kept[kind] else (np.empty(0, _U), np.empty(0, np.int64))
        kept[kind] = []
        for i in range(0, len(keys), 1 << 16):
            k = keys[i : i + (1 << 16)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(counts[i : i + (1 << 16)])], ["kind", "key", "n"])

    for _, texts in _chunks(batches, "_text"):
        code = [coded(t) for t in texts]
        data, at = _framed(code, depth)
        kept[_GRAM].append(count_sorted(_gram_keys(data, depth)[at - depth]))
        kept[_WORD].append(count_sorted(np.concatenate([word_hashes(t[:-1]) for t in code])))
        for kind in kept:
            if len(kept[kind]) >= 8 and sum(len(k) for k, _ in kept[kind]) > 1_500_000:
                kept[kind] = [add_counts(kept[kind])]
                if len(kept[kind][0][0]) > 3_000_000:
                    yield from send(kind)
    for kind in kept:
        yield from send(kind)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the KT block probability of a zeros and b ones: G(a+1/2) G(b+1/2) / (pi G(a+b+1))."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - np.log(np.pi) - _lgamma(a + b + 1.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series beyond 8."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        small = x < 8
        shift -= np.where(small, np.log(x), 0.0)
        x = np.where(small, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


class Tree:
    """nodes: rows (depth, context, byte, count) of the kept contexts; the root has depth 0 and context 0. A context of
    depth d is its d bytes, nearest first."""

    def __init__(self, depth: np.ndarray, context: np.ndarray, byte: np.ndarray, count: np.ndarray, levels: int):
        self.symbols = np.unique(byte).astype(np.int64)
        place = np.full(256, -1, np.int64)
        place[self.symbols] = np.arange(len(self.symbols))
        ids = depth.astype(np.int64) << 56 | context.astype(np.int64)
        known, node = np.unique(ids, return_inverse=True)
        n, width = len(known), len(self.symbols)
        self.counts = np.zeros((n, width))
        np.add.at(self.counts, (node, place[byte]), count)
        self.depth, self.context = known >> 56, known & ((1 << 56) - 1)
        parent_id = np.where(self.depth > 0, (self.depth - 1) << 56 | ((known & ((1 << 56) - 1)) >> 8), 0)
        self.parent = np.minimum(np.searchsorted(known, parent_id), max(0, n - 1))
        #: Next node for a context's next byte back; itself where the tree ends.
        self.child = np.repeat(np.arange(n, dtype=np.int32)[:, None], width, 1)
        for d in range(1, levels + 1):
            at = np.flatnonzero(self.depth == d)
            ok = place[known[at] & 255] >= 0
            self.child[self.parent[at[ok]], place[known[at[ok]] & 255]] = at[ok]
        #: Counts in contexts that are not kept, taken together as one more branch of their parent.
        self.rest = self.counts.copy()
        deep = np.flatnonzero(self.depth > 0)
        np.subtract.at(self.rest, self.parent[deep], self.counts[deep])
        self.rest = np.maximum(self.rest, 0.0)
        self.place = place
        self.levels = levels

    def decisions(self, leaf: dict[int, np.ndarray] | None = None) -> Iterator[tuple]:
        """For each binary decision that the corpus has: its number (a one before the bits so far), its bit, the columns of its
        symbols, whether theirs is a one; and for each node the probability of a one if the path ends there, what the nodes
        above give to it, and the weight left for the node and those below.

        leaf: by decision, log weights of the deepest nodes, where further trees hang below them."""
        n = len(self.counts)
        order = [np.flatnonzero(self.depth == d) for d in range(self.levels + 1)]
        for bit in range(7, -1, -1):
            prefix = self.symbols >> (bit + 1)
            for g in np.unique(prefix):
                cols = np.flatnonzero(prefix == g)
                ones = (self.symbols[cols] >> bit & 1).astype(bool)
                number = 1 << (7 - bit) | int(g)
                b, a = self.counts[:, cols[ones]].sum(1), self.counts[:, cols[~ones]].sum(1)
                b_rest, a_rest = self.rest[:, cols[ones]].sum(1), self.rest[:, cols[~ones]].sum(1)
                kt = _log_kt(a, b)
                weighted, below = kt.copy(), _log_kt(a_rest, b_rest)
                if leaf is not None:
                    weighted[order[self.levels]] = leaf.get(number, 0.0)
                inner = np.zeros(n, bool)
                for d in range(self.levels, -1, -1):
                    at = order[d]
                    split = at[inner[at]]
                    weighted[split] = np.logaddexp(kt[split], below[split]) - np.log(2)
                    if d:
                        np.add.at(below, self.parent[at], weighted[at])
                        inner[self.parent[at]] = True
                stop = np.where(inner, np.exp(np.clip(kt - np.log(2) - weighted, -700, 0)), 1.0)
                p1, p1_rest = (b + 0.5) / (a + b + 1.0), (b_rest + 0.5) / (a_rest + b_rest + 1.0)
                mixed, carry = np.zeros(n), np.ones(n)
                for d in range(1, self.levels + 1):
                    at, up = order[d], self.parent[order[d]]
                    mixed[at] = mixed[up] + carry[up] * stop[up] * p1[up]
                    carry[at] = carry[up] * (1 - stop[up])
                yield number, bit, cols, ones, mixed + carry * (stop * p1 + (1 - stop) * p1_rest), mixed, carry

    def code_lengths(self) -> np.ndarray:
        """(nodes, symbols + 1) base-10 logs of P(byte | deepest context = node); the last column is for bytes that the
        corpus lacks, a 256th of the least estimate."""
        n, width = self.counts.shape
        out = np.zeros((n, width + 1))
        for _, _, cols, ones, p, _, _ in self.decisions():
            p = np.clip(p, 1e-12, 1 - 1e-12)
            out[:, cols[ones]] += np.log10(p)[:, None]
            out[:, cols[~ones]] += np.log10(1 - p)[:, None]
        out[:, width] = out[:, :width].min(1) - np.log10(256) if width else 0.0
        return out


class Top:
    """A tree's mixtures, with the weights (context, decision, weight) of the trees below its deepest nodes: what tasks need
    to go on from there."""

    def __init__(self, tree: Tree, context: np.ndarray, decision: np.ndarray, weight: np.ndarray):
        self.levels, at = tree.levels, np.flatnonzero(tree.depth == tree.levels)
        leaf, place = {}, np.searchsorted(tree.context[at], context)
        for x in np.unique(decision):
            own = decision == x
            leaf[int(x)] = np.zeros(len(at))
            leaf[int(x)][place[own]] = weight[own]
        deepest = tree.depth == tree.levels
        #: Column of a decision, -1 for those that the corpus lacks.
        self.column, ends, carries = np.full(256, -1), [], []
        for i, (number, _, _, _, end, mixed, carry) in enumerate(tree.decisions(leaf)):
            self.column[number] = i
            ends.append(np.where(deepest, mixed, end))
            carries.append(np.where(deepest, carry, 0.0))
        self.nodes = [(tree.context[tree.depth == d], np.flatnonzero(tree.depth == d)) for d in range(tree.levels + 1)]
        self.end, self.carry = (np.stack(x, 1) if x else np.zeros((len(tree.depth), 0)) for x in (ends, carries))

    def node(self, key: np.ndarray, depth: int) -> np.ndarray:
        """The deepest node of the contexts of grams."""
        out = np.zeros(len(key), np.int64)
        for d, (known, at) in enumerate(self.nodes):
            i = _found(known, key >> 8 * (depth - d + 1))
            out = np.where(i >= 0, at[i] if len(at) else 0, out)
        return out


def _found(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places in ``known``, ascending; -1 for those that it lacks."""
    if not len(known):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.where(known[at] == key, at, -1)


class Forest:
    """The trees below the contexts of ``top`` bytes, as sparse as the grams are: key, ascending, and n, their counts."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, top: int, least: int):
        self.byte, self.n = key & 255, n.astype(float)
        #: By level: kept contexts; each gram's place among them, -1 if it has none; each context's parent; whether it has children.
        self.nodes, self.place, self.parent, self.inner = [], [], [], []
        for d in range(top, depth + 1):
            context = key >> 8 * (depth - d + 1)
            first = np.flatnonzero(np.diff(context, prepend=-1))
            keep = (np.add.reduceat(n, first) >= least) | (d == 0) if len(first) else np.zeros(0, bool)
            self.place.append(np.repeat(np.where(keep, np.cumsum(keep) - 1, -1), np.diff(np.append(first, len(key)))))
            self.nodes.append(context[first][keep])
            self.inner.append(np.zeros(len(self.nodes[-1]), bool))
            self.parent.append(np.searchsorted(self.nodes[-2], self.nodes[-1] >> 8) if d > top else None)
            if d > top:
                self.inner[-2][self.parent[-1]] = True

    def decisions(self, bit: int) -> list[tuple]:
        """By level, the decisions at a bit that the grams have: (context's place * 256 + bits before, counts of zeros and ones,
        those in contexts that are not kept, log KT, log weight)."""
        one, prefix, levels = self.byte >> bit & 1, self.byte >> (bit + 1), []
        for place in self.place:
            ok = place >= 0
            key = place[ok] << 8 | prefix[ok]
            ids, at = np.unique(key, return_inverse=True)
            levels.append([ids, *(np.bincount(at, np.where(one[ok] == x, self.n[ok], 0.0), len(ids)) for x in (0, 1))])
        out, child = [], None
        for i in range(len(levels) - 1, -1, -1):
            ids, a, b = levels[i]
            a_rest, b_rest, below = a, b, np.zeros(len(ids))
            if child is not None:
                at = np.searchsorted(ids, self.parent[i + 1][child[0] >> 8] << 8 | child[0] & 255)
                a_rest, b_rest = a - np.bincount(at, child[1], len(ids)), b - np.bincount(at, child[2], len(ids))
                below += np.bincount(at, child[6], len(ids))
            kt = _log_kt(a, b)
            left = np.flatnonzero(a_rest + b_rest > 0) if child is not None else np.empty(0, int)
            below[left] += _log_kt(a_rest[left], b_rest[left])
            weighted = np.where(self.inner[i][ids >> 8], np.logaddexp(kt, below) - np.log(2), kt)
            child = ids, a, b, a_rest, b_rest, kt, weighted
            out.append(child)
        return out[::-1]

    def lengths(self, key: np.ndarray, top: Top, depth: int) -> np.ndarray:
        """log10 P(byte | context) of grams, whether they occur in the corpus or not."""
        byte, root, out = key & 255, top.node(key, depth), np.zeros(len(key))
        path = [_found(known, key >> 8 * (depth - top.levels - i + 1)) for i, known in enumerate(self.nodes)]
        for bit in range(7, -1, -1):
            prefix, levels = byte >> (bit + 1), self.decisions(bit)
            below, carry = np.zeros(len(key)), np.ones(len(key))
            for i, (ids, a, b, a_rest, b_rest, kt, weighted) in enumerate(levels):
                on = np.flatnonzero(path[i] >= 0)
                at = _found(ids, path[i][on] << 8 | prefix[on])
                get = lambda x, at=at: np.where(at >= 0, x[at], 0.0) if len(x) else np.zeros(len(at))
                a, b, a_rest, b_rest, kt, weighted = map(get, (a, b, a_rest, b_rest, kt, weighted))
                stop = np.where(self.inner[i][path[i][on]], np.exp(np.clip(kt - np.log(2) - weighted, -700, 0)), 1.0)
                ends = path[i + 1][on] < 0 if i + 1 < len(path) else np.ones(len(on), bool)
                below[on] += carry[on] * (stop * (b + 0.5) / (a + b + 1.0) + np.where(ends, (1 - stop) * (b_rest + 0.5) / (a_rest + b_rest + 1.0), 0.0))
                carry[on] *= 1 - stop
            column = top.column[1 << (7 - bit) | prefix]
            p = np.where(column >= 0, top.end[root, column] + top.carry[root, column] * below, 0.5) if top.end.shape[1] else np.full(len(key), 0.5)
            p = np.clip(p, 1e-12, 1 - 1e-12)
            out += np.log10(np.where(byte >> bit & 1 == 1, p, 1 - p))
        return out


def _forest(group: pa.Table, depth: int, top: int, least: int) -> Forest:
    key, n = (group.column(c).to_numpy() for c in ("key", "n"))
    key, n = key[n > 0], n[n > 0]
    order = np.argsort(key)
    return Forest(key[order], n[order], depth, top, least)


def _weights(group: pa.Table, depth: int, top: int, least: int) -> pa.Table:
    """The weights of the trees below the contexts of ``top`` bytes."""
    forest, parts = _forest(group, depth, top, least), []
    for bit in range(8):
        ids, *_, weighted = forest.decisions(bit)[0]
        parts.append((forest.nodes[0][ids >> 8], 1 << (7 - bit) | ids & 255, weighted))
    return pa.table(dict(zip(("context", "decision", "weight"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def _lengths(group: pa.Table, shared, depth: int, least: int) -> pa.Table:
    """The code lengths of the grams that are asked for."""
    top = shared.value
    asked = np.unique(group.column("key").to_numpy()[group.column("asked").to_numpy()])
    return pa.table({"key": asked, "length": _forest(group, depth, top.levels, least).lengths(asked, top, depth)})


class Scorer:
    """Code lengths of grams in a table with open addressing, at most half full."""

    EMPTY = np.uint64((1 << 64) - 1)  # no gram: those have seven bytes at most

    def __init__(self, key: np.ndarray, length: np.ndarray):
        self.bits = max(4, int(2 * len(key)).bit_length())
        self.keys, self.lengths = np.full(1 << self.bits, self.EMPTY), np.zeros(1 << self.bits, np.float32)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == self.EMPTY)
            taken, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[taken], self.lengths[taken] = key[left[own]], length[left[own]]
            more = np.ones(len(left), bool)
            more[own] = False
            left, slot = left[more], self._next(slot[more])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The code lengths; NaN for grams that the table lacks."""
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.lengths[slot], np.float32(np.nan))
        left = np.flatnonzero((held != key) & (held != self.EMPTY))
        slot = slot[left]
        while len(left):
            slot = self._next(slot)
            held = self.keys[slot]
            hit = held == key[left]
            out[left[hit]] = self.lengths[slot[hit]]
            more = ~hit & (held != self.EMPTY)
            left, slot = left[more], slot[more]
        return out

    def score(self, texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each coded text without the grams that the table lacks; and these, with their texts."""
        data, at = _framed(texts, depth)
        size = np.array([len(t) for t in texts])
        first = np.cumsum(size) - size
        key = _gram_keys(data, depth)[at - depth]
        each = self.find(key).astype(float)
        lacks = np.flatnonzero(np.isnan(each))
        each[lacks] = 0.0
        return np.add.reduceat(each, first), key[lacks], np.searchsorted(first, lacks, "right") - 1


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values.view(np.int64)))


def _scored(batches: Iterator[pa.RecordBatch], model, levels: int) -> Iterator[pa.RecordBatch]:
    scorer, hot, hot_counts, n_train, n_types, ends = model.value
    each = lambda c: np.log10((c + 1.0) / (n_train + n_types + 1.0))
    for batch, texts in _chunks(batches, "_text"):
        code = [coded(t) for t in texts]
        score, grams, text_of = scorer.score(code, levels)
        hashes = [word_hashes(t[:-1]) for t in code]
        size = np.array([len(h) for h in hashes])
        flat, doc = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), size)
        at = np.minimum(np.searchsorted(hot, flat), max(0, len(hot) - 1))
        hit = hot[at] == flat if len(hot) else np.zeros(len(flat), bool)
        base = np.bincount(doc[hit], each(hot_counts[at[hit]]), len(texts)) + each(ends)
        known = np.bincount(doc[hit], minlength=len(texts)) + int(ends > 0)
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(size + 1), pa.array(score), pa.array(np.array([len(t) for t in code])), pa.array(base), pa.array(known.astype(np.int64)), _lists(flat[~hit], doc[~hit], len(texts)), _lists(grams, text_of, len(texts))],
            [*names, "n_tokens", "_score", "_bytes", "_base", "_known", "_rest", "_grams"],
        )


def _top_tree(context: np.ndarray, byte: np.ndarray, n: np.ndarray, low: int, least: int) -> Tree:
    """The tree of the contexts of at most ``low`` bytes, from the counts of (context of low bytes, byte)."""
    parts = [(np.zeros(1, int), np.zeros(1, int), np.array([END]), np.zeros(1))] if not len(n) else []
    for d in range(low + 1 if len(n) else 0):
        own = context >> 8 * (low - d)
        _, at = np.unique(own, return_inverse=True)
        keep = (np.bincount(at, n)[at] >= least) | (d == 0)
        parts.append((np.full(int(keep.sum()), d), own[keep], byte[keep], n[keep].astype(float)))
    return Tree(*map(np.concatenate, zip(*parts, strict=True)), low)


def _hot_count(grams: DataFrame, most: int) -> int:
    """The least count that at most ``most`` grams reach: exact below 4096, else 4096 times a power of two."""
    n, step = F.col("n"), 4096
    at = F.when(n < step, n).otherwise(step * F.pow(F.lit(2), F.floor(F.log2(n / step)))).cast("long")
    total, least = 0, None
    for r in grams.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("at").desc()).collect():
        total += r["n"]
        if total > most:
            break
        least = r["at"]
    return least if least is not None else (1 << 62)


def lm_scores(df: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, least: int = LEAST_COUNT, keep: tuple[str, ...] = (), hot_words: int = HOT_WORDS, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """One row per row of df: doc_id, the columns in ``keep``, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte: the code length, in bits, over the bytes that are coded (words, spaces between them and the end).

    training: the texts (column ``text``) to learn from, whole. A null or empty text is the end token alone. Equal rows
    give equal rows. With an empty training table every byte costs the same and no token is known. The corpus's grams
    and words are counted in tasks, then summed by Spark. Every context of at least ``least`` occurrences is in the tree: the
    trees below contexts of TOP bytes are worked out in groups, which give the code length of each gram, and the few nodes
    above on the driver. Grams and words beyond the hot ones are joined. Words are counted by 64-bit hashes.
    """
    spark = df.sparkSession
    if not 1 <= depth <= 6:
        raise ValueError("depth must be from 1 to 6")
    texts = training.select(F.col(text).alias("_text"))
    counted = stored(texts.mapInArrow(partial(_count, depth=depth), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")
    grams, words = counted.filter(F.col("kind") == _GRAM), counted.filter(F.col("kind") == _WORD)
    facts = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = grams.filter(F.col("key").bitwiseAND(255) == END).agg(F.sum("n")).first()[0] or 0
    n_train, n_types = (facts["n"] or 0) + ends, facts["v"] + (1 if ends else 0)
    low = min(TOP, depth - 1)
    shift, buckets = 8 * (depth - low + 1), grams.count() // BUCKET_GRAMS + 1
    groups = lambda d: d.withColumn("bucket", F.pmod(F.xxhash64(F.shiftright("key", shift)), F.lit(buckets))).groupBy("bucket")
    pairs = grams.groupBy(F.shiftright("key", shift).alias("context"), F.col("key").bitwiseAND(255).alias("byte")).agg(F.sum("n").alias("n")).toArrow()
    weights = groups(grams.select("key", "n")).applyInArrow(lambda g: _weights(g, depth, low, least), "context long, decision long, weight double").toArrow()
    tree = _top_tree(*(pairs.column(c).to_numpy() for c in ("context", "byte", "n")), low, least)
    shared = spark.sparkContext.broadcast(Top(tree, *(weights.column(c).to_numpy() for c in ("context", "decision", "weight"))))
    lengths = lambda d: groups(d).applyInArrow(lambda g: _lengths(g, shared, depth, least), "key long, length double")
    often = lengths(grams.select("key", "n", (F.col("n") >= _hot_count(grams, hot_grams)).alias("asked"))).toArrow()
    scorer = Scorer(often.column("key").to_numpy().view(_U), often.column("length").to_numpy())
    top = words.orderBy(F.col("n").desc(), "key").limit(hot_words).select("key", "n").toArrow()
    hot, hot_counts = top.column("key").to_numpy().view(_U), top.column("n").to_numpy().astype(float)
    order = np.argsort(hot)
    least_hot = int(hot_counts.min()) if len(hot) == hot_words else 0
    model = spark.sparkContext.broadcast((scorer, hot[order], hot_counts[order], n_train, n_types, ends))
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *(F.col(k).alias(f"_keep_{k}") for k in keep))
    fields = ", ".join(f"`{n}` {t}" for n, t in d.dtypes if n != "_text")
    scored = d.mapInArrow(partial(_scored, model=model, levels=depth), f"{fields}, n_tokens long, _score double, _bytes long, _base double, _known long, _rest array<long>, _grams array<long>")
    scored = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "ctw-scores")
    unit = lambda c: F.log10((c + 1.0) / F.lit(float(n_train + n_types + 1)))
    rest = scored.select("_row", F.explode("_rest").alias("key")).groupBy("_row", "key").agg(F.count(F.lit(1)).alias("times"))
    rare = words.filter(F.col("n") <= least_hot).select(F.col("key").alias("_k"), "n") if least_hot else words.limit(0).select(F.col("key").alias("_k"), "n")
    rest = rest.join(rare, F.col("key") == F.col("_k"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = rest.groupBy(F.col("_row").alias("_r")).agg(F.sum(F.col("times") * unit(F.col("n"))).alias("_more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_seen"))
    others = scored.select("_row", F.explode("_grams").alias("key")).groupBy("_row", "key").agg(F.count(F.lit(1)).alias("times"))
    asked = scored.select(F.explode("_grams").alias("key")).distinct().select("key", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    other_lengths = lengths(grams.select("key", "n", F.lit(False).alias("asked")).unionByName(asked)).withColumnRenamed("key", "_k")
    others = others.join(other_lengths, F.col("key") == F.col("_k")).groupBy(F.col("_row").alias("_o")).agg(F.sum(F.col("times") * F.col("length")).alias("_others"))
    out = scored.drop("_rest", "_grams").join(rest, F.col("_row") == F.col("_r"), "left").join(others, F.col("_row") == F.col("_o"), "left")
    score = F.col("_score") + F.coalesce("_others", F.lit(0.0))
    return out.select(
        "doc_id", *(F.col(f"_keep_{k}").alias(k) for k in keep), "n_tokens", (F.col("_known") + F.coalesce("_seen", F.lit(0))).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score / F.log10(F.lit(2.0)) / F.col("_bytes")).alias("bits_per_byte"),
    )


def op1_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 7))
    return lm_scores(docs, docs.filter(~F.col("held_out")), keep=("held_out",))
