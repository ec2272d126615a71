"""Toxicity: averaged subword bags under a linear softmax, trained jointly in numpy.

A word is the set of its byte n-grams, with marks at both ends, and itself; its vector is the mean of their embeddings
(0 for those that tell nothing), a document's vector the mean over its words. So misspellings and unknown endings share vectors
with known words. As all is linear up to the softmax, a trained model scores a word by one number, and a document by
the mean of its words' numbers; the executors get a table of at most MAX_SUBWORDS numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_counts, as_bytes, count_sorted, give_back, gives_back, held_out, mix, table, word_hashes

DIM, GRAMS = 8, (3, 4, 5, 6)
#: The bounded sample that the model is fitted on: rows of each class, and characters of a row's text, at most.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 2500, 4000, 20_000
#: A subword is learnt if it stands in so many sample documents, its share among toxic ones exceeds that among clean
#: ones by so many standard errors and so many times; the MAX_SUBWORDS most telling are kept.
MIN_DOCUMENTS, MIN_Z, MIN_LIFT, MAX_SUBWORDS = 3, 4.5, 5.0, 1 << 16
#: Texts, and bytes of them, that are taken apart at once while fitting; no result depends on them.
FIT_TEXTS, FIT_BYTES = 256, 1 << 19
#: Bytes of words that are taken apart at once while scoring; longer words are worked through in slices. Words of more
#: than LONG bytes are not remembered.
SLICE, LONG = 1 << 18, 64
EPOCHS, BATCH, RATE, DECAY, SCALE, SEED = 20, 128, 0.05, 1e-4, 50.0, 7
THRESHOLD = 0.3
#: Words whose scores a Python worker remembers; no result depends on it.
CACHE_WORDS = 300_000
_EDGES = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_U = np.uint64
#: (sorted hashes of subwords, their scores, bias)
Model = tuple[np.ndarray, np.ndarray, float]


def _clean(word: bytes) -> bytes:
    return word.lower().strip(_EDGES) or word


def word_subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, word's position): the byte n-grams of ``<word>`` and the word itself, whatever its length, A-Z
    lower-cased and without punctuation at its ends. A word of punctuation only counts as it is."""
    clean = [_clean(w) for w in words]
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in clean), np.uint8).astype(_U)
    size = np.array([len(w) + 2 for w in clean], np.int64)
    owner = np.repeat(np.arange(len(clean)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(joined))  # bytes from here to the word's end
    keys, owners = [], []
    gram, whole = np.zeros(len(joined), _U), np.zeros(len(clean), _U)
    for n in range(1, max(GRAMS) + 1):
        fits = np.flatnonzero(left >= n)
        gram[fits] = (gram[fits] << _U(8)) | joined[fits + n - 1]
        if n in GRAMS:
            keys.append(mix(gram[fits] + _U(n << 56)))
            owners.append(owner[fits])
    np.add.at(whole, owner, mix(joined + _U(1 << 40) * (left.astype(_U) + _U(1))))
    keys.append(mix(whole ^ _U(0xABCDEF)))
    owners.append(np.arange(len(clean)))
    return np.concatenate(keys), np.concatenate(owners)


def long_subwords(word: bytes) -> Iterator[np.ndarray]:
    """The hashes of word_subwords([word]) in parts, from slices that overlap by the longest n-gram less one byte."""
    data = np.frombuffer(b"<" + _clean(word) + b">", np.uint8)
    whole = np.zeros(1, _U)
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + max(GRAMS) - 1].astype(_U)
        own = min(SLICE, len(part))
        gram = np.zeros(own, _U)
        for n in range(1, max(GRAMS) + 1):
            fits = max(0, min(own, len(part) - n + 1))
            gram[:fits] = (gram[:fits] << _U(8)) | part[n - 1 : n - 1 + fits]
            if n in GRAMS:
                yield mix(gram[:fits] + _U(n << 56))
        left = (len(data) - at - np.arange(own)).astype(_U)
        whole += mix(part[:own] + _U(1 << 40) * (left + _U(1))).sum(dtype=_U)
    yield mix(whole ^ _U(0xABCDEF))


def unlike(texts: list[bytes], low: int = 4) -> list[int]:
    """Positions of texts that share none of their smallest shingle hashes with an earlier one: near copies in the
    sample would pass their whole text off as telling."""
    seen: set[int] = set()
    out = []
    for i, t in enumerate(texts):
        h = word_hashes(t.lower())
        if len(h) >= 5:
            h = mix(h[:-4] + mix(h[1:-3] + mix(h[2:-2] + mix(h[3:-1] + mix(h[4:])))))
        least = set(np.unique(h)[:low].tolist())
        if not least & seen:
            out.append(i)
        seen |= least
    return out


def _subwords(texts: list[bytes]) -> tuple[np.ndarray, list[tuple]]:
    """The subwords of all words of the texts, word by word; and for each text its distinct words, how often each occurs
    and the number of all, with the words' places among the subwords."""
    vocabulary: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t), np.int64, len(t)) for t in split]
    keys, owners = word_subwords(list(vocabulary))
    keys, size = keys[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(vocabulary))
    start = np.cumsum(size) - size
    return keys, [(*np.unique(w, return_counts=True), max(1, len(w)), start, size) for w in ids]


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of at most FIT_TEXTS texts and, beyond one text, FIT_BYTES bytes."""
    at = 0
    while at < len(texts):
        size, end = len(texts[at]), at + 1
        while end < min(len(texts), at + FIT_TEXTS) and size + len(texts[end]) <= FIT_BYTES:
            size, end = size + len(texts[end]), end + 1
        yield at, end
        at = end


def _spread(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all subwords of the words."""
    n = size[words]
    return np.repeat(start[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def train(texts: list[bytes], toxic: np.ndarray, prior: float | None = None, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Embeddings of the telling subwords and a softmax over two classes, fitted jointly with Adam. Classes are weighed
    so that toxic rows have the share ``prior``. With one class only, no subword is learnt and the bias gives the share."""
    chosen = unlike(texts)
    texts, y = [texts[i] for i in chosen], np.asarray(toxic, np.int64)[chosen]
    share = float(y.mean()) if len(y) else 0.0
    prior = min(max(share if prior is None else prior, 1e-4), 1 - 1e-4)
    none = np.empty(0, _U), np.empty(0), float(np.log(prior / (1 - prior)))
    if not 0 < share < 1:
        return none
    n, n1 = len(y), int(y.sum())
    everywhere, in_toxic = [], []
    for at, end in _parts(texts):  # in parts, counted at once, so that the driver never holds all subwords of all words or texts
        keys, docs = _subwords(texts[at:end])
        own = [np.unique(keys[_spread(w, start, size)]) for w, _, _, start, size in docs]
        everywhere.append(count_sorted(np.concatenate(own)))
        in_toxic.append(count_sorted(np.concatenate([np.empty(0, _U), *(k for k, bad in zip(own, y[at:end], strict=True) if bad)])))
        if len(everywhere) == 8:
            everywhere, in_toxic = [add_counts(everywhere)], [add_counts(in_toxic)]
    del keys, docs, own
    (known, there), (bad_keys, bad_counts) = add_counts(everywhere), add_counts(in_toxic)
    everywhere = in_toxic = None
    bad = np.zeros(len(known))
    bad[np.searchsorted(known, bad_keys)] = bad_counts
    p, high, low = there / n, bad / n1, (there - bad) / (n - n1)
    z = (high - low) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / (n - n1)))
    telling = np.flatnonzero((there >= MIN_DOCUMENTS) & (z >= MIN_Z) & (high >= MIN_LIFT * low))
    subwords = known[np.sort(telling[np.argsort(-z[telling], kind="stable")[:MAX_SUBWORDS]])]
    if not len(subwords):
        return none
    rows = []
    for at, end in _parts(texts):
        keys, docs = _subwords(texts[at:end])
        column = np.minimum(np.searchsorted(subwords, keys), len(subwords) - 1)
        kept = subwords[column] == keys
        for w, times, words, start, size in docs:
            own = _spread(w, start, size)
            part = np.repeat(SCALE * times / size[w] / words, size[w])
            rows.append((column[own][kept[own]], part[kept[own]]))
    rng = np.random.Generator(np.random.PCG64(seed))
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    E, W, b = rng.uniform(-1 / DIM, 1 / DIM, (len(subwords), DIM)), rng.normal(0, 0.5, (DIM, 2)), np.array([np.log(1 - prior), np.log(prior)])
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (E, W, b)]
    step, steps = 0, epochs * -(-n // BATCH)
    sums = lambda values, at, size: np.stack([np.bincount(at, values[:, d], size) for d in range(DIM)], 1)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            batch = order[at : at + BATCH]
            sub, part = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])[:, None]
            doc = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            H = sums(E[sub] * part, doc, len(batch))
            Z = H @ W + b
            P = np.exp(Z - Z.max(1, keepdims=True))
            P /= P.sum(1, keepdims=True)
            G = (P - np.eye(2)[y[batch]]) * (weight[batch] / len(batch))[:, None]
            grads = sums((G @ W.T)[doc] * part, sub, len(subwords)) + DECAY * E, H.T @ G, G.sum(0)
            rate, step = RATE * (1 - step / steps), step + 1
            for x, g, (m, v) in zip((E, W, b), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return subwords, SCALE * (E @ (W[:, 1] - W[:, 0])), float(b[1] - b[0])


class Scorer:
    def __init__(self, subwords: np.ndarray, scores: np.ndarray, bias: float):
        self.subwords, self.scores, self.bias, self.cache = subwords, scores, bias, {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        group, size = [], 0
        for w in new:
            if len(w) > SLICE:
                total = n = 0
                for keys in long_subwords(w):
                    total, n = total + float(self._known(keys).sum()), n + len(keys)
                self.cache[w] = total / n
                continue
            if size + len(w) > SLICE:
                self._learn(group)
                group, size = [], 0
            group.append(w)
            size += len(w)
        if group:
            self._learn(group)

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.subwords):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.subwords, keys), len(self.subwords) - 1)
        return np.where(self.subwords[at] == keys, self.scores[at], 0.0)

    def _learn(self, new: list[bytes]) -> None:
        keys, owners = word_subwords(new)
        total = np.bincount(owners, self._known(keys), len(new))
        self.cache.update(zip(new, (total / np.bincount(owners, minlength=len(new))).tolist(), strict=True))

    def scores_of(self, texts: list[bytes]) -> list[float]:
        """Probabilities of class 1."""
        split = [t.split() for t in texts]
        distinct = set().union(*split)
        self.learn(distinct)
        logits = [self.bias + sum(map(self.cache.__getitem__, w)) / max(1, len(w)) for w in split]
        for w in distinct:
            if len(w) > LONG:
                del self.cache[w]
        return [1 / (1 + math.exp(-min(max(x, -60), 60))) for x in logits]


@gives_back
def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(*model.value)
    for batch in batches:
        found = [p for at in range(0, batch.num_rows, 256) for p in scorer.scores_of(as_bytes(batch.column("_text").slice(at, 256)))]
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.float64())], [*names, "score"])


def training_sample(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", parts: int = 4) -> DataFrame:
    """(text, toxic) of at most MAX_TOXIC + MAX_CLEAN labelled rows that are not held out, in pseudorandom order of
    their ids. Texts of more than MAX_CHARS characters and null texts or labels are not used for fitting."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~held_out("doc_id", parts))
    docs = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).filter(F.length("text") <= MAX_CHARS)
    pairs = docs.select("_id").join(known, F.col("_id") == F.col("doc_id")).select("doc_id", "toxic")
    pick = lambda k, n: pairs.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, MAX_TOXIC).unionByName(pick(0, MAX_CLEAN)).distinct()
    return docs.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(MAX_TOXIC + MAX_CLEAN)


def toxicity(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", parts: int = 4, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns in ``keep``, one row per input row.

    The model is fitted on the driver on training_sample(), and broadcast as at most MAX_SUBWORDS numbers whatever the
    input's size. Whole texts are scored; a null or empty text gets the bias's score. Without labels, every score is low.
    """
    spark = df.sparkSession
    rows = training_sample(df, labels, doc_id, text, label, parts).select("text", "toxic").toArrow()
    toxic = np.array(rows.column("toxic").to_pylist(), np.int64)
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(doc_id, parts))
    prior = usable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    texts = as_bytes(rows.column("text"))
    del rows
    model = spark.sparkContext.broadcast(train(texts, toxic, prior))
    del texts
    give_back()  # the driver goes on with other work
    d = df.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, parts).alias("held_out"), F.col(text).alias("_text"), *(F.col(k).alias(f"_keep_{k}") for k in keep))
    fields = ", ".join(f"`{n}` {t}" for n, t in d.dtypes if n != "_text")
    d = d.mapInArrow(partial(_score, model=model), f"{fields}, score double")
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "held_out", "score", "predicted", *(F.col(f"_keep_{k}").alias(k) for k in keep))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
