"""Search for exact terms: one automaton over all questions' terms, stepped through each text once.

The time for a text follows its length and its hits, not the number of terms. Terms go to the tasks in batches of a bounded
number of bytes; a task builds its automaton once. Texts are never shuffled, and each batch of texts sends on a question's
best only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import exact_terms, search_text

CANDIDATES = 20
#: Characters of the terms, and pairs of question and term, in one batch of questions; texts that are scored at once.
TERM_CHARS, TERM_ROWS, TEXTS = 4_000_000, 1_000_000, 1024
_BUILT: dict[str, ahocorasick.Automaton] = {}


class _Terms:
    """Distinct terms, and the questions that have each."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.key = uuid.uuid4().hex
        self.terms = sorted({t for _, t in rows})
        place = {t: i for i, t in enumerate(self.terms)}
        pairs = np.array(sorted((place[t], q) for q, t in set(rows)), np.int64).reshape(-1, 2)
        self.questions = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))

    def automaton(self) -> ahocorasick.Automaton:
        """The automaton over the terms: built once in each worker."""
        if self.key not in _BUILT:
            _BUILT.clear()
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, t in enumerate(self.terms):
                made.add_word(t, i)
            made.make_automaton()
            _BUILT[self.key] = made
        return _BUILT[self.key]

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, place of the text, number of its terms that the text holds)."""
        automaton, term, row = self.automaton(), [], []
        for i, t in enumerate(texts):
            own = {x for _, x in automaton.iter(t)}
            term += own
            row += [i] * len(own)
        at = np.array(term, np.int64)
        size = self.starts[at + 1] - self.starts[at]
        flat = np.repeat(self.starts[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair = np.stack((self.questions[flat], np.repeat(np.array(row, np.int64), size)), 1)
        own, n = np.unique(pair, axis=0, return_counts=True)
        return own[:, 0], own[:, 1], n


def _hits(batches: Iterator[pa.RecordBatch], shared, k: int | None) -> Iterator[pa.RecordBatch]:
    terms = shared.value
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS):
            part = batch.slice(start, TEXTS)
            question, place, n = terms.found(part.column(1).to_pylist())
            ids = part.column(0).to_numpy()[place]
            order = np.lexsort((ids, -n, question))
            question, ids, n = question[order], ids[order], n[order]
            if k is not None and len(question):
                first = np.flatnonzero(np.concatenate(([True], question[1:] != question[:-1])))
                keep = np.arange(len(question)) - np.repeat(first, np.diff(np.append(first, len(question)))) < k
                question, ids, n = question[keep], ids[keep], n[keep]
            yield pa.RecordBatch.from_arrays([pa.array(question), pa.array(ids), pa.array(n.astype(float))], ["query_id", "id", "score"])


def _batches(terms: DataFrame, chars: int, pairs: int) -> Iterator[_Terms]:
    """Batches of whole questions: terms (query_id, terms array<string>)."""
    rows, size = [], 0
    for r in terms.toLocalIterator():
        own = [(r["query_id"], t) for t in r["terms"]]
        more = sum(len(t) for _, t in own)
        if rows and (size + more > chars or len(rows) + len(own) > pairs):
            yield _Terms(rows)
            rows, size = [], 0
        rows += own
        size += more
    if rows:
        yield _Terms(rows)


def holding(terms: DataFrame, chunks: DataFrame, k: int | None = None, chars: int = TERM_CHARS, pairs: int = TERM_ROWS) -> DataFrame:
    """(query_id, id, score): the chunks (id, text) whose search text holds a question's terms (query_id, terms), and how many of
    them; of each batch of texts the k best, if k is given, ties by id. A question's terms count once each. Null ids and
    texts, and empty terms, match nothing."""
    texts = chunks.select(F.col("id").cast("long").alias("id"), "text").filter("id IS NOT NULL AND text IS NOT NULL").select("id", search_text(F.col("text")).alias("t"))
    own = terms.select("query_id", F.array_remove(F.array_distinct("terms"), "").alias("terms")).filter("size(terms) > 0")
    out = None
    for batch in _batches(own, chars, pairs):
        found = texts.mapInArrow(partial(_hits, shared=chunks.sparkSession.sparkContext.broadcast(batch), k=k), "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    return chunks.sparkSession.createDataFrame([], "query_id long, id long, score double") if out is None else out


def question_terms(text: Column) -> Column:
    """The exact terms of a question, as phrases: quotation marks and backslashes in them are spaces."""
    phrases = F.transform(exact_terms(search_text(text)), lambda t: F.translate(t, '"\\', "  "))
    return F.filter(phrases, lambda t: F.length(t) >= 2)
