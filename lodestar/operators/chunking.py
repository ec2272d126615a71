"""Chunks of documents: pages joined, cut along structure, packed to a token budget.

Pages are joined natively, one row per document; each document is then cut inside an Arrow batch. A text's token costs are
prefix sums, so that any range is priced in constant time and a document of n characters takes about n steps.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.structure import ARTICLE, CHAPTER, HEADING
from lodestar.functions.text import CJK

#: Unit ends by level: blank lines, lines, sentences; below them single characters (fixed values).
_ENDS = tuple(map(re.compile, (r"\n[ \t]*\n\s*", r"\n", r"[。！？；!?;]+[」』）)\"']*")))
_WIDE, _ARTICLE, _CHAPTER, _HEADING = map(re.compile, (CJK, ARTICLE, CHAPTER, HEADING))
_SENTENCE_SIGN = re.compile(r"[。！？；，,.!?;]")
#: White space that chunks and titles lose at their ends, and the longest title beside an article's number (fixed values).
BLANK, TITLE_CHARS = " \t\n\r\0\x0b", 20
CHUNK = "doc_id long, chunk_index long, content string, char_count long, token_count long, page_start long, page_end long, section string, chunk_strategy string"
#: Chunks that a task holds before it sends them on.
SENT = 2000

Span = tuple[int, int]


@dataclass(frozen=True)
class Budget:
    """Token limits. overlap: the share of ``most`` that a chunk may repeat of the one before it."""

    most: int = 600
    overlap: float = 0.15
    least: int = 80
    wide: float = 1.0
    other: float = 0.3

    @property
    def overlap_tokens(self) -> int:
        return math.floor(self.most * self.overlap)

    def label(self, strategy: str) -> str:
        return f"{strategy}_{'v2' if strategy == 'structure' else 'v1'}:max{self.most}:ov{round(100 * self.overlap)}"


class Packer:
    """Cuts ranges of one text. Offsets are code points."""

    def __init__(self, text: str, budget: Budget, overlap_tokens: int | None = None):
        self.text, self.budget = text, budget
        self.overlap = budget.overlap_tokens if overlap_tokens is None else overlap_tokens
        wide = {m.start() for m in _WIDE.finditer(text)}
        self.wide = [0, *itertools.accumulate(1 if i in wide else 0 for i in range(len(text)))]

    def cost(self, a: int, b: int) -> int:
        wide = self.wide[b] - self.wide[a]
        return math.ceil(wide * self.budget.wide + (b - a - wide) * self.budget.other)

    def _unit_ends(self, a: int, b: int, level: int) -> list[int]:
        ends = [a + m.end() for m in _ENDS[level].finditer(self.text[a:b])]
        return ends if ends and ends[-1] == b else [*ends, b]

    def pack(self, a: int, b: int, level: int = 0) -> list[Span]:
        """Units of the level, as many to a chunk as fit. A unit too long for a chunk goes a level down, and takes what waits
        before it along; so does a unit that would leave too little waiting alone. Below paragraphs, chunks overlap."""
        if self.cost(a, b) <= self.budget.most:
            return [(a, b)]
        if level == len(_ENDS):
            return self.hard(a, b)
        out: list[Span] = []
        start = at = a  # the waiting chunk is start..at
        for end in self._unit_ends(a, b, level):
            fits = self.cost(start, end) <= self.budget.most
            if self.cost(at, end) > self.budget.most or not fits and at > start and self.cost(start, at) < self.budget.least:
                out += self.pack(start, end, level + 1)
                start = end
            elif not fits:
                out.append((start, at))
                start = self._tail(start, at, end) if level else at
            at = end
        return out + [(start, at)] * (at > start)

    def _tail(self, a: int, b: int, end: int) -> int:
        """Where the next chunk, up to ``end``, starts: before b by the whole sentences at the end of a..b that both limits allow."""
        best = b
        for s in reversed([a, *self._unit_ends(a, b, 2)[:-1]]):
            if self.cost(s, b) > self.overlap or self.cost(s, end) > self.budget.most:
                break
            best = s
        return best if best > a else b

    def hard(self, a: int, b: int) -> list[Span]:
        """Windows of as many characters as fit; the next goes back as far as the overlap allows, but always on."""
        out = []
        while True:
            end = bisect.bisect_right(range(b + 1), self.budget.most, lo=a + 1, hi=b + 1, key=lambda e: self.cost(a, e)) - 1
            end = min(b, max(end, a + 1))
            out.append((a, end))
            if end >= b:
                return out
            back = bisect.bisect_left(range(end), True, lo=a, hi=end, key=lambda s: self.cost(s, end) <= self.overlap)
            a = min(end, max(a + 2, back))

    def merged_tail(self, spans: list[Span]) -> list[Span]:
        """A last chunk below the least size joins the one before it where both fit."""
        if len(spans) > 1 and self.cost(*spans[-1]) < self.budget.least and self.cost(spans[-2][0], spans[-1][1]) <= self.budget.most:
            return [*spans[:-2], (spans[-2][0], spans[-1][1])]
        return spans


def trimmed(text: str, a: int, b: int) -> Span | None:
    part = text[a:b]
    left = len(part) - len(part.lstrip(BLANK))
    return None if left == len(part) else (a + left, a + len(part.rstrip(BLANK)))


def _one_space(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def segments(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, section): a chapter's line ends a segment and stands in none; an article's or heading's line starts one.
    Lines between code fences start none. A segment that is a Markdown heading alone is left out."""
    out: list[tuple[int, int, str | None]] = []
    chapter = article = None
    headings: dict[int, str] = {}
    begin, at, fenced = None, 0, False

    def end_at(place: int) -> None:
        nonlocal begin
        if begin is not None and place > begin:
            names = [x for x in (chapter, article, *headings.values()) if x]
            if span := trimmed(text, begin, place):
                if "\n" in text[slice(*span)] or not _HEADING.match(text[slice(*span)]):
                    out.append((*span, " / ".join(names) or None))
        begin = None

    for line in text.split("\n"):
        fenced ^= line.lstrip(BLANK).startswith("```")
        if not fenced and _CHAPTER.match(line):
            end_at(at)
            chapter, article = _one_space(line), None
        elif not fenced and (m := _ARTICLE.match(line)):
            end_at(at)
            title = line[m.end() :].strip(BLANK)
            named = 0 < len(title) <= TITLE_CHARS and not _SENTENCE_SIGN.search(title)
            article, begin = _one_space(m[1]) + (f" {title}" if named else ""), at
        elif not fenced and (m := _HEADING.match(line)):
            end_at(at)
            level = len(m[1]) - 1
            headings = dict(itertools.islice(headings.items(), level))
            headings.setdefault(level, m[2].strip(BLANK))
            begin = at
        elif begin is None:
            begin = at
        at += len(line) + 1
    end_at(len(text))
    return out


def chunk_spans(text: str, strategy: str, budget: Budget) -> list[tuple[int, int, str | None]]:
    """(start, end, section) of a text's chunks, trimmed; blank ones are left out."""
    packer = Packer(text, budget)
    if strategy == "fixed":
        found = [(*s, None) for s in packer.merged_tail(packer.hard(0, len(text)))] if text else []
    elif strategy == "structure":
        parts = segments(text)
        if len(parts) > 1 and parts[0][2] is None and packer.cost(*parts[0][:2]) < budget.least:
            parts[:2] = [(parts[0][0], parts[1][1], parts[1][2])]  # a short preamble belongs to what follows
        found = [(*s, section) for a, b, section in parts for s in packer.merged_tail(packer.pack(a, b))]
    elif strategy == "recursive":
        found = [(*s, None) for s in packer.merged_tail(packer.pack(0, len(text)))] if text else []
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return [(*span, section) for a, b, section in found if (span := trimmed(text, a, b))]


def assembled(pages: DataFrame) -> DataFrame:
    """(doc_id, text, pages array<struct<page, start>>): pages in order, joined by line ends, without empty ones at the start.
    Empty pages have no place in ``pages``. Null texts are empty; null ids are left out. A document is one row."""
    d = pages.filter("doc_id IS NOT NULL").select("doc_id", F.col("page").cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    first = F.coalesce(F.get(F.filter(F.transform("p", lambda x, i: F.when(x["text"] != "", i)), lambda i: i.isNotNull()), F.lit(0)), F.size("p"))
    d = d.withColumn("p", F.slice("p", first + 1, F.size("p")))
    starts = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<page:long,start:long>>").alias("out")), lambda s, x: F.struct(
        (s["at"] + F.char_length(x["text"]) + 1).alias("at"), F.when(x["text"] != "", F.array_append(s["out"], F.struct(x["page"].alias("page"), s["at"].alias("start")))).otherwise(s["out"]).alias("out")))
    return d.select("doc_id", F.array_join("p.text", "\n").alias("text"), starts["out"].alias("pages"))


def page_at(pages, offset):
    """The page of an offset: the last that starts at or before it; the first if none does; 1 without pages."""
    return F.coalesce(F.element_at(F.filter(pages, lambda p: p["start"] <= offset), -1)["page"], F.get(pages, F.lit(0))["page"], F.lit(1).cast("long"))


def pages_at(offsets: DataFrame, pages: DataFrame, span: int = 1 << 20) -> DataFrame:
    """offsets (doc_id, at, ...) with page: page_at() where the pages (doc_id, page, start) are rows, however many a document
    has. Offsets and starts are sorted together, within stretches of ``span`` characters, and the last page before a stretch is
    carried into it; so neither is paired with the other, and a long document is many groups. Null ids have page 1."""
    keys = ["doc_id", "_stretch"]
    stretch = lambda c: F.floor(F.col(c) / span).alias("_stretch")
    p = pages.filter("doc_id IS NOT NULL").select("doc_id", "page", "start", stretch("start"))
    o = offsets.withColumn("_stretch", F.floor(F.col("at") / span)).withColumn("_row", F.struct(*offsets.columns))
    both = o.select("doc_id", "_stretch", F.col("at").alias("_pos"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("page"), "_row").unionByName(
        p.select("doc_id", "_stretch", F.col("start").alias("_pos"), F.lit(0).alias("_kind"), F.col("page").cast("long").alias("page")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_here", F.last("page", ignorenulls=True).over(w)).filter("_kind = 1")
    ends = p.groupBy(*keys).agg(F.max_by("page", "start").cast("long").alias("_end")).unionByName(o.filter("doc_id IS NOT NULL").select(*keys).distinct(), allowMissingColumns=True)
    ends = ends.groupBy(*keys).agg(F.max("_end").alias("_end"))
    before = Window.partitionBy("doc_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    first = p.groupBy("doc_id").agg(F.min_by("page", "start").cast("long").alias("_first"))
    found = found.join(carried, keys, "left").join(first, "doc_id", "left")
    return found.select("_row.*", F.coalesce("_here", "_carried", "_first", F.lit(1).cast("long")).alias("page"))


def _page(starts: list[int], numbers: list[int], offset: int) -> int:
    return numbers[max(0, bisect.bisect_right(starts, offset) - 1)] if numbers else 1


def chunk_documents(texts: DataFrame, strategy: str = "structure", budget: Budget = Budget()) -> DataFrame:
    """Chunks of assembled() texts, numbered from 0 without gaps. Equal rows give equal chunks. Narrow: no shuffle."""
    label = budget.label(strategy)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNK.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in CHUNK.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        for batch in batches:
            rows = []
            for doc_id, text, pages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts, numbers = [p["start"] for p in pages or ()], [p["page"] for p in pages or ()]
                packer = Packer(text or "", budget)
                for i, (a, b, section) in enumerate(chunk_spans(text or "", strategy, budget)):
                    rows.append((doc_id, i, text[a:b], b - a, packer.cost(a, b), _page(starts, numbers, a), _page(starts, numbers, max(a, b - 1)), section, label))
                    if len(rows) == SENT:
                        yield made(rows)
                        rows = []
            yield made(rows)

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "pages").mapInArrow(cut, CHUNK)
