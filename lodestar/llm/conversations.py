"""Conversation structure repair: rank-convergence parallel Viterbi over the turns' roles.

A repaired conversation's role initials are ``(s?(ua)+)?``: a machine of four states (nothing yet, behind the system turn,
behind a user, behind an assistant). The least cost to finish from each state is a vector that is carried backward over the
turns. A conversation is cut into chunks of turns, and every chunk but its last starts from a vector that is only guessed.
Where a chunk's vector on the left is not its neighbour's on the right, but for a constant, that chunk is run again from
its neighbour's, beside the old run, until the two vectors differ only by a constant; passes end when no chunk changes.
Then each chunk knows its vector, and the edits are traced forward along the stitched costs, taking the least letter that
keeps to the least cost. Vectors less their minimum are few, so a step from one to the next is looked up.

Turns that must be deleted cost the same from every state and are left out of the vectors. Conversations are ordered over
ranges, so that neither sorting nor the vectors gather one. Only the last step, tracing with one SHA-256 over a whole
conversation, streams each conversation through one task, as its result asks for; it holds a chunk and the audit in memory.

Nulls are one space; null turns come first, and a null conv_id is a conversation. Rows of equal turn go by role, then by a
digest of role and text. Repeated rows are duplicates. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc_sql, gives_back, ordered, stored, table

#: Turns in a chunk.
CHUNK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or new role leads to, from each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Where a kept turn leads, by its initial and the state before it.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The costs to finish behind the last turn, and what chunks start from before they know better.
END, GUESS = (0, 4, 2, 0), (0, 0, 2, 0)
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"

Vector = tuple[int, int, int, int]
_STEPS: dict[tuple[Vector, str], tuple[Vector, int]] = {}


def closed(v: list[int]) -> Vector:
    """The costs with insertions allowed before."""
    u, a = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + u), min(v[SYSTEM], INSERT + u), u, a


def step(after: Vector, code: str) -> tuple[Vector, int]:
    """The vector before a turn, less its minimum, and that minimum. code: the role's initial, in capitals if the turn is
    truncated; anything else for other roles (``x``, ``X``)."""
    if (after, code) not in _STEPS:
        more = TRUNCATED * code.isupper()
        kept = KEPT.get(code.lower(), {})
        v = closed([min(DELETE + after[s], REROLE + more + after[NEXT[s]], *([KEEP + more + after[kept[s]]] if s in kept else [])) for s in range(4)])
        least = min(v)
        _STEPS[after, code] = tuple(x - least for x in v), least
    return _STEPS[after, code]


def backward(right: Vector, codes: str) -> tuple[Vector, int]:
    """The vector on the left of a chunk, less its minimum, and the sum of what was taken off."""
    total = 0
    for code in reversed(codes):
        right, more = step(right, code)
        total += more
    return right, total


def rerun(old: Vector, new: Vector, codes: str) -> Vector | None:
    """The left vector of a chunk that starts from ``new``; None as soon as it runs as from ``old``."""
    for code in reversed(codes):
        if new == old:
            return None
        old, new = step(old, code)[0], step(new, code)[0]
    return None if new == old else new


def trace(state: int, right: Vector, codes: str) -> tuple[list[str], int]:
    """The least letters before and at each turn of a chunk, from a state; and the state behind them."""
    vectors = [(right, 0)]
    for code in reversed(codes):
        vectors.append(step(vectors[-1][0], code))
    out = []
    for code, (after, _), (before, least) in zip(codes, vectors[-2::-1], vectors[:0:-1], strict=True):
        letters = ""
        more, kept = TRUNCATED * code.isupper(), KEPT.get(code.lower(), {})
        while True:
            cost = before[state] + least
            if DELETE + after[state] == cost:
                letters += "D"
            elif INSERT + before[NEXT[state]] == before[state]:
                letters += "I"
                state = NEXT[state]
                continue
            elif state in kept and KEEP + more + after[kept[state]] == cost:
                letters, state = letters + "K", kept[state]
            else:
                letters, state = letters + "R", NEXT[state]
            break
        out.append(letters)
    return out, state


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its
    ``.!?`` away, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20
    d = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    said = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("_copies"))
    return d.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "_copies"))).drop("col")


def chunked(rows: DataFrame, size: int) -> DataFrame:
    """The turns that may stay, as chunks (first, after, chained, at, codes): the places of the chunk's first turn and of the
    next chunk's; ``chained`` where a conversation has more than one. rows (conv_id, _at, blank, code, said)."""
    firsts = rows.groupBy("conv_id", "said").agg(F.min("_at").alias("_at")).select("_at")
    live = rows.filter("not blank").join(firsts, "_at", "left_semi")
    pieces = live.groupBy("conv_id", F.shiftright("_at", 33).alias("_range")).agg(F.sort_array(F.collect_list(F.struct("_at", "code"))).alias("turns")).withColumn("first", F.col("turns")[0]["_at"])
    w = Window.partitionBy("conv_id").orderBy("first")
    links = pieces.select("first", F.lead("first").over(w).alias("after"), F.lag("first").over(w).isNotNull().alias("later"))
    pieces = pieces.join(links, "first").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / size).cast("int"))))
    own = F.slice("turns", F.col("k") * size + 1, F.lit(size))
    following = F.get(F.col("turns"), (F.col("k") + 1) * size)
    d = pieces.select("conv_id", own.alias("own"), F.coalesce(following["_at"], F.col("after")).alias("after"), (F.col("later") | (F.col("k") > 0)).alias("later"))
    at = F.transform("own", lambda t: t["_at"])
    return d.select("conv_id", at[0].alias("first"), "after", (F.col("later") | F.col("after").isNotNull()).alias("chained"), at.alias("at"), F.array_join(F.transform("own", lambda t: t["code"]), "").alias("codes"))


_STATE = "first long, after long, start array<int>, left array<int>"


def _first_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, after, codes = (c.to_pylist() for c in batch.columns)
        start = [END if a is None else GUESS for a in after]
        yield _state(first, after, start, [backward(v, c)[0] for v, c in zip(start, codes, strict=True)])


def _next_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, after, start, left, given, codes = (c.to_pylist() for c in batch.columns)
        found = [rerun(tuple(v), tuple(g), c) for v, g, c in zip(start, given, codes, strict=True)]
        yield _state(first, after, given, [x if x is not None else y for x, y in zip(found, left, strict=True)])


def _state(first, after, start, left) -> pa.RecordBatch:
    kind = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(after, pa.int64()), pa.array(start, kind), pa.array(left, kind)], ["first", "after", "start", "left"])


def converged(chunks: DataFrame, stats: dict | None = None) -> DataFrame:
    """(first, start) of the chained chunks: the vector that each starts from, on its right. A pass reruns the chunks whose
    neighbour on the right came to another vector; each cuts the lineage. Vectors of most turns forget where they started
    within a few turns, so two passes are usual; turns of roles that fit nowhere may take one for each chunk."""
    chained = chunks.filter("chained")
    state = stored(chained.select("first", "after", "codes").mapInArrow(_first_run, _STATE), "vectors")
    passes = 0
    while True:
        given = state.select(F.col("first").alias("after"), F.col("left").alias("given"))
        stale = state.join(given, "after").filter("given <> start").select("first", "after", "start", "left", "given")
        again = stored(stale.join(chained.select("first", "codes"), "first").select("first", "after", "start", "left", "given", "codes").mapInArrow(_next_run, _STATE), "vectors")
        if again.isEmpty():
            break
        passes += 1
        state = stored(state.join(again.select("first"), "first", "left_anti").unionByName(again), "vectors")
    if stats is not None:
        stats["passes"] = passes
    return state.select("first", "start")


@gives_back
def _repaired(batches: Iterator[pa.RecordBatch], kind: pa.DataType, with_text: bool) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from its rows in order: a head, then chunks, each before its first turn, and turns."""
    done: list[tuple] = []
    one = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string(), *([pa.string()] if with_text else [])]
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", *(["repaired"] if with_text else [])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in batches:
        for what, conv_id, turn, role, text, blank, at, codes, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if what == 0:
                if one is not None:
                    done.append(one.row())
                one = _Conversation(conv_id, with_text)
            elif what == 1:
                one.chunk(at, codes, tuple(start))
            else:
                one.turn(at[0], turn, role, text, blank)
        if len(done) >= 1000:
            yield batch_of(done)
            done = []
    if one is not None:
        done.append(one.row())
    if done:
        yield batch_of(done)


class _Conversation:
    def __init__(self, conv_id, with_text: bool) -> None:
        self.conv_id, self.state, self.audit, self.sha, self.text = conv_id, START, [], hashlib.sha256(), [] if with_text else None
        self.pending: dict[int, tuple[str, bool]] = {}
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.lines = self.turns = 0
        self.low = self.high = self.initial = None

    def chunk(self, at: list[int], codes: str, start: Vector) -> None:
        letters, _ = trace(self.state, start, codes)
        self.pending = {i: (x, code.isupper()) for i, x, code in zip(at, letters, codes, strict=True)}

    def said(self, role: bytes, text: bytes) -> None:
        line = (b"\n" if self.lines else b"") + role + b":" + text
        self.lines += 1
        self.sha.update(line)
        if self.text is not None:
            self.text.append(line)

    def edit(self, letter: str, role: str, text: bytes) -> None:
        self.audit.append(letter)
        if letter == "D":
            self.cost += DELETE
        elif letter == "K":
            self.state = KEPT[role[:1]][self.state]
            self.said(role.encode(), text)
        else:
            self.cost += INSERT if letter == "I" else REROLE
            self.state = NEXT[self.state]
            self.said(b"user" if self.state == USER else b"assistant", b"" if letter == "I" else text)

    def turn(self, at: int, turn: int | None, role: str, text: bytes, blank: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if at in self.pending:
            letters, truncated = self.pending.pop(at)
            self.truncated += truncated
            for x in letters:
                self.edit(x, role, text)
            self.cost += TRUNCATED * (truncated and letters[-1] != "D")
        else:
            self.blank += blank
            self.duplicate += not blank
            self.edit("D", role, text)

    def row(self) -> tuple:
        while END[self.state]:
            self.edit("I", "", b"")
        gaps = self.high - self.low + 1 - self.turns if self.high is not None else 0
        text = () if self.text is None else (b"".join(self.text).decode("utf-8", "replace"),)
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest(), *text


def repair(rows: DataFrame, conversations: DataFrame, size: int = CHUNK, with_text: bool = False, stats: dict | None = None) -> DataFrame:
    """A row for each conv_id in ``conversations``: gaps, counts of faults, cost, audit and repaired_sha256 (and the repaired
    text). rows (conv_id, turn, role, text), without nulls in role and text."""
    kind = dict(rows.dtypes)["conv_id"]
    tail = F.rtrim(F.col("text"), F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    d = rows.select("conv_id", "turn", "role", "text", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("said"), (tail == "").alias("blank"), F.when(F.right(tail, F.lit(1)).isin(".", "!", "?"), code).otherwise(F.upper(code)).alias("code"))
    d = ordered(d, ["conv_id", "turn", "role", "said"], "turns")
    chunks = stored(chunked(d.select("conv_id", "_at", "blank", "code", "said"), size), "chunks")
    vectors = converged(chunks, stats)
    none = lambda t: F.lit(None).cast(t)
    end = F.array(*(F.lit(x) for x in END))
    heads = conversations.select("conv_id").distinct()
    parts = [
        heads.select(F.lit(0).alias("what"), "conv_id", F.lit(-1).cast("long").alias("_at"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("boolean").alias("blank"), none("array<long>").alias("at"), none("string").alias("codes"), none("array<int>").alias("start")),
        chunks.join(vectors, "first", "left").select(F.lit(1).alias("what"), "conv_id", F.col("first").alias("_at"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("boolean").alias("blank"), "at", "codes", F.coalesce("start", end).alias("start")),
        d.select(F.lit(2).alias("what"), "conv_id", "_at", "turn", "role", "text", "blank", F.array("_at").alias("at"), none("string").alias("codes"), none("array<int>").alias("start")),
    ]
    all_rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition("conv_id").sortWithinPartitions("conv_id", "_at", "what")
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string" + (", repaired string" if with_text else "")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return all_rows.select("what", "conv_id", "turn", "role", F.col("text").cast("binary").alias("text"), "blank", "at", "codes", "start").mapInArrow(partial(_repaired, kind=arrow, with_text=with_text), schema)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return repair(damaged(c), c)


_OPTION = "CASE WHEN {when} THEN {{'c': {cost} + {to}.c, 'a': '{letter}' || {to}.a, 't': {text}}} END"


def _sql_options() -> str:
    """The least (cost, audit, text) before a row, from each state; insertions are added behind."""
    names, out = ("s0", "s1", "su", "sa"), []
    line = lambda role, to: f"{role} || ':' || text || CASE WHEN {to}.t = '' THEN '' ELSE chr(10) || {to}.t END"
    for state in range(4):
        after = f"w.{names[state]}"
        options = [_OPTION.format(when="true", cost=DELETE, letter="D", to=after, text=f"{after}.t")]
        for letter, moves in KEPT.items():
            if state in moves:
                to = f"w.{names[moves[state]]}"
                options.append(_OPTION.format(when=f"NOT forced AND left(role, 1) = '{letter}'", cost="more", letter="K", to=to, text=line("role", to)))
        to = f"w.{names[NEXT[state]]}"
        options.append(_OPTION.format(when="NOT forced", cost=f"{REROLE} + more", letter="R", to=to, text=line("'user'" if NEXT[state] == USER else "'assistant'", to)))
        out.append(f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1] AS {names[state]}")
    return ", ".join(out)


def _sql_insert(state: str, to: str, role: str) -> str:
    return f"list_sort([{state}, {{'c': {INSERT} + {to}.c, 'a': 'I' || {to}.a, 't': '{role}:' || CASE WHEN {to}.t = '' THEN '' ELSE chr(10) || {to}.t END}}])[1]"


_CHARS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc_table),
b AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, (VALUES (1), (2)) v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, {_CHARS}) AS tail FROM b),
f AS (SELECT *, tail = '' AS blank, tail <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o),
g AS MATERIALIZED (SELECT *, blank OR duplicate AS forced, CAST(NOT blank AND NOT duplicate AND right(tail, 1) NOT IN ('.', '!', '?') AS BIGINT) AS more FROM f),
w AS (SELECT conv_id, n + 1 AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {{'c': CAST(4 AS BIGINT), 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS s1, {{'c': CAST(2 AS BIGINT), 'a': 'I', 't': 'assistant:'}} AS su, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS sa FROM g WHERE i = 1
      UNION ALL
      SELECT conv_id, i, {_sql_insert("s0", "su2", "user")}, {_sql_insert("s1", "su2", "user")}, su2, {_sql_insert("sa", "su", "user")} FROM (
        SELECT *, {_sql_insert("su", "sa", "assistant")} AS su2 FROM (SELECT g.conv_id, g.i, {_sql_options()} FROM w JOIN g ON g.conv_id = w.conv_id AND g.i = w.i - 1))),
s AS (SELECT conv_id, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, CAST(sum(more) AS BIGINT) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(s0.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id) LEFT JOIN (SELECT conv_id, s0 FROM w WHERE i = 1) USING (conv_id)
"""
