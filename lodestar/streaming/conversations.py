"""Conversation windows as a stateful stream: the turns that the next question's history holds, whatever order messages
arrive in, and questions that stay without an answer.

State is a list of messages for each conversation. What the watermark has passed is final: of that, only the last turns of
the window are kept, so that state does not grow with a conversation. Within a conversation, turn numbers are expected to
ascend with the time of the messages. Each micro-batch replaces the windows of the conversations that it touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lodestar.sources.versioned import VersionedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "turn long, role string, text string, status string, at long"
WINDOW = "conv_id long, kind string, turn long, back long, question string, answer string"


def turns_of(messages: list[tuple]) -> list[tuple[int, int, str, str]]:
    """(place, turn, question, answer) of the turns in messages (turn, role, text, status, at) by turn: a user's message with
    an assistant's right behind it that was not interrupted."""
    both = [m for m in messages if m[1] in ("user", "assistant")]
    return [(i, a[0], a[2], b[2]) for i, (a, b) in enumerate(zip(both, both[1:])) if a[1] == "user" and b[1] == "assistant" and b[3] != "interrupted"]


def window_of(messages: list[tuple], n: int, budget: int) -> list[tuple[int, int, str, str]]:
    """(turn, back, question, answer) of the last n turns within the budget of characters; the newest always stays."""
    out, chars = [], 0
    for back, (_, turn, question, answer) in enumerate(reversed(turns_of(messages)[-n:]), 1):
        question, answer = question or "", answer or ""
        chars += len(question) + len(answer)
        if chars > budget and back > 1:
            break
        out.append((turn, back, question, answer[: max(0, budget - len(question))] if chars > budget else answer))
    return out


def last_final(messages: list[tuple], n: int, watermark: int) -> list[tuple]:
    """Messages without those that can't come into a window any more: final ones before the last n final turns."""
    both = [m for m in messages if m[1] in ("user", "assistant")]
    final = next((i for i, m in enumerate(both) if m[4] >= watermark), len(both))
    turns = turns_of(both[:final])
    return both[turns[-n][0] :] if len(turns) >= n else both


class Windows(StatefulProcessor):
    def __init__(self, n: int, budget: int, patience: int) -> None:
        self.n, self.budget, self.patience = n, budget, patience

    def init(self, handle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", MESSAGE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {m[0]: tuple(m) for m in self.messages.get()}
        for frame in rows:
            for r in frame[["turn", "role", "text", "status", "at"]].itertuples(index=False):
                m = tuple(None if x is None or x != x else x for x in r)
                m = (int(m[0]), m[1], m[2], m[3], int(m[4]))
                known[m[0]] = m
                if m[1] == "user":
                    self.handle.registerTimer(m[4] + self.patience)
        kept = last_final(sorted(known.values(), key=lambda m: m[0]), self.n, timerValues.getCurrentWatermarkInMs())
        if kept:
            self.messages.put(kept)
        else:  # the store takes no empty lists
            self.messages.clear()
        yield self._frame(key, [("turn", *w) for w in window_of(kept, self.n, self.budget)] or [("none", None, None, None, None)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, found = expiredTimerInfo.getExpiryTimeInMs(), []
        messages = [tuple(m) for m in self.messages.get()]
        for m, after in zip(messages, [*messages[1:], None], strict=True):
            if m[1] == "user" and m[4] + self.patience <= at and (after is None or after[1] != "assistant"):
                found.append(("unanswered", m[0], None, m[2], None))
        if found:
            yield self._frame(key, found)

    @staticmethod
    def _frame(key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["kind", "turn", "back", "question", "answer"]).astype({"turn": "Int64", "back": "Int64"})
        out.insert(0, "conv_id", key[0])
        return out


def window_stream(messages: DataFrame, n: int = 5, budget: int = 1500, delay: str = "1 hour", patience: int = 90_000) -> DataFrame:
    """messages (conv_id, turn, role, text, status, created_at) as rows (conv_id, kind, turn, back, question, answer): the whole
    window of each conversation that a micro-batch touched (kind ``turn``, or one row ``none``), and once for each question
    that stays unanswered ``patience`` milliseconds behind the watermark, ``unanswered``. Later than ``delay``, messages
    count no more. Null conversations, turns and times are left out."""
    d = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND created_at IS NOT NULL").withWatermark("created_at", delay)
    d = d.withColumn("at", F.unix_millis("created_at"))
    return d.groupBy("conv_id").transformWithStateInPandas(Windows(n, budget, patience), WINDOW, "Update", "EventTime")


def window_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, f"{path}/windows", "conv_id", WINDOW)


def run_windows(spark: SparkSession, source: str, target: str, checkpoint: str, writer: str = "windows", files: int = 100, **how) -> StreamingQuery:
    """Follows Parquet files of messages: keeps window_table(target), and the unanswered questions as Parquet beside it, a folder
    for each micro-batch, which a micro-batch that is run again writes again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "conv_id long, turn long, role string, text string, status string, created_at timestamp"
    found = window_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source), **how)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        rows = batch.filter("kind <> 'unanswered'")
        window_table(batch.sparkSession, target).replace(rows.filter("kind = 'turn'"), number, rows, writer)
        batch.filter("kind = 'unanswered'").select("conv_id", "turn", "question").write.mode("overwrite").parquet(f"{target}/unanswered/batch={number}")
        batch.unpersist()

    return found.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
