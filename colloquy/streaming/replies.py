"""Streamed replies, persisted when they are complete.

Events of a conversation's reply come as a stream of rows (key, seq, event, data): metadata with the user's
message, chunks, then done or error. A conversation's state is what has come of the reply that is open. The
user's turn is stored as soon as the metadata are there; the reply's turn once ``done`` and all events
before it have come, in whatever order and micro-batch; after an ``error`` the reply is dropped.

Defined results: an event that comes twice counts once while its reply is open; replies of different
conversations may be interleaved at will; of a stream that just stops nothing but the user's turn is
stored. Where events have a time, its state goes ``idle_seconds`` after its last event, by the stream's
time, and events that come so late are dropped. One reply of a key is open at a time: the key names the
request. With ``slots`` (streams without a time) the keys are dealt by hash to so many groups, and the state of a
group's open replies is read and written once a micro-batch instead of once a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .state import key_text, keys_of

#: What has come: the numbers and texts of chunks, the number of the last event (null: not yet), whether the user's turn is stored.
REPLY = "numbers array<long>, texts array<string>, last long, stored boolean, until long"


class OpenReplies(StatefulProcessor):
    def __init__(self, key: str, idle_ms: int | None) -> None:
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reply", REPLY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        numbers, texts, last, stored, until = self.state.get() if self.state.exists() else ([], [], None, False, 0)
        chunks, failed, turns, latest = dict(zip(numbers, texts, strict=True)), False, [], 0
        for pdf in rows:
            latest = max(latest, int(pdf["millis"].max()))
            for number, event, text in zip(pdf["seq"].tolist(), pdf["event"], pdf["content"], strict=True):
                if event == "metadata" and not stored:
                    turns.append(("user", text))
                    stored = True
                elif event == "chunk":
                    chunks.setdefault(number, text)
                elif event == "done":
                    last = number
                failed |= event == "error"
        whole = last is not None and stored and len(chunks) == last - 1
        if whole and not failed:
            turns.append(("assistant", "".join(chunks[n] for n in sorted(chunks))))
        if whole or failed:
            self.state.clear()
        else:
            if self.idle_ms is not None:
                until = max(until, latest + self.idle_ms)
                self.handle.registerTimer(until)
            self.state.update((list(chunks), list(chunks.values()), last, stored, until))
        if turns:
            yield pd.DataFrame([(key[0], *turn) for turn in turns], columns=[self.key, "role", "content"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[4] <= expiredTimerInfo.getExpiryTimeInMs():  # else an event came since
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class SlottedReplies(StatefulProcessor):
    """``OpenReplies`` of all keys (texts) of a slot, whose state is the events that came of open replies."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("events", "keys array<string>, numbers array<long>, kinds array<string>, texts array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = [(*e, False) for e in zip(*self.state.get(), strict=True)] if self.state.exists() else []
        for pdf in rows:
            events += [(*e, True) for e in zip(pdf["key"].tolist(), pdf["seq"].tolist(), pdf["event"].tolist(), pdf["content"].tolist(), strict=True)]
        events.sort(key=lambda e: e[0])  # stable: what came first stays first
        turns, left = [], []
        for name, own in groupby(events, key=lambda e: e[0]):
            first = {}
            for _, number, event, text, new in own:
                first.setdefault((event, number if event == "chunk" else None), (number, text, new))
            meta, done = first.get(("metadata", None)), first.get(("done", None))
            chunks = sorted((number, text) for (event, _), (number, text, _) in first.items() if event == "chunk")
            failed = ("error", None) in first
            if meta and meta[2]:
                turns.append((name, "user", meta[1]))
            whole = done is not None and meta is not None and len(chunks) == done[0] - 1
            if whole and not failed:
                turns.append((name, "assistant", "".join(text for _, text in chunks)))
            if not whole and not failed:
                left += [(name, number, event, text) for (event, _), (number, text, _) in first.items()]
        if left:
            self.state.update(tuple(list(x) for x in zip(*left, strict=True)))
        elif self.state.exists():
            self.state.clear()
        if turns:
            yield pd.DataFrame(turns, columns=["key", "role", "content"])

    def close(self) -> None:
        pass


def persisted_stream(events: DataFrame, key: str = "conv_id", ts: str | None = None, idle_seconds: int = 3600, slots: int | None = None) -> DataFrame:
    """(key, role, content), in append mode, of a stream of events(key, seq, event, data and a time ts, if it has one)."""
    data = F.from_json("data", "user_message string, content string")
    kind = events.schema[key].dataType.simpleString()
    millis = F.unix_millis(F.col(ts).cast("timestamp")) if ts else F.lit(0).cast("long")
    columns = [key, F.col("seq").cast("long").alias("seq"), "event", F.coalesce(data["user_message"], data["content"]).alias("content"), millis.alias("millis")]
    if ts:
        events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{idle_seconds} seconds")
        columns.append(ts)
    if slots:
        if ts:
            raise ValueError("slots are for streams without a time")
        dealt = events.select(key_text([key]).alias("key"), *columns[1:4]).withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots)))
        done = dealt.groupBy("slot").transformWithStateInPandas(SlottedReplies(), "key string, role string, content string", "Append", "None")
        return done.select(*keys_of(events, [key], "key"), "role", "content")
    replies = OpenReplies(key, idle_seconds * 1000 if ts else None)
    return events.select(*columns).groupBy(key).transformWithStateInPandas(replies, f"`{key}` {kind}, role string, content string", "Append", "EventTime" if ts else "None")
