"""The first-hit limiter over a stream.

``first_hit_stream`` decides a hit in the micro-batch in which it comes, and keeps a key's window for ever.

``first_hit_expiring`` decides by event time. A hit waits until the watermark has passed it, so hits may
come in any order within ``delay`` seconds and are decided as in a batch; a hit that comes after the
watermark has passed it is late and dropped, it neither counts nor gets a row. A key's state is its open
window and its waiting hits. It goes with a timer at the window's end, so state holds only keys with a hit
in about the last ``window + delay`` seconds of the stream. With ``slots`` the keys are dealt by hash to so
many groups: a group's state holds the same of its keys, and is read and written once a micro-batch instead of
once a key, which is what most of the time goes to where keys have few hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues, ValueState

from ..operators.limiters import window_settle
from .state import key_text, keys_of

OPEN = "opened long, used long, times array<long>, ties array<long>"


def first_hit_stream(hits: DataFrame, keys: list[str], limit: int, window_seconds: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """hits with allowed, in append mode. Equal to the batch operator for hits that arrive in time order
    from one micro-batch to the next (inside a batch they are sorted here)."""
    micros = window_seconds * 1_000_000
    rows = hits.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), tie)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["_t", tie])
        allowed, now = window_settle(pdf["_t"].to_numpy(), limit, micros, list(state.get) if state.exists else None)
        state.update(tuple(now))
        yield pdf.assign(allowed=allowed)[[*keys, "_t", tie, "allowed"]]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "_t", tie]) + ", allowed boolean"
    done = rows.groupBy(*keys).applyInPandasWithState(fold, schema, "opened long, used int", "append", GroupStateTimeout.NoTimeout)
    return done.select(*keys, F.timestamp_micros("_t").alias(ts), tie, "allowed")


class ExpiringWindows(StatefulProcessor):
    """Per key the open window and the hits that wait for the watermark; ``ties`` are longs."""

    def __init__(self, keys: list[str], limit: int, span: int, tie: str) -> None:
        self.keys, self.limit, self.span, self.tie = keys, limit, span, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", OPEN)

    def read(self) -> tuple[int, int, list[int], list[int]]:
        if not self.state.exists():
            return -1, 0, [], []
        opened, used, times, ties = self.state.get()
        return opened, used, list(times), list(ties)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        opened, used, times, ties = self.read()
        for pdf in rows:
            times += pdf["micros"].tolist()
            ties += pdf[self.tie].tolist()
        self.state.update((opened, used, times, ties))
        self.handle.registerTimer(min(times) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        opened, used, times, ties = self.read()
        order = sorted(range(len(times)), key=lambda i: (times[i], ties[i]))
        due = [i for i in order if times[i] < passed]
        wait = [i for i in order if times[i] >= passed]
        if due:
            t = np.array([times[i] for i in due], np.int64)
            allowed, (opened, used) = window_settle(t, self.limit, self.span, [opened, used] if opened >= 0 else None)
            yield pd.DataFrame({**{k: [v] * len(due) for k, v in zip(self.keys, key, strict=True)}, "micros": t, self.tie: [ties[i] for i in due], "allowed": allowed})
        if wait:
            self.state.update((opened, used, [times[i] for i in wait], [ties[i] for i in wait]))
            self.handle.registerTimer(times[wait[0]] // 1000 + 1)
        elif opened + self.span < passed:
            self.state.clear()
        else:
            self.state.update((opened, used, [], []))
            self.handle.registerTimer((opened + self.span) // 1000 + 1)

    def close(self) -> None:
        pass


class SlottedWindows(StatefulProcessor):
    """``ExpiringWindows`` of all keys (texts) of a slot."""

    def __init__(self, limit: int, span: int, tie: str) -> None:
        self.limit, self.span, self.tie = limit, span, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "keys array<string>, opened array<long>, used array<long>")
        self.waiting = handle.getValueState("waiting", "keys array<string>, times array<long>, ties array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        keys, times, ties = (list(x) for x in self.waiting.get()) if self.waiting.exists() else ([], [], [])
        for pdf in rows:
            keys += pdf["key"].tolist()
            times += pdf["micros"].tolist()
            ties += pdf[self.tie].tolist()
        self.waiting.update((keys, times, ties))
        self.handle.registerTimer(min(times) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        windows = {k: (o, u) for k, o, u in zip(*self.open.get(), strict=True)} if self.open.exists() else {}
        hits = sorted(zip(*self.waiting.get(), strict=True)) if self.waiting.exists() else []
        due = [h for h in hits if h[1] < passed]
        wait = [h for h in hits if h[1] >= passed]
        allowed: list[bool] = []
        for k, own in groupby(due, key=lambda h: h[0]):
            settled, windows[k] = window_settle(np.array([h[1] for h in own], np.int64), self.limit, self.span, list(windows[k]) if k in windows else None)
            allowed += settled.tolist()
        windows = {k: (int(o), int(u)) for k, (o, u) in windows.items() if o + self.span >= passed}
        self.put(self.open, [(k, *w) for k, w in windows.items()])
        self.put(self.waiting, wait)
        later = [h[1] for h in wait] + [o + self.span for o, _ in windows.values()]
        if later:
            self.handle.registerTimer(min(later) // 1000 + 1)
        if due:
            yield pd.DataFrame({"key": [h[0] for h in due], "micros": [h[1] for h in due], self.tie: [h[2] for h in due], "allowed": allowed})

    @staticmethod
    def put(state: ValueState, rows: list[tuple]) -> None:
        if rows:
            state.update(tuple(list(x) for x in zip(*rows, strict=True)))
        elif state.exists():
            state.clear()

    def close(self) -> None:
        pass


def first_hit_expiring(hits: DataFrame, keys: list[str], limit: int, window_seconds: int, delay_seconds: int, ts: str = "ts", tie: str = "event_id", slots: int | None = None) -> DataFrame:
    """hits with allowed, each once the watermark (the latest time seen less delay_seconds) has passed it."""
    at = F.col(ts).cast("timestamp")
    rows = hits.select(*keys, at.alias("event_time"), F.unix_micros(at).alias("micros"), F.col(tie).cast("long").alias(tie)).withWatermark("event_time", f"{delay_seconds} seconds")
    if slots:
        dealt = rows.select(key_text(keys).alias("key"), "event_time", "micros", tie).withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots)))
        settled = SlottedWindows(limit, window_seconds * 1_000_000, tie)
        done = dealt.groupBy("slot").transformWithStateInPandas(settled, f"key string, micros long, `{tie}` long, allowed boolean", "Append", "EventTime")
        return done.select(*keys_of(rows, keys, "key"), F.timestamp_micros("micros").alias(ts), tie, "allowed")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "micros", tie]) + ", allowed boolean"
    windows = ExpiringWindows(keys, limit, window_seconds * 1_000_000, tie)
    done = rows.groupBy(*keys).transformWithStateInPandas(windows, schema, "Append", "EventTime")
    return done.select(*keys, F.timestamp_micros("micros").alias(ts), tie, "allowed")
