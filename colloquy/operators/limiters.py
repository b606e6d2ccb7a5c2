"""Fixed-window limits per key.

``first_hit_windows`` is the parity operator: a window opens at a key's first hit and lasts
``window_seconds``; a hit at its end or later opens the next one. Hits pass through sorted by key and
time, and only the open window of the key at hand is kept, so memory does not follow a key's hits; a
window is settled at once, by two look-ups in the sorted times. ``limited`` applies the parameters of
a limit table to hits of routes and actions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Settle = Callable[[np.ndarray, float, float, list | None], tuple[np.ndarray, list]]


def window_settle(t: np.ndarray, limit: float, window: float, state: list | None) -> tuple[np.ndarray, list]:
    """Which of a key's next hits (sorted times) are allowed; state: when the window opened, and how much of it is used."""
    allowed = np.zeros(len(t), bool)
    opened, used = state if state else (int(t[0]), 0)
    at = 0
    while at < len(t):
        if t[at] >= opened + window:
            opened, used = int(t[at]), 0
        end = int(np.searchsorted(t, opened + window))
        take = max(0, min(end - at, int(limit) - used))
        allowed[at : at + take] = True
        used, at = used + take, end
    return allowed, [opened, used]


def bucket_settle(t: np.ndarray, burst: float, drain: float, state: list | None) -> tuple[np.ndarray, list]:
    """The same for a bucket that drains; state: the last allowed time, and the excess then (thousandths of a hit).

    A refused hit changes nothing, so from one the next allowed hit is sought in growing steps.
    """
    last, excess = state if state else (None, 0.0)
    allowed, times, full = np.zeros(len(t), bool), t.tolist(), burst * 1000.0
    at = 0
    while at < len(times):
        more = 0.0 if last is None else max(excess - drain * (times[at] - last) + 1000.0, 0.0)
        if more <= full:
            allowed[at] = True
            last, excess, at = times[at], more, at + 1
            continue
        at, step = at + 1, 64
        while at < len(times):
            free = excess - drain * (t[at : at + step] - last) + 1000.0 <= full
            if free.any():
                at += int(free.argmax())
                break
            at, step = at + len(free), 2 * step
    return allowed, [last, excess]


def settled(hits: DataFrame, keys: list[str], settle: Settle, tie: str) -> DataFrame:
    """hits with allowed; hits: keys, _t (long), _limit and _span (doubles, equal for a key), tie and more."""
    order = [*keys, "_t", tie]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(k).dictionary_encode("encode").indices.to_numpy() for k in keys]
            t = batch.column("_t").to_numpy()
            limit, span = batch.column("_limit").to_numpy(), batch.column("_span").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)])).tolist()
            parts = []
            for a, b in zip(edges, [*edges[1:], len(t)], strict=True):
                key = tuple(batch.column(k)[a].as_py() for k in keys)
                if key != open_key:
                    open_key, state = key, None
                allowed, state = settle(t[a:b], limit[a], span[a], state)
                parts.append(allowed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts))], names=[*batch.schema.names, "allowed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields) + ", allowed boolean"
    return hits.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, schema)


def first_hit_windows(hits: DataFrame, keys: list[str], limit: int, window_seconds: int, ts: str = "ts", tie: str = "event_id", spread: bool = False) -> DataFrame:
    """hits with allowed (boolean); rejected hits do not count. spread: a key may hold more hits than a task should (see ``hotkeys``)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = hits.select(*keys, micros.alias("_t"), tie, F.lit(float(limit)).alias("_limit"), F.lit(window_seconds * 1e6).alias("_span"))
    return settled_windows(rows, keys, tie, spread).select(*keys, F.timestamp_micros("_t").alias(ts), tie, "allowed")


def settled_windows(rows: DataFrame, keys: list[str], tie: str, spread: bool) -> DataFrame:
    from .hotkeys import settled_by_ranges

    return settled_by_ranges(rows, keys, tie) if spread else settled(rows, keys, window_settle, tie)


def limited(hits: DataFrame, parameters: DataFrame, ts: str = "ts", tie: str = "event_id", spread: bool = False) -> DataFrame:
    """hits(kind, action, who, ts, tie) with bucket_key, allowed, error and http_status.

    parameters: plans.limits.limit_table. A bucket is an action (or route) of one address or user;
    hits of an action that has no limit are allowed.
    """
    limits = F.broadcast(parameters.select("kind", "action", F.col("limit").cast("double").alias("_limit"), (F.col("window_seconds") * 1e6).alias("_span"), F.col("error").alias("_error")))
    rows = hits.join(limits, ["kind", "action"], "left").withColumn("bucket_key", F.concat_ws(":", "action", "who")).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = rows.select("kind", "bucket_key", "_t", tie, F.coalesce("_limit", F.lit(1e18)).alias("_limit"), F.coalesce("_span", F.lit(1.0)).alias("_span"), "_error")
    done = settled_windows(rows, ["kind", "bucket_key"], tie, spread)
    refused = ~F.col("allowed")
    return done.select("kind", "bucket_key", F.timestamp_micros("_t").alias(ts), tie, "allowed", F.when(refused, F.col("_error")).alias("error"), F.when(refused, 429).alias("http_status"))


def epoch_windows(hits: DataFrame, keys: list[str], limit: int, window_seconds: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """A variant, not parity: windows aligned to the epoch."""
    start = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (window_seconds * 1_000_000))
    rank = F.row_number().over(Window.partitionBy(*keys, "_w").orderBy(ts, tie))
    return hits.withColumn("_w", start).select(*keys, ts, tie, (rank <= limit).alias("allowed"))


def leaky_bucket(hits: DataFrame, keys: list[str], per_minute: float, burst: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The proxy's rule: excess drains at a rate; a hit that would exceed the burst is refused and adds nothing."""
    millis = F.unix_millis(F.col(ts).cast("timestamp"))
    # the rate is thousandths of a hit in a millisecond
    rows = hits.select(*keys, millis.alias("_t"), tie, F.lit(float(burst)).alias("_limit"), F.lit(per_minute / 60.0).alias("_span"))
    return settled(rows, keys, bucket_settle, tie).select(*keys, tie, "allowed")
