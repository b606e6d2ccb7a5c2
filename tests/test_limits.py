import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from colloquy.operators import limiters
from colloquy.streaming.limiter import first_hit_stream
from compare import SF
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 1)


def hits(spark, seconds, action="chat"):
    return spark.createDataFrame([(action, 1, T0 + timedelta(seconds=s), i) for i, s in enumerate(seconds)], "action string, user_id int, ts timestamp, event_id int")


def allowed(frame):
    return [r.allowed for r in sorted(frame.collect(), key=lambda r: r.event_id)]


@pytest.mark.parametrize("rule", [limiters.first_hit_windows])
@pytest.mark.parametrize("seconds,limit,expected", [([0, 1, 2], 2, [True, True, False]), ([10, 69.9, 70], 1, [True, False, True]), ([5, 5, 64, 65, 66], 1, [True, False, False, True, False])])
def test_first_hit(spark, rule, seconds, limit, expected):
    assert allowed(rule(hits(spark, seconds), ["action", "user_id"], limit, 60)) == expected


def test_keys_are_apart(spark):
    both = hits(spark, [0]).unionAll(hits(spark, [1], "chat_stream").withColumn("event_id", F.lit(1)))
    assert allowed(limiters.first_hit_windows(both, ["action", "user_id"], 1, 60)) == [True, True]


def test_epoch_variant_differs(spark):
    assert allowed(limiters.epoch_windows(hits(spark, [59, 61]), ["action", "user_id"], 1, 60)) == [True, True]
    assert allowed(limiters.first_hit_windows(hits(spark, [59, 61]), ["action", "user_id"], 1, 60)) == [True, False]


def test_leaky_bucket(spark):
    got = allowed(limiters.leaky_bucket(hits(spark, [0] * 23 + [2]), ["user_id"], 30, 20))
    assert got == [True] * 21 + [False, False] + [True]


@pytest.mark.parametrize("drain,burst", [(0.5, 20), (0.37, 3), (0.01, 0)])
def test_bucket_equals_one_hit_at_a_time(drain, burst):
    r = np.random.default_rng(burst)
    t = np.cumsum(r.choice([0, 1, 5, 40, 3000, 90_000], size=4000, p=[0.5, 0.2, 0.2, 0.07, 0.02, 0.01]))
    want, last, excess = [], None, 0.0
    for now in t.tolist():
        more = 0.0 if last is None else max(excess - drain * (now - last) + 1000.0, 0.0)
        want.append(more <= burst * 1000.0)
        if want[-1]:
            last, excess = now, more
    first, state = limiters.bucket_settle(t[:1700], burst, drain, None)
    rest, end = limiters.bucket_settle(t[1700:], burst, drain, state)
    assert [*first, *rest] == want and end == [last, excess] and 0 < sum(want) < len(want)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    rows = events.toPandas()
    for n in range(3):
        part = rows.iloc[n * len(rows) // 3 : (n + 1) * len(rows) // 3]
        spark.createDataFrame(part).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        for f in os.listdir(tmp_path / f"part{n}"):
            if f.endswith(".parquet"):
                os.makedirs(tmp_path / "in", exist_ok=True)
                os.rename(tmp_path / f"part{n}" / f, tmp_path / "in" / f"{n}.parquet")
                os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = first_hit_stream(stream, ["event_type", "user_id"], 1, 86_400)
    q = done.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = limiters.first_hit_windows(events, ["event_type", "user_id"], 1, 86_400)
    got = {(r.event_id, r.allowed) for r in spark.table("limited").collect()}
    assert got == {(r.event_id, r.allowed) for r in batch.collect()}


def test_limits_of_the_table(spark):
    from colloquy.plans.limits import limit_table

    rows = [("rate", "auth_register", "10.0.0.1", T0 + timedelta(seconds=i), i) for i in range(6)] + [("rate", "auth_register", "10.0.0.2", T0, 6), ("quota", "chat", "u1", T0, 7), ("rate", "other", "10.0.0.1", T0, 8), ("rate", "auth_register", "10.0.0.1", T0 + timedelta(seconds=60), 9)]
    hits = spark.createDataFrame(rows, "kind string, action string, who string, ts timestamp, event_id int")
    got = {r.event_id: r for r in limiters.limited(hits, limit_table(spark)).collect()}
    assert [got[i].allowed for i in range(10)] == [True] * 5 + [False] + [True] * 4
    assert (got[5].error, got[5].http_status, got[5].bucket_key) == ("rate_limit_exceeded", 429, "auth_register:10.0.0.1") and got[0].error is None
