import json
import random
from datetime import datetime, timedelta

from colloquy.operators import limiters, replies
from colloquy.streaming.limiter import first_hit_expiring
from colloquy.streaming.replies import persisted_stream
from colloquy.streaming.state import replayed, run_to_end
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 1)
HITS = "who string, ts timestamp, event_id long"


def at(spark, rows):
    return spark.createDataFrame([(who, T0 + timedelta(seconds=s), i) for who, s, i in rows], HITS).coalesce(1)


def end(spark, seconds=10**6):
    return at(spark, [("", seconds, -1)])


def outcome(frame):
    return {r.event_id: r.allowed for r in frame.collect()}


def limited(delay, limit=2, window=60):
    return lambda hits: first_hit_expiring(hits, ["who"], limit, window, delay)


def test_out_of_order_hits_are_decided_as_in_a_batch(spark):
    first = [("a", 50, 0), ("a", 0, 1), ("b", 30, 2), ("a", 59, 3)]
    second = [("a", 20, 4), ("a", 60, 5), ("b", 85, 6), ("b", 91, 7), ("a", 61, 8)]
    want = outcome(limiters.first_hit_windows(at(spark, first + second), ["who"], 2, 60))
    assert outcome(replayed([at(spark, first), at(spark, second), end(spark)], limited(45))) == want


def test_late_hits_are_dropped_and_do_not_count(spark):
    parts = [at(spark, [("a", 0, 0), ("a", 500, 1)]), at(spark, [("a", 501, 2)]), at(spark, [("a", 100, 3), ("a", 502, 4)]), end(spark)]
    assert outcome(replayed(parts, limited(60))) == {0: True, 1: True, 2: True, 4: False}


def test_restart_gives_each_row_once_and_state_is_bounded(spark, tmp_path):
    """Five rounds of 40 new keys; between rounds the query is stopped and started again from its checkpoint."""
    folder, hits = str(tmp_path), []
    for n in range(5):
        part = [(f"k{n}-{k}", 1000 * n + 7 * j, 1000 * n + 10 * k + j) for k in range(40) for j in range(4)]
        hits += part
        at(spark, part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(HITS).parquet(f"{folder}/in")
        run_to_end(limited(100, limit=3)(stream), f"{folder}/out", f"{folder}/state")
    end(spark).write.mode("append").parquet(f"{folder}/in")
    run_to_end(limited(100, limit=3)(spark.readStream.schema(HITS).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/state")
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == len(hits) == got.select("event_id").distinct().count()
    assert outcome(got) == outcome(limiters.first_hit_windows(at(spark, hits), ["who"], 3, 60))
    kept = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "open").load()
    assert kept.count() <= 41  # of 200 keys


def test_keys_in_slots_are_decided_alike(spark, tmp_path):
    """Null keys and late hits too; the state of the slots empties; a slot is called once a micro-batch, however many keys it has."""
    r = random.Random(6)
    parts = [[(r.choice(["a", "b", 'c"', None, "é"]), r.randint(200 * n, 200 * n + 230), 100 * n + i) for i in range(100)] for n in range(4)]
    frames = [*(at(spark, p) for p in parts), end(spark, 5000), end(spark, 10**6)]
    slotted = lambda slots: lambda hits: first_hit_expiring(hits, ["who"], 2, 60, 45, slots=slots)
    want = {(x.who, x.event_id, x.ts, x.allowed) for x in replayed(frames, limited(45)).collect()}
    for slots in (1, 3):
        assert {(x.who, x.event_id, x.ts, x.allowed) for x in replayed(frames, slotted(slots)).collect()} == want and len(want) > 300
    for n, frame in enumerate(frames):
        frame.write.mode("append").parquet(f"{tmp_path}/in")
        run_to_end(slotted(2)(spark.readStream.schema(HITS).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    assert outcome(spark.read.parquet(f"{tmp_path}/out")).keys() == {w[1] for w in want}
    assert spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "open").load().count() <= 1


def test_state_holds_recent_keys_only(spark, tmp_path):
    folder = str(tmp_path)
    for n in range(2):
        at(spark, [(f"k{n}-{k}", 1000 * n + k % 7, 100 * n + k) for k in range(50)]).write.mode("append").parquet(f"{folder}/in")
        run_to_end(limited(10)(spark.readStream.schema(HITS).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/state")
        kept = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "open").load()
        assert kept.count() <= 50
    assert kept.agg(F.min("key.who")).first()[0].startswith("k1")


def events_of(conv, text, chunks, end="done"):
    rows = [(conv, 0, "metadata", json.dumps({"conversation_id": str(conv), "user_message": text}))]
    rows += [(conv, i + 1, "chunk", json.dumps({"content": c})) for i, c in enumerate(chunks)]
    return rows + ([(conv, len(rows), end, "{}")] if end else [])


def stored(spark, parts, **options):
    frames = [spark.createDataFrame(p, "conv_id long, seq long, event string, data string").coalesce(1) for p in parts]
    return sorted(tuple(r) for r in replayed(frames, lambda e: persisted_stream(e, **options)).collect())


def test_interleaved_and_interrupted_replies(spark):
    one, two = events_of(1, "hi é", ["Mock ", "reply", ": é"]), events_of(2, "yo", ["Mock "], "error")
    three, four = events_of(3, "left", ["a", "b"], None), events_of(4, "none", [])
    parts = [[one[0], two[0], one[2], three[0]], [one[4], two[1], three[1], one[1], one[1]], [two[2], one[3], three[2], four[1]], [four[0]]]
    want = [(1, "assistant", "Mock reply: é"), (1, "user", "hi é"), (2, "user", "yo"), (3, "user", "left"), (4, "assistant", ""), (4, "user", "none")]
    assert stored(spark, parts) == want
    assert stored(spark, parts, slots=1) == want and stored(spark, parts, slots=2) == want
    requests = spark.createDataFrame([(1, "hi é"), (2, "yo"), (3, "left"), (4, "none")], "conv_id long, user_message string")
    events = spark.createDataFrame(one + two + three + four, "conv_id long, seq long, event string, data string")
    chunks = events.where("event = 'chunk'").selectExpr("conv_id", "seq", "from_json(data, 'content string').content as chunk")
    batch = {tuple(r) for r in replies.persisted_turns(requests, chunks, events).collect()}
    assert {w for w in want if w[2]} == batch  # in a batch a reply without chunks has no row to be joined from


def test_replies_go_on_after_a_restart(spark, tmp_path):
    folder, rows = str(tmp_path), events_of(1, "x", ["a", "b", "c"]) + events_of(2, "y", ["d"])
    for n, part in enumerate([rows[:2], rows[2:4] + rows[6:7], rows[4:6], rows[7:]]):
        spark.createDataFrame(part, "conv_id long, seq long, event string, data string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("conv_id long, seq long, event string, data string").parquet(f"{folder}/in")
        run_to_end(persisted_stream(stream), f"{folder}/out", f"{folder}/state")
    got = sorted((r.conv_id, r.role, r.content) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [(1, "assistant", "abc"), (1, "user", "x"), (2, "assistant", "d"), (2, "user", "y")]
    assert spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "reply").load().count() == 0


def test_state_of_a_stopped_stream_expires(spark, tmp_path):
    folder, schema = str(tmp_path), "conv_id long, seq long, event string, data string, ts timestamp"
    timed = lambda rows, s: spark.createDataFrame([(*r, T0 + timedelta(seconds=s)) for r in rows], schema).coalesce(1)
    for rows, s in ((events_of(1, "left", ["a"], None), 0), (events_of(2, "x", ["b"])[:2], 50), (events_of(3, "y", ["c"]), 500), (events_of(4, "z", ["d"], None), 501)):
        timed(rows, s).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        run_to_end(persisted_stream(stream, ts="ts", idle_seconds=60), f"{folder}/out", f"{folder}/state")
    got = sorted((r.conv_id, r.role) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [(1, "user"), (2, "user"), (3, "assistant"), (3, "user"), (4, "user")]
    kept = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "reply").load()
    assert [r.key.conv_id for r in kept.collect()] == [4]
