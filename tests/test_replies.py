import json

from colloquy.operators import replies
from colloquy.plans import versions
from colloquy.streaming.events import write_events
from pyspark.sql import functions as F


def asked(spark, text="Hello there"):
    return spark.createDataFrame([(1, 0, "user", "first"), (1, 1, "assistant", "x"), (1, 2, "user", text), (2, 0, "system", "no user")], "conv_id long, turn long, role string, text string")


def test_mock_reply_and_chunks(spark):
    got = replies.mock_replies(asked(spark))
    assert [tuple(r) for r in got.collect()] == [(1, "Mock assistant reply: Hello there")]
    chunks = replies.reply_chunks(got)
    assert [r.chunk for r in chunks.orderBy("seq").collect()] == ["Mock ", "assistant ", "reply: Hello there"]
    assert replies.rejoined(chunks).first().reply == "Mock assistant reply: Hello there"


def test_events_and_what_is_stored(spark):
    text = 'quo"te é\n'
    requests = replies.latest_user_turns(asked(spark, text)).withColumnRenamed("latest", "user_message")
    chunks = replies.reply_chunks(replies.mock_replies(asked(spark, text)))
    whole = replies.stream_events(requests, chunks, F.lit(False)).orderBy("seq").collect()
    assert [r.event for r in whole] == ["metadata", "chunk", "chunk", "chunk", "done"]
    assert whole[3].data == json.dumps({"content": "reply: " + text}) and json.loads(whole[0].data) == {"conversation_id": "1", "user_message": text}
    cut = replies.stream_events(requests, chunks, F.lit(True))
    assert [r.event for r in cut.orderBy("seq").collect()] == ["metadata", "chunk", "error"]
    assert [r.role for r in replies.persisted_turns(requests, chunks, cut).collect()] == ["user"]
    stored = replies.persisted_turns(requests, chunks, replies.stream_events(requests, chunks, F.lit(False))).collect()
    assert {(r.role, r.content) for r in stored} == {("user", text), ("assistant", "Mock assistant reply: " + text)}


def test_failed_sync_request_stores_nothing(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "b")], "conv_id long, user_message string")
    outcomes = spark.createDataFrame([(1, "r", None), (2, None, "provider_unavailable")], "conv_id long, reply string, error string")
    assert {r.conv_id for r in replies.sync_turns(requests, outcomes).collect()} == {1}


def test_retries(spark):
    rows = [
        (1, 0, None, 1),
        (2, 0, "provider_unavailable", 0), (2, 1, None, 1),
        (3, 0, "provider_unavailable", 0), (3, 1, "provider_unavailable", 0), (3, 2, None, 1),
        (4, 0, "provider_timeout", 0), (4, 1, None, 1),
        (5, 0, "provider_unavailable", 1), (5, 1, None, 1),
    ]
    got = {r.request_id: (r.code, r.attempts_made) for r in replies.retry_outcomes(spark.createDataFrame(rows, "request_id int, attempt int, code string, emitted int")).collect()}
    assert got == {1: (None, 1), 2: (None, 2), 3: ("provider_unavailable", 2), 4: ("provider_timeout", 1), 5: ("provider_unavailable", 1)}


def test_plug_ins(spark):
    histories = spark.createDataFrame([(1, [("user", "Hi")])], "conv_id long, messages array<struct<role:string,content:string>>")
    calls = {
        "mock": ("Mock assistant reply: Hi", None, 1),
        "failing-mock": (None, "provider_unavailable", 2),
        "partial-failing-mock": (None, "provider_unavailable", 2),
        "flaky-mock": ("Mock assistant reply: Hi", None, 2),
        "timeout-mock": (None, "provider_timeout", 1),
        "nope": (None, "provider_unsupported", 1),
    }
    for name, expected in calls.items():
        r = replies.provider_replies(histories, replies.provider(name)).first()
        assert (r.reply, r.error, r.attempts) == expected
    whole = [("chunk", "Mock "), ("chunk", "assistant "), ("chunk", "reply: Hi"), ("done", "")]
    streams = {"mock": whole, "flaky-mock": whole, "partial-failing-mock": [("chunk", "Mock "), ("error", "provider_stream_interrupted")], "failing-mock": [("error", "provider_unavailable")]}
    for name, expected in streams.items():
        rows = replies.provider_chunks(histories, replies.provider(name)).orderBy("seq").collect()
        assert [(r.event, r.data) for r in rows] == expected


def test_schema_versions(spark):
    versions.upgrade(spark, "chat_v")
    assert {t.name for t in spark.catalog.listTables("chat_v") if not t.isTemporary} == {"users", "conversations", "messages", "refresh_tokens", "schema_versions"}
    spark.sql("INSERT INTO chat_v.users (id, email, password_hash, created_at) VALUES ('1', 'a@b.org', 'h', now())")
    assert tuple(spark.table("chat_v.users").select("is_active", "is_superuser", "is_verified").first()) == (True, False, False)
    versions.downgrade(spark, "chat_v", "0003")
    assert "is_active" not in spark.table("chat_v.users").columns
    versions.downgrade(spark, "chat_v", "0001")
    assert {t.name for t in spark.catalog.listTables("chat_v") if not t.isTemporary} == {"schema_versions"}


def test_event_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "metadata", "{}")], "conv_id long, seq long, event string, data string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    write_events(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_python_plug_ins(spark):
    histories = spark.createDataFrame([(1, [("user", "Hi")])], "conv_id long, messages array<struct<role:string,content:string>>")

    def speak(turns, attempt):
        yield turns[-1]["content"] + " "
        if attempt == 0:
            raise ConnectionError("gone")
        yield "there"

    def refuse(turns, attempt):
        raise ValueError("odd")

    made = {"own": replies.plugged(speak), "odd": replies.plugged(refuse)}
    assert tuple(replies.provider_replies(histories, replies.provider("OWN", made)).first()) == (1, "Hi there", None, 2)
    assert [(r.event, r.data) for r in replies.provider_chunks(histories, replies.provider("own", made)).orderBy("seq").collect()] == [("chunk", "Hi "), ("error", "provider_unavailable")]
    assert tuple(replies.provider_replies(histories, replies.provider("odd", made)).first()) == (1, None, "provider_request_failed", 1)


def test_versions_swap_in_together(spark, tmp_path):
    folder = str(tmp_path)
    one, two = spark.range(1).toDF("id"), spark.range(2).toDF("id")
    assert versions.write_versions({"users": one, "messages": one}, folder) == 1
    versions.write_versions({"users": two}, folder)
    two.withColumn("id", F.raise_error(F.lit("broken"))).createOrReplaceTempView("broken")
    try:
        versions.write_versions({"messages": two, "users": spark.table("broken")}, folder)
    except Exception:
        pass
    assert [versions.read_version(spark, folder, n).count() for n in ("users", "messages")] == [2, 1]
    assert versions.write_versions({"messages": two}, folder) == 3 and versions.read_version(spark, folder, "messages").count() == 2


def test_table_function_from_sql_and_frames(spark):
    histories = spark.createDataFrame([(1, [("user", "Hi you there")]), (2, [("system", "x"), ("user", "é"), ("assistant", "y")]), (3, [])], "conv_id long, messages array<struct<role:string,content:string>>")

    def speak(turns, attempt):
        if not turns:
            raise ValueError("nothing asked")
        if attempt == 0 and len(turns) > 1:
            raise ConnectionError("gone")
        yield from replies.mock_chunks(turns, attempt)

    function = replies.register_provider(spark, "spoken_rows", speak)
    by_frame = sorted(tuple(r) for r in replies.spoken(histories, function).collect())
    by_sql = sorted(tuple(r) for r in spark.sql("SELECT conv_id, s.* FROM {h}, LATERAL spoken_rows(messages) AS s", h=histories).collect())
    by_rows = sorted(tuple(r) for r in replies.provider_chunks(histories, replies.plugged(speak)).select("conv_id", "seq", "event", "data").collect())
    assert by_frame == by_sql == by_rows
    assert by_frame[:4] == [(1, 0, "chunk", "Mock "), (1, 1, "chunk", "assistant "), (1, 2, "chunk", "reply: Hi you there"), (1, 3, "done", "")]
    assert by_frame[-1] == (3, 0, "error", "provider_request_failed")


def test_attempt_that_hangs_is_abandoned(spark):
    import threading
    import time

    histories = spark.createDataFrame([(i, [("user", "x" * i)]) for i in range(6)], "conv_id long, messages array<struct<role:string,content:string>>").coalesce(1)

    def speak(turns, attempt):
        yield "a"
        if len(turns[0]["content"]) == 2:
            threading.Event().wait(600)
        if len(turns[0]["content"]) == 3:
            raise TimeoutError
        yield "b"

    begun = time.monotonic()
    rows = {r.conv_id: r for r in replies.provider_replies(histories, replies.plugged(speak, seconds=1.5)).collect()}
    assert time.monotonic() - begun < 60
    assert [rows[i].error for i in range(6)] == [None, None, "provider_timeout", "provider_timeout", None, None]
    assert rows[4].reply == "ab" and rows[2].attempts == 1
    assert replies.attempted(speak, [{"role": "user", "content": "xx"}], 0, 0.3) == ("provider_timeout", ["a"])


def test_requests_that_are_waited_for_hold_up_no_others(spark):
    """40 of 60 requests of one task hang; one after the other they would take 40 seconds and more."""
    import time

    def hanging(turns, attempt):
        yield "a"
        if int(turns[0]["content"]) % 3:
            time.sleep(20)
        yield "b"

    rows = [(n, [("user", str(n))]) for n in range(60)]
    histories = spark.createDataFrame(rows, "conv_id long, messages array<struct<role:string,content:string>>").coalesce(1)
    begin = time.monotonic()
    made = replies.plugged(hanging, seconds=1.0, at_once=32)(histories, True, 1, "conv_id").collect()
    assert time.monotonic() - begin < 30
    want = {n: (0, "provider_timeout", ["a"]) if n % 3 else (0, None, ["a", "b"]) for n in range(60)}
    assert {r.conv_id: (r.attempt, r.code, r.chunks) for r in made} == want
