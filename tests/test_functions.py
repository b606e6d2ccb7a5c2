import json

import pytest
from colloquy.functions import text as X
from colloquy.functions import time as TM
from colloquy.sources import config, logs, requests, tables
from pyspark.sql import functions as F

EDGES = ["\t a b \n", " x　", "​kept​", "\x1cx\x1f", "\u0085y\u0085", "   ", "", "inner  space"]
JSON = ['plain', 'quo"te', "new\nline", "é漢\U0001F600", "\x01\x7f", "back\\slash", ""]


def one(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", column(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_strip_equals_python(spark):
    assert one(spark, EDGES, X.strip) == [e.strip() for e in EDGES]


def test_json_string_equals_python(spark):
    assert one(spark, JSON, X.python_json_string) == [json.dumps(x) for x in JSON]


@pytest.mark.parametrize("n,ok", [(0, False), (1, True), (4000, True), (4001, False)])
def test_length_bounds(spark, n, ok):
    assert one(spark, ["x" * n], lambda c: X.length_between(c, 1, 4000)) == [ok]


def test_small_text_functions(spark):
    assert one(spark, ["a b c d", "a b", "a"], lambda c: X.words_after(c, 2)) == ["c d", "", ""]
    assert one(spark, ["a@b.org", "a@b", "a b@c.org"], X.is_email) == [True, False, False]
    assert one(spark, ["{12345678-1234-1234-1234-123456789abc}", "12345678123412341234123456789abc", "x"], X.is_uuid) == [True, True, False]
    assert one(spark, ["http://x//"], X.without_trailing_slashes) == ["http://x"]
    assert one(spark, [None, "t"], X.title_of) == ["Untitled conversation", "t"]


def test_iso_format_drops_zero_fraction(spark):
    got = one(spark, ["2026-01-02 03:04:05", "2026-01-02 03:04:05.000120"], lambda c: TM.iso_format(c.cast("timestamp")))
    assert got == ["2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05.000120+00:00"]


def test_time_arithmetic(spark):
    row = spark.range(1).select(TM.timed_out_message(F.lit(2.5)).alias("m"), TM.elapsed_ms(F.lit(0.0012345)).alias("e"), TM.lifetime_seconds(F.lit(30)).alias("l")).first()
    assert tuple(row) == ("LLM provider timed out after 2.5 seconds.", 1.23, 1800)


def test_requests(spark):
    bodies = ['{"message": " hi ", "conversation_id": "c"}', '{"message": "   "}', "{}", "no json"]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert [(r.message, r.error) for r in requests.chat_requests(rows).collect()] == [("hi", None), ("", "chat_message_empty"), (None, "request_invalid"), (None, "request_invalid")]
    good = spark.createDataFrame([('{"email": "alice@example.com", "password": "correct-horse"}',), ('{"email": "alice@example.com", "password": "        "}',)], "body string")
    assert [r.accepted for r in requests.credential_requests(good).collect()] == [True, False]
    sizes = spark.createDataFrame([(32,), (33,), (None,)], "n int").select(requests.within_body_limit(F.col("n"), 32).alias("ok"))
    assert [r.ok for r in sizes.collect()] == [True, False, True]


def test_log_line_drops_nulls(spark, tmp_path):
    rows = spark.createDataFrame([("t", "INFO", "api", "m", "/x", None)], "timestamp string, level string, logger string, message string, path string, status_code int")
    logs.write_log(rows, str(tmp_path / "log"))
    assert json.loads(spark.read.text(str(tmp_path / "log")).first()[0]) == {"timestamp": "t", "level": "INFO", "logger": "api", "message": "m", "path": "/x"}


def test_settings():
    got = config.settings_from({"COLLOQUY_LIMITS__CHAT": "2", "COLLOQUY_LOG_LEVEL": "debug", "OTHER": "1"})
    assert got.limits.chat == 2 and got.limits.register == 5 and got.log_level == "DEBUG"
    with pytest.raises(ValueError):
        config.settings_from({"COLLOQUY_QUOTAS__CHAT": "0"})
    with pytest.raises(ValueError):
        config.settings_from({"COLLOQUY_ENVIRONMENT": "moon"})


def test_ready(spark):
    assert tables.is_ready(spark)


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_rounding_equals_python(spark, digits):
    import random

    r = random.Random(digits)
    values = [0.0, 2.675, 0.125, 0.375, 1.005, 2.5, 3.5, 0.5, 1e-9, 0.005, 0.015, 1234.565, 99.995, 0.05, 0.25, 8.45]
    values += [r.uniform(0, 10 ** r.randint(0, 9)) for _ in range(2000)] + [k / 1000 + 0.0005 for k in range(500)] + [k / 8 for k in range(200)] + [round(r.uniform(0, 100), 3) for _ in range(1000)]
    values += [-v for v in values]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", TM.python_round(F.col("x"), digits).alias("y")).collect()
    assert [r.y for r in sorted(rows, key=lambda r: r.i)] == [round(v, digits) for v in values]


def test_session_has_the_settings_that_results_depend_on(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    session = tables.engine_session("test", **{"spark.sql.adaptive.coalescePartitions.enabled": "true"})
    assert session.conf.get("spark.sql.session.timeZone") == "UTC" and session.conf.get("spark.sql.adaptive.enabled") == "true"
    assert tables.is_ready(session)
    session.conf.set("spark.sql.adaptive.enabled", before)
