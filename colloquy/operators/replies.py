"""Replies: deterministic replies and chunks, event streams, retries, and the plug-in interface."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions.json import COMPACT, json_text
from ..functions.text import REPLY_PREFIX, words_after

METADATA = T.StructType([T.StructField("conversation_id", T.StringType()), T.StructField("user_message", T.StringType())])
CONTENT = T.StructType([T.StructField("content", T.StringType())])


def latest_user_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, latest): conversations without a user turn are left out."""
    return turns.where(F.col("role") == "user").groupBy(key).agg(F.max_by("text", order).alias("latest"))


def mock_replies(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return latest_user_turns(turns, key, order).select(key, F.concat(F.lit(REPLY_PREFIX), "latest").alias("reply"))


def reply_chunks(replies: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, seq, chunk): first word, second word, rest."""
    words = F.split("reply", " ", -1)
    parts = F.array(F.concat(words[0], F.lit(" ")), F.concat(words[1], F.lit(" ")), words_after(F.col("reply"), 2))
    return replies.select(key, F.posexplode(parts).alias("seq", "chunk")).select(key, F.col("seq").cast("long").alias("seq"), "chunk")


def without_empty(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.length("chunk") > 0)


def rejoined(chunks: DataFrame, key: str = "conv_id") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    return chunks.groupBy(key).agg(ordered.alias("c")).select(key, F.array_join(F.transform("c", lambda x: x["chunk"]), "").alias("reply"))


def stream_events(requests: DataFrame, chunks: DataFrame, interrupted: Column, key: str = "conv_id") -> DataFrame:
    """(key, seq, event, data) rows: metadata, chunks, then done; where ``interrupted`` (over the request's
    columns) holds, the first chunk, then error.

    requests: (key, user_message). Data is JSON text: compact for metadata, Python's default style otherwise.
    """
    event = lambda seq, name, data: F.struct(seq.cast("long").alias("seq"), F.lit(name).alias("event") if isinstance(name, str) else name.alias("event"), data.alias("data"))
    sent = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), F.col("chunk").alias("content")))).alias("_sent"))
    asked = requests.withColumn("_stop", interrupted).join(sent, key, "left").withColumn("_sent", F.coalesce("_sent", F.array().cast("array<struct<seq:bigint,content:string>>")))
    asked = asked.withColumn("_sent", F.when(F.col("_stop"), F.filter("_sent", lambda c: c["seq"] == 0)).otherwise(F.col("_sent")))
    meta = event(F.lit(0), "metadata", json_text(F.struct(F.col(key).cast("string").alias("conversation_id"), "user_message"), METADATA, COMPACT))
    parts = F.transform("_sent", lambda c: event(c["seq"] + 1, "chunk", json_text(F.struct(c["content"].alias("content")), CONTENT)))
    last = F.coalesce(F.array_max("_sent")["seq"], F.lit(-1)) + 2
    data = F.when(F.col("_stop"), '{"detail": "LLM provider stream interrupted.", "code": "provider_stream_interrupted"}').otherwise('{"status": "complete"}')
    end = event(last, F.when(F.col("_stop"), "error").otherwise("done"), data)
    return asked.select(key, F.inline(F.concat(F.array(meta), parts, F.array(end))))


def persisted_turns(requests: DataFrame, chunks: DataFrame, events: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, role, content): the user's turn always; the reply only of streams that ended with done."""
    done = events.where(F.col("event") == "done").select(key)
    user = requests.select(key, F.lit("user").alias("role"), F.col("user_message").alias("content"))
    reply = rejoined(chunks.join(done, key, "left_semi"), key).select(key, F.lit("assistant").alias("role"), F.col("reply").alias("content"))
    return user.unionByName(reply)


def sync_turns(requests: DataFrame, outcomes: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, role, content) without streaming: a failed request leaves nothing, not even the user's turn."""
    ok = requests.join(outcomes.where(F.col("error").isNull()).select(key, "reply"), key)
    return ok.select(key, F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("user_message").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")))).alias("t")).select(key, "t.*")


def retry_outcomes(attempts: DataFrame, max_retries: int = 1, key: str = "request_id") -> DataFrame:
    """attempts(key, attempt from 0, code (null: success), emitted): the attempt that decides each request.

    Only provider_unavailable before a first chunk is tried again, max_retries times at most.
    """
    stops = F.col("code").isNull() | (F.col("code") != "provider_unavailable") | (F.col("emitted") > 0) | (F.col("attempt") == max_retries)
    tried = attempts.where(F.col("attempt") <= max_retries)
    best = F.coalesce(F.min(F.when(stops, F.struct("attempt", "code", "emitted"))), F.max(F.struct("attempt", "code", "emitted")))
    return tried.groupBy(key).agg(best.alias("b")).select(key, F.col("b.attempt").alias("attempt"), F.col("b.code").alias("code"), (F.col("b.attempt") + 1).alias("attempts_made"))


#: Attempts of a request: attempt (from 0), code (null: success) and the chunks that went out.
ATTEMPT = "attempt int, code string, chunks array<string>"
#: An attempt with another code is the last one.
RETRYABLE = "provider_unavailable"
#: (histories, streamed, max_retries, key) to rows of key and ATTEMPT.
Provider = Callable[[DataFrame, bool, int, str], DataFrame]

#: What the built-in providers do: the attempts that fail (None: all), the code of a
#: failed reply, the code of a failed stream, and how many chunks of a failed stream go out.
SCRIPTS: dict[str, tuple[int | None, str, str, int]] = {
    "mock": (0, "", "", 0),
    "failing-mock": (None, "provider_unavailable", "provider_unavailable", 0),
    "partial-failing-mock": (None, "provider_unavailable", "provider_stream_interrupted", 1),
    "flaky-mock": (1, "provider_unavailable", "provider_unavailable", 0),
    "timeout-mock": (None, "provider_timeout", "provider_timeout", 0),
}
UNSUPPORTED = (None, "provider_unsupported", "provider_unsupported", 0)


def scripted(script: tuple[int | None, str, str, int]) -> Provider:
    """A provider without Python code on the executors: every attempt is a row of the script."""
    failing, reply_code, stream_code, sent = script

    def attempts(histories: DataFrame, streamed: bool, max_retries: int, key: str) -> DataFrame:
        asked = F.element_at(F.filter("messages", lambda m: m["role"] == "user"), -1)["content"]
        words = F.split(F.concat(F.lit(REPLY_PREFIX), asked), " ", -1)
        chunks = F.array(F.concat(words[0], F.lit(" ")), F.concat(words[1], F.lit(" ")), F.array_join(F.slice(words, 3, F.size(words)), " "))
        fails = F.lit(True) if failing is None else F.col("attempt") < failing
        rows = histories.select(key, chunks.alias("whole"), F.explode(F.sequence(F.lit(0), F.lit(max_retries))).alias("attempt"))
        return rows.select(
            key,
            "attempt",
            F.when(fails, stream_code if streamed else reply_code).alias("code"),
            F.when(fails, F.slice("whole", 1, sent if streamed else 0)).otherwise(F.col("whole")).alias("chunks"),
        )

    return attempts


class ProviderError(Exception):
    """What a plug-in raises: a failure with its error code."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


def failure_code(failed: Exception) -> str:
    if isinstance(failed, ProviderError):
        return failed.code
    kinds = ((TimeoutError, "provider_timeout"), (ConnectionError, RETRYABLE))
    return next((code for kind, code in kinds if isinstance(failed, kind)), "provider_request_failed")


Speak = Callable[[list[dict], int], Iterator[str]]


def attempted(speak: Speak, turns: list[dict], number: int, seconds: float | None = None) -> tuple[str | None, list[str]]:
    """One attempt: its code (null: success) and the chunks that it gave.

    With a deadline the plug-in speaks in a thread of its own. When the time is up the attempt is abandoned
    with provider_timeout, what it gave until then counts, and the task goes on; the thread ends at the
    plug-in's next chunk, if there is one.
    """
    sent: list[str] = []
    if seconds is None:
        try:
            sent.extend(speak(turns, number))
        except Exception as failed:  # whatever a plug-in raises is an outcome
            return failure_code(failed), sent
        return None, sent
    given: queue.Queue = queue.Queue()
    abandoned = threading.Event()

    def work() -> None:
        try:
            for chunk in speak(turns, number):
                if abandoned.is_set():
                    return
                given.put((chunk, None, False))
            given.put((None, None, True))
        except Exception as failed:
            given.put((None, failure_code(failed), True))

    threading.Thread(target=work, daemon=True).start()
    until = time.monotonic() + seconds
    while True:
        try:
            chunk, code, over = given.get(timeout=max(0.0, until - time.monotonic()))
        except queue.Empty:
            abandoned.set()
            return "provider_timeout", sent
        if over:
            return code, sent
        sent.append(chunk)


def attempts_of(speak: Speak, messages: list, streamed: bool, max_retries: int, seconds: float | None = None) -> Iterator[tuple[int, str | None, list[str]]]:
    """(attempt, code, chunks) of the attempts that are made."""
    turns = [dict(m) if isinstance(m, dict) else m.asDict() for m in messages]
    number, code, sent = 0, RETRYABLE, []
    while number <= max_retries and code == RETRYABLE and not (streamed and sent):
        code, sent = attempted(speak, turns, number, seconds)
        yield number, code, sent
        number += 1


def plugged(speak: Speak, seconds: float | None = None, at_once: int = 1) -> Provider:
    """A provider by a Python function: the chunks of a reply, from the turns of a conversation (dicts of
    role and content) and the number of the attempt. Each attempt that is made becomes a row; ``seconds``
    is the time that one attempt may take, ``at_once`` how many requests of a task are open at a time (one
    that is waited for holds up no others; ``speak`` is called from as many threads)."""

    def attempts(histories: DataFrame, streamed: bool, max_retries: int, key: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def tried(messages: list) -> list[tuple[int, str | None, list[str]]]:
                return list(attempts_of(speak, messages if messages is not None else [], streamed, max_retries, seconds))

            with ThreadPoolExecutor(at_once) as pool:
                for pdf in batches:
                    outcomes = pool.map(tried, pdf["messages"])
                    rows = [(k, *made) for k, attempts in zip(pdf[key], outcomes, strict=True) for made in attempts]
                    yield pd.DataFrame(rows, columns=[key, "attempt", "code", "chunks"])

        kind = histories.schema[key].dataType.simpleString()
        return histories.select(key, "messages").mapInPandas(run, f"`{key}` {kind}, {ATTEMPT}")

    return attempts


#: Rows of a reply's table function.
SPOKEN = "seq long, event string, data string"


def reply_function(speak: Speak, max_retries: int = 1, seconds: float | None = None):
    """A table function of a history (array of role and content): the chunks of the attempt that counts, then
    done or error (data: its code). Called in SQL as ``LATERAL name(messages)`` once it is registered, or by
    ``lateralJoin``; rows travel in Arrow batches."""

    class Reply:
        def eval(self, messages: list) -> Iterator[tuple[int, str, str]]:
            code, sent = RETRYABLE, []
            for _, code, sent in attempts_of(speak, messages if messages is not None else [], True, max_retries, seconds):
                pass
            for seq, chunk in enumerate(sent):
                yield seq, "chunk", chunk
            yield len(sent), "done" if code is None else "error", code or ""

    return udtf(Reply, returnType=SPOKEN, useArrow=True)


def register_provider(spark: SparkSession, name: str, speak: Speak, max_retries: int = 1, seconds: float | None = None):
    """The table function under a name of SQL."""
    function = reply_function(speak, max_retries, seconds)
    spark.udtf.register(name, function)
    return function


def spoken(histories: DataFrame, function, key: str = "conv_id") -> DataFrame:
    """(key, seq, event, data) of histories(key, messages)."""
    return histories.lateralJoin(function(F.col("messages").outer())).select(key, "seq", "event", "data")


def mock_chunks(turns: list[dict], attempt: int) -> Iterator[str]:
    """The mock provider as a plug-in: first word, second word, rest."""
    words = (REPLY_PREFIX + next(t["content"] for t in reversed(turns) if t["role"] == "user")).split(" ")
    yield words[0] + " "
    yield words[1] + " "
    yield " ".join(words[2:])


def provider(name: str, extra: dict[str, Provider] | None = None) -> Provider:
    """The provider of a name, whatever its case; an unknown name fails."""
    known = {n: scripted(s) for n, s in SCRIPTS.items()} | (extra or {})
    return known.get(name.strip().lower(), scripted(UNSUPPORTED))


def decided(histories: DataFrame, made: Provider, streamed: bool, max_retries: int, key: str) -> DataFrame:
    """The attempt that decides each request, with its chunks."""
    attempts = made(histories, streamed, max_retries, key).withColumn("emitted", F.size("chunks") if streamed else F.lit(0))
    last = retry_outcomes(attempts, max_retries, key)
    return last.join(attempts.select(key, "attempt", "chunks"), [key, "attempt"])


def provider_replies(histories: DataFrame, made: Provider, max_retries: int = 1, key: str = "conv_id") -> DataFrame:
    """(key, reply, error, attempts) of histories(key, messages array<struct<role,content>>)."""
    reply = F.when(F.col("code").isNull(), F.array_join("chunks", ""))
    return decided(histories, made, False, max_retries, key).select(key, reply.alias("reply"), F.col("code").alias("error"), F.col("attempts_made").alias("attempts"))


def provider_chunks(histories: DataFrame, made: Provider, max_retries: int = 1, key: str = "conv_id") -> DataFrame:
    """(key, seq, event, data) of the same histories: chunks, then done or error (data: its code)."""
    sent = F.transform("chunks", lambda x: F.struct(F.lit("chunk").alias("event"), x.alias("data")))
    end = F.struct(F.when(F.col("code").isNull(), "done").otherwise("error").alias("event"), F.coalesce("code", F.lit("")).alias("data"))
    rows = decided(histories, made, True, max_retries, key).select(key, F.posexplode(F.concat(sent, F.array(end))).alias("seq", "x"))
    return rows.select(key, F.col("seq").cast("long").alias("seq"), "x.event", "x.data")
