"""The queries over the driver's tables, each with the SQL that gives the same rows.

The tables are structural analogs: customer stands for users, orders for conversations (and, with
hashed keys, for refresh tokens), lineitem for messages to be counted, conversations for messages
with text, events for hits of limiters and for JSON bodies.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions import time as TM
from .functions.json import COMPACT, with_json
from .operators import buckets, limiters, relations, replies, versions
from .plans.errors import CODES, error_codes
from .plans.limits import limit_table
from .sources import deltas
from .sources.database import database_file_table
from .sources.files import store
from .sources.logs import log_line
from .sources.requests import CHAT, credential_requests, said_faults, typed
from .sources.requests import refresh_requests as parse_refresh_requests
from .sources.requests import within_body_limit
from .sources.shared import shared_folder, written
from .sources.tables import parquet_table as table
from .sources.tables import readiness as engine_readiness
from .streaming.limiter import first_hit_expiring
from .streaming.replies import persisted_stream
from .streaming.state import SLOTS, replayed, run_to_end

DAY = 86_400
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("conversation_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))


def counted_messages(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("l_linestatus") == "O", "user").when(F.col("l_linestatus") == "F", "assistant").otherwise("system")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("conversation_id"), role.alias("role"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    made = TM.as_utc(F.col("o_orderdate"))
    return table(spark, d, "orders").select(
        X.token_hash(F.col("o_orderkey").cast("string")).alias("token_hash"),
        F.col("o_custkey").alias("user_id"),
        TM.plus_days(made, 7).alias("expires_at"),
        F.when(F.col("o_orderstatus") == "F", made).alias("revoked_at"),
        F.col("o_orderkey").alias("token_id"),
    )


TOKENS_SQL = """tokens as (
  select sha256(cast(o_orderkey as varchar)) as token_hash, o_custkey as user_id, o_orderdate + interval 7 day as expires_at,
    case when o_orderstatus = 'F' then o_orderdate end as revoked_at, o_orderkey as token_id from orders
)"""
AS_OF = "1996-06-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query("""
select c_custkey as user_id,
  (select count(*) from orders o where o.o_custkey = c.c_custkey) as conversation_count,
  (select count(*) from orders o join lineitem l on l.l_orderkey = o.o_orderkey where o.o_custkey = c.c_custkey) as message_count,
  (select count(*) from orders o join lineitem l on l.l_orderkey = o.o_orderkey where o.o_custkey = c.c_custkey and l_linestatus = 'O') as user_message_count,
  (select count(*) from orders o join lineitem l on l.l_orderkey = o.o_orderkey where o.o_custkey = c.c_custkey and l_linestatus = 'F') as assistant_message_count
from customer c""")
def usage_summary(spark, d):
    return relations.usage_summary(users(spark, d), conversations(spark, d), counted_messages(spark, d))


@query("""
with c as (
  select o_orderkey as conversation_id, o_custkey as user_id, o_orderdate as created_at, count(l_orderkey) as message_count
  from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2, 3
) select *, row_number() over (partition by user_id order by created_at desc, conversation_id desc) as newest_rank from c""")
def conversation_list(spark, d):
    return relations.conversation_list(conversations(spark, d), counted_messages(spark, d))


@query("""
select conv_id, string_agg(role || ':' || text, '|' order by turn) as history, count(*) as n from conversations group by conv_id""")
def conversation_history(spark, d):
    t = turns(spark, d)
    nested = relations.histories(t.select("conv_id").distinct(), t, "conv_id", ["turn"], ["role", "text"])
    return nested.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|").alias("history"), F.size("messages").cast("long").alias("n"))


@query("select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as position from conversations")
def history_rows(spark, d):
    return relations.history_rows(turns(spark, d), "conv_id", ["turn"])


@query("select c_custkey as user_id, c_name as email from customer where c_name = 'Customer#000000007'")
def user_by_email(spark, d):
    return relations.by_key(users(spark, d), "email", "Customer#000000007")


@query("select o_orderkey as conversation_id, o_custkey as user_id, o_orderdate as created_at from orders where o_orderkey = 7 and o_custkey = (select o_custkey from orders where o_orderkey = 7)")
def owned_conversation(spark, d):
    c = conversations(spark, d)
    owner = c.where("conversation_id = 7").agg(F.max("user_id")).first()[0]  # one value
    return relations.owned(c, "conversation_id", 7, "user_id", owner)


@query("""
select o.o_orderkey as conversation_id, o.o_custkey + o.o_orderkey % 2 as user_id, m.o_orderdate as created_at,
  case when m.o_orderkey is null then 'chat_conversation_missing' end as error
from orders o left join orders m on m.o_orderkey = o.o_orderkey and m.o_custkey = o.o_custkey + o.o_orderkey % 2""")
def owned_lookup(spark, d):
    """Every other request asks for another user's conversation."""
    c = conversations(spark, d)
    asked = c.select("conversation_id", (F.col("user_id") + F.col("conversation_id") % 2).alias("user_id"))
    return relations.looked_up(asked, c, ["conversation_id", "user_id"], ["created_at"])


REPLY_SQL = """replies as (
  select conv_id, 'Mock assistant reply: ' || arg_max(text, turn) as reply from conversations where role = 'user' group by conv_id
), w as (select conv_id, reply, string_split(reply, ' ') as w from replies), chunks as (
  select conv_id, 0 as seq, w[1] || ' ' as chunk from w union all select conv_id, 1, w[2] || ' ' from w
  union all select conv_id, 2, array_to_string(w[3:], ' ') from w
)"""


@query(f"with {REPLY_SQL} select conv_id, reply from replies")
def mock_reply(spark, d):
    return replies.mock_replies(turns(spark, d))


@query(f"with {REPLY_SQL} select conv_id, cast(seq as bigint) as seq, chunk from chunks")
def reply_chunks(spark, d):
    return replies.reply_chunks(replies.mock_replies(turns(spark, d)))


@query(f"with {REPLY_SQL} select conv_id, string_agg(chunk, '' order by seq) as reply from chunks where length(chunk) > 0 group by conv_id")
def rejoined_reply(spark, d):
    return replies.rejoined(replies.without_empty(reply_chunks(spark, d)))


def recorded_replies(spark, d):
    """A folder of event-stream text: the replies' chunks, as a provider sends them."""
    chunk = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("chunk").alias("content")).alias("delta"))).alias("choices")))
    sent = reply_chunks(spark, d).withColumn("line", F.concat(F.lit("data: "), chunk, F.lit("\n\n")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "")
    text = sent.groupBy("conv_id").agg(lines.alias("lines")).select(F.concat(F.lit("id: "), "conv_id", F.lit("\n"), "lines", F.lit("data: [DONE]\n")))
    folder = f"{shared_folder(spark).rstrip('/')}/recorded-{uuid.uuid4().hex}"
    text.write.text(folder)
    deltas.register(spark)
    return folder


def numbered_deltas(rows):
    place = F.row_number().over(Window.partitionBy("request").orderBy("file", "offset"))
    rows = rows.where("not done").withColumn("seq", (place - 1).cast("long"))
    return rows.select(F.col("request").cast("long").alias("conv_id"), "seq", F.col("delta").alias("chunk"))


RECORDED_SQL = f"""with {REPLY_SQL} select conv_id, row_number() over (partition by conv_id order by seq) - 1 as seq, chunk from chunks where length(chunk) > 0"""


@query(RECORDED_SQL)
def recorded_deltas(spark, d):
    return numbered_deltas(spark.read.format("deltas").load(recorded_replies(spark, d)))


@query(RECORDED_SQL)
def recorded_deltas_streamed(spark, d):
    folder = recorded_replies(spark, d)
    stream = spark.readStream.format("deltas").load(folder)
    run_to_end(stream, f"{folder}-out", f"{folder}-state")
    return numbered_deltas(spark.read.schema(stream.schema).parquet(f"{folder}-out"))


EVENTS_SQL = f"""{REPLY_SQL}, asked as (
  select conv_id, arg_max(text, turn) as user_message, conv_id % 5 = 0 as stop from conversations where role = 'user' group by conv_id
), sent as (select c.*, stop from chunks c join asked using (conv_id) where not stop or seq = 0), streamed as (
  select conv_id, 0 as seq, 'metadata' as event, conv_id || '/' || user_message as content from asked
  union all select conv_id, seq + 1, 'chunk', chunk from sent
  union all select conv_id, case when stop then 2 else 4 end, case when stop then 'error' else 'done' end, case when stop then 'provider_stream_interrupted' else 'complete' end from asked
)"""


def asked_and_events(spark, d):
    asked = replies.latest_user_turns(turns(spark, d)).withColumnRenamed("latest", "user_message")
    chunks = reply_chunks(spark, d)
    return asked, chunks, replies.stream_events(asked, chunks, F.col("conv_id") % 5 == 0)


@query(f"with {EVENTS_SQL} select conv_id, cast(seq as bigint) as seq, event, content from streamed")
def stream_events(spark, d):
    """The JSON data are compared by what they hold."""
    events = asked_and_events(spark, d)[2]
    got = F.from_json("data", "conversation_id string, user_message string, content string, code string, status string")
    content = F.coalesce(F.concat_ws("/", got["conversation_id"], got["user_message"], got["content"], got["code"], got["status"]))
    return events.select("conv_id", "seq", "event", content.alias("content"))


@query(f"with {EVENTS_SQL} select conv_id, 'user' as role, user_message as content from asked union all select conv_id, 'assistant', reply from replies join asked using (conv_id) where not stop")
def persisted_turns(spark, d):
    return replies.persisted_turns(*asked_and_events(spark, d))


@query(f"with {EVENTS_SQL} select conv_id, 'user' as role, user_message as content from asked union all select conv_id, 'assistant', reply from replies join asked using (conv_id) where not stop")
def persisted_turns_streamed(spark, d):
    """The event streams of all conversations at once: what comes with odd numbers, then the rest, the last events first."""
    events = asked_and_events(spark, d)[2]
    late = F.col("seq") % 2 == 0
    return replayed([events.where(~late), events.where(late).orderBy(F.desc("seq"))], lambda e: persisted_stream(e, slots=SLOTS))


@query("select doc_id, coalesce(substr(text, 1, 80), 'Untitled conversation') as title, length(text) between 1 and 4000 as length_ok, strlen(text) <= 16384 as body_ok from documents")
def message_checks(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.title_of(t).alias("title"), X.length_between(t, 1, 4000).alias("length_ok"), within_body_limit(F.octet_length(t)).alias("body_ok"))


@query(r"""
select doc_id, regexp_replace(x, '^[ \t\n\r\f\v\x{1c}-\x{1f}\x{85}\p{Z}]+|[ \t\n\r\f\v\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') as stripped
from (select doc_id, chr(160) || chr(9) || text || chr(12288) || chr(8203) || chr(10) as x from documents)""")
def normalized_text(spark, d):
    padded = F.concat(F.lit(" \t"), "text", F.lit("　​\n"))
    return table(spark, d, "documents").select("doc_id", X.strip(padded).alias("stripped"))


@query("select conv_id, turn, sha256(text) as token_hash from conversations")
def token_hashes(spark, d):
    return turns(spark, d).select("conv_id", "turn", X.token_hash(F.col("text")).alias("token_hash"))


@query(f"with {TOKENS_SQL} select token_id, token_hash, user_id from tokens where revoked_at is null and expires_at > timestamp '{AS_OF}'")
def active_tokens_as_of(spark, d):
    return versions.active_tokens(tokens(spark, d), as_of()).select("token_id", "token_hash", "user_id")


@query(f"""with {TOKENS_SQL} select token_id, token_hash,
  coalesce(epoch_us(case when token_id % 3 = 0 and revoked_at is null then timestamp '{AS_OF}' else revoked_at end), -1) as revoked_us from tokens""")
def revoke_tokens(spark, d):
    t = tokens(spark, d)
    return versions.revoked(t, t.where("token_id % 3 = 0"), as_of()).select("token_id", "token_hash", F.coalesce(F.unix_micros("revoked_at"), F.lit(-1)).alias("revoked_us"))


@query(f"""with {TOKENS_SQL}, live as (
  select * from tokens where token_id % 4 = 0 and revoked_at is null and expires_at > timestamp '{AS_OF}'
) select token_hash, user_id, epoch_us(expires_at) as expires_us,
  coalesce(epoch_us(case when token_hash in (select token_hash from live) then timestamp '{AS_OF}' else revoked_at end), -1) as revoked_us from tokens
union all select sha256('new-' || token_id), user_id, epoch_us(timestamp '{AS_OF}' + interval 7 day), -1 from live""")
def rotate_tokens(spark, d):
    t = tokens(spark, d)
    presented = t.where("token_id % 4 = 0").select("token_hash", F.concat(F.lit("new-"), "token_id").alias("new_token"))
    return versions.rotated(t, presented, as_of(), 7).select("token_hash", "user_id", F.unix_micros("expires_at").alias("expires_us"), F.coalesce(F.unix_micros("revoked_at"), F.lit(-1)).alias("revoked_us"))


def tokens_in_buckets(spark, d):
    """The tokens as a stored table of 64 buckets; its name."""
    name = f"tokens_{uuid.uuid4().hex}"
    buckets.create(tokens(spark, d), name, "token_hash", 64, f"{shared_folder(spark).rstrip('/')}/{name}")
    return name


@query(f"""with {TOKENS_SQL} select token_id, token_hash,
  coalesce(epoch_us(case when user_id % 75 = 7 and revoked_at is null then timestamp '{AS_OF}' else revoked_at end), -1) as revoked_us from tokens""")
def revoke_in_buckets(spark, d):
    """Some users' tokens are revoked in place: their buckets are rewritten."""
    name = tokens_in_buckets(spark, d)
    buckets.revoke(spark, name, tokens(spark, d).where("user_id % 75 = 7"), as_of())
    return buckets.rows_of(spark, name).select("token_id", "token_hash", F.coalesce(F.unix_micros("revoked_at"), F.lit(-1)).alias("revoked_us"))


@query(f"""with {TOKENS_SQL}, live as (
  select * from tokens where user_id % 75 = 7 and revoked_at is null and expires_at > timestamp '{AS_OF}'
) select token_hash, user_id, epoch_us(expires_at) as expires_us,
  coalesce(epoch_us(case when token_hash in (select token_hash from live) then timestamp '{AS_OF}' else revoked_at end), -1) as revoked_us from tokens
union all select sha256('new-' || token_id), user_id, epoch_us(timestamp '{AS_OF}' + interval 7 day), -1 from live""")
def rotate_in_buckets(spark, d):
    name = f"tokens_{uuid.uuid4().hex}"
    t = tokens(spark, d)
    buckets.create(t.drop("token_id").select("token_hash", "user_id", "expires_at", "revoked_at"), name, "token_hash", 64, f"{shared_folder(spark).rstrip('/')}/{name}")
    presented = t.where("user_id % 75 = 7").select("token_hash", F.concat(F.lit("new-"), "token_id").alias("new_token"))
    buckets.rotate(spark, name, presented, as_of(), 7)
    return buckets.rows_of(spark, name).select("token_hash", "user_id", F.unix_micros("expires_at").alias("expires_us"), F.coalesce(F.unix_micros("revoked_at"), F.lit(-1)).alias("revoked_us"))


FIRST_HIT_SQL = """
with recursive h as (
  select event_type, user_id, event_id, epoch_us(ts) as t, row_number() over (partition by event_type, user_id order by ts, event_id) as n from events
), f as (
  select event_type, user_id, event_id, n, t as open, 1 as used, true as allowed from h where n = 1
  union all
  select h.event_type, h.user_id, h.event_id, h.n, case when h.t >= f.open + 86400000000 then h.t else f.open end,
    case when h.t >= f.open + 86400000000 then 1 when f.used < 2 then f.used + 1 else f.used end,
    h.t >= f.open + 86400000000 or f.used < 2
  from f join h on h.event_type = f.event_type and h.user_id = f.user_id and h.n = f.n + 1
) select event_type, user_id, event_id, allowed from f"""
HIT_KEYS = ["event_type", "user_id"]


@query(FIRST_HIT_SQL)
def limiter_first_hit(spark, d):
    return limiters.first_hit_windows(table(spark, d, "events"), HIT_KEYS, 2, DAY).drop("ts")


@query("""
with recursive h as (
  select event_type, event_id, epoch_us(ts) as t, row_number() over (partition by event_type order by ts, event_id) as n from events
), f as (
  select event_type, event_id, n, t as open, 1 as used, true as allowed from h where n = 1
  union all
  select h.event_type, h.event_id, h.n, case when h.t >= f.open + 7200000000 then h.t else f.open end, case when h.t >= f.open + 7200000000 then 1 else f.used + 1 end, h.t >= f.open + 7200000000 or f.used < 3
  from f join h on h.event_type = f.event_type and h.n = f.n + 1
) select event_type, event_id, allowed from f""")
def limiter_hot_key(spark, d):
    """Five keys hold all hits; each is settled by many tasks."""
    return limiters.first_hit_windows(table(spark, d, "events"), ["event_type"], 3, 7200, spread=True).drop("ts")


@query(FIRST_HIT_SQL.replace("f.used < 2", "f.used < 3"))
def limiter_first_hit_streamed(spark, d):
    """Events arrive in three parts of ten days, in any order inside a part; a far hit of no key ends the stream."""
    events = table(spark, d, "events").select(*HIT_KEYS, F.col("ts").cast("timestamp").alias("ts"), "event_id")
    third = F.least(F.floor((F.unix_seconds("ts") - F.lit(1_704_067_200)) / (10 * DAY)), F.lit(2))
    end = events.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("string").alias("event_type"), F.lit(-1).cast("long").alias("user_id"), F.expr("ts + interval 400 days").alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    arriving = [events.where(third <= 0), events.where(third == 1), events.where(third == 2), end]
    return replayed(arriving, lambda hits: first_hit_expiring(hits, HIT_KEYS, 3, DAY, 11 * DAY, slots=SLOTS)).drop("ts")


#: The limits of the routes and of the users, by place.
BINDINGS_SQL = """b(place, kind, action, most, span, code) as (values (0, 'rate', 'auth_register', 5, 60, 'rate_limit_exceeded'), (1, 'rate', 'auth_token', 10, 60, 'rate_limit_exceeded'),
  (2, 'rate', 'chat_messages', 30, 60, 'rate_limit_exceeded'), (3, 'rate', 'chat_stream', 15, 60, 'rate_limit_exceeded'), (4, 'quota', 'chat', 100, 3600, 'quota_exceeded'), (5, 'quota', 'chat_stream', 50, 3600, 'quota_exceeded'))"""
LIMITED_SQL = f"""
with recursive {BINDINGS_SQL}, h as (
  select kind, action || ':' || user_id % 3 as bucket_key, most, span * 1000000::bigint as span, code, event_id, epoch_us(ts) // 8000 as t from events join b on event_id % 6 = place
), n as (
  select *, row_number() over (partition by kind, bucket_key order by t, event_id) as n from h
), f as (
  select kind, bucket_key, event_id, n, most, span, code, t as open, 1 as used, true as allowed from n where n.n = 1
  union all
  select n.kind, n.bucket_key, n.event_id, n.n, n.most, n.span, n.code, case when n.t >= f.open + n.span then n.t else f.open end,
    case when n.t >= f.open + n.span then 1 else f.used + 1 end, n.t >= f.open + n.span or f.used < n.most
  from f join n on n.kind = f.kind and n.bucket_key = f.bucket_key and n.n = f.n + 1
) select kind, bucket_key, event_id, allowed, case when not allowed then code end as error, case when not allowed then 429 end as http_status from f"""


def bound_hits(spark, d):
    """Events as hits of the six limits in turn, of three addresses or users, 8,000 times as fast as they came."""
    bound = [("rate", "auth_register"), ("rate", "auth_token"), ("rate", "chat_messages"), ("rate", "chat_stream"), ("quota", "chat"), ("quota", "chat_stream")]
    places = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(action).alias("action")) for kind, action in bound))
    binding = F.element_at(places, (F.col("event_id") % 6 + 1).cast("int"))
    sooner = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 8000))
    return table(spark, d, "events").select(binding["kind"].alias("kind"), binding["action"].alias("action"), (F.col("user_id") % 3).cast("string").alias("who"), sooner.alias("ts"), "event_id")


@query(LIMITED_SQL)
def limits_applied(spark, d):
    return limiters.limited(bound_hits(spark, d), limit_table(spark), spread=True).drop("ts")


@query("""
select event_type, user_id, event_id, row_number() over (partition by event_type, user_id, epoch_us(ts) // 86400000000 order by ts, event_id) <= 2 as allowed from events""")
def limiter_epoch(spark, d):
    return limiters.epoch_windows(table(spark, d, "events"), HIT_KEYS, 2, DAY).drop("ts")


@query("""
with recursive h as (
  select event_type, event_id, epoch_ms(ts) // 4000 as t, row_number() over (partition by event_type order by epoch_ms(ts) // 4000, event_id) as n from events
), f as (
  select event_type, event_id, n, t as last, cast(0 as double) as excess, true as allowed from h where n = 1
  union all
  select event_type, event_id, n, case when more <= 20000 then t else last end, case when more <= 20000 then more else excess end, more <= 20000
  from (select h.event_type, h.event_id, h.n, h.t, f.last, f.excess, greatest(f.excess - 0.5::double * (h.t - f.last) + 1000, 0) as more from f join h on h.event_type = f.event_type and h.n = f.n + 1)
) select event_type, event_id, allowed from f""")
def proxy_limit(spark, d):
    """Events 4,000 times as fast as they came, so that some are refused."""
    sooner = F.timestamp_millis(F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 4000))
    return limiters.leaky_bucket(table(spark, d, "events").select("event_type", "event_id", sooner.alias("ts")), ["event_type"], 30, 20)


@query("""
select * from (values ('auth_register', 'rate', 5, 60, 'rate_limit_exceeded'), ('auth_token', 'rate', 10, 60, 'rate_limit_exceeded'),
  ('chat_messages', 'rate', 30, 60, 'rate_limit_exceeded'), ('chat_stream', 'rate', 15, 60, 'rate_limit_exceeded'),
  ('chat', 'quota', 100, 3600, 'quota_exceeded'), ('chat_stream', 'quota', 50, 3600, 'quota_exceeded')) t(action, kind, "limit", window_seconds, error)""")
def limit_parameters(spark, d):
    return limit_table(spark)


@query("""
select 2 * c_custkey + 1000000 as user_id, c_name || '-new' as email from customer where c_custkey % 2 = 1""")
def register_dedupe(spark, d):
    """Users of even keys exist; all come again twice, the odd ones under new names."""
    u = users(spark, d)
    there = u.where("user_id % 2 = 0")
    again = u.select(F.when(F.col("user_id") % 2 == 0, F.col("email")).otherwise(F.concat("email", F.lit("-new"))).alias("email"), (F.col("user_id") * 2 + 1_000_000).alias("user_id"))
    incoming = again.withColumn("arrival", F.col("user_id")).unionByName(again.withColumn("arrival", F.col("user_id") + 1))
    return versions.new_users(there, incoming).select("user_id", "email")


@query("""
select o_orderkey as conversation_id, o_custkey as user_id, 'Untitled conversation' as title from orders where o_orderkey % 10 = 0
union all select o_orderkey, o_custkey, o_orderpriority from orders where o_orderkey % 10 <> 0""")
def insert_defaults(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("conversation_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("title"))
    titled = rows.withColumn("title", X.title_of(F.col("title")))
    even = F.col("conversation_id") % 2 == 0
    return versions.inserted(titled.where(even), titled.where(~even))  # half of them are there already


@query("""
select r.conv_id as request_id, r.conv_id % 50 + 1 as user_id, case when r.conv_id % 3 > 0 then r.conv_id + 1 else -1 end as conversation_id,
  case when r.conv_id % 3 = 0 then substr(r.text, 1, 80) else o.o_orderpriority end as title,
  case when r.conv_id % 3 = 0 then 'created' when o.o_orderkey is not null then 'loaded' else 'chat_conversation_missing' end as outcome
from conversations r left join orders o on r.conv_id % 3 > 0 and o.o_orderkey = r.conv_id + 1 and o.o_custkey = r.conv_id % 50 + 1 where r.turn = 0""")
def load_or_create(spark, d):
    there = table(spark, d, "orders").select(F.col("o_orderkey").alias("conversation_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"))
    i = F.col("conv_id")
    asked = turns(spark, d).where("turn = 0").select(i.alias("request_id"), (i % 50 + 1).alias("user_id"), F.when(i % 3 > 0, i + 1).alias("conversation_id"), F.col("text").alias("message"))
    return versions.loaded_or_created(asked, there).withColumn("conversation_id", F.coalesce("conversation_id", F.lit(-1)))


@query("""
select 'users' as what, count(*) as n from customer where c_custkey % 7 <> 0
union all select 'conversations', count(*) from orders where o_custkey % 7 <> 0
union all select 'messages', count(*) from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 7 <> 0
union all select 'refresh_tokens', count(*) from orders where o_custkey % 7 <> 0""")
def cascade_delete(spark, d):
    left = versions.deleted_with_children({"users": users(spark, d), "conversations": conversations(spark, d), "messages": counted_messages(spark, d), "refresh_tokens": tokens(spark, d)}, users(spark, d).where("user_id % 7 = 0").select("user_id"))
    parts = [frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, frame in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


@query("""
select 'users' as what, c_custkey as id, null::bigint as parent from customer where c_custkey % 7 <> 0
union all select 'conversations', o_orderkey, o_custkey from orders where o_custkey % 7 <> 0
union all select 'messages', l_linenumber, l_orderkey from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 7 <> 0
union all select 'refresh_tokens', o_orderkey, o_custkey from orders where o_custkey % 7 <> 0""")
def cascade_delete_rows(spark, d):
    """The rows that are left, table by table."""
    messages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("conversation_id"), F.col("l_linenumber").alias("id"))
    tables = {"users": users(spark, d), "conversations": conversations(spark, d), "messages": messages, "refresh_tokens": tokens(spark, d)}
    left = versions.deleted_with_children(tables, users(spark, d).where("user_id % 7 = 0").select("user_id"))
    named = {"users": ("user_id", None), "conversations": ("conversation_id", "user_id"), "messages": ("id", "conversation_id"), "refresh_tokens": ("token_id", "user_id")}
    parts = [left[n].select(F.lit(n).alias("what"), F.col(i).cast("long").alias("id"), (F.col(p) if p else F.lit(None)).cast("long").alias("parent")) for n, (i, p) in named.items()]
    return functools.reduce(DataFrame.unionAll, parts)


@query("""
select event_id, trim(case event_id % 4 when 0 then ' ' when 1 then '' else event_type end) = '' as blank, user_id * 60 as lifetime, 'LLM provider timed out after ' || printf('%.1f', event_id / 8.0::double) || ' seconds.' as message,
  round_even(event_id / 8.0::double, 2) as elapsed, event_id % 5 > 0 as positive, regexp_full_match(case event_id % 3 when 0 then event_type || '@example.org' when 1 then event_type || '@x' else event_type end, '.+@.+[.].+') as email from events""")
def value_checks(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    kind = F.col("event_type")
    text = F.when(i % 4 == 0, " \t\u3000").when(i % 4 == 1, "").otherwise(F.concat(F.lit("\u00a0"), kind))
    email = F.when(i % 3 == 0, F.concat(kind, F.lit("@example.org"))).when(i % 3 == 1, F.concat(kind, F.lit("@x"))).otherwise(kind)
    seconds = i.cast("double") / 8.0
    return e.select("event_id", X.is_blank(text).alias("blank"), TM.lifetime_seconds(F.col("user_id")).alias("lifetime"), TM.timed_out_message(seconds).alias("message"), TM.python_round(seconds, 2).alias("elapsed"), (i % 5 > 0).alias("positive"), X.is_email(email).alias("email"))


@query("""
with t as (
  select conv_id, list({'role': role, 'content': text, 'created_at': strftime(timestamp '2026-01-01' + to_minutes(turn), '%Y-%m-%dT%H:%M:%S+00:00')} order by turn) as messages, arg_min(text, turn) as first from conversations group by conv_id
) select conv_id, to_json({'id': conv_id::varchar, 'title': substr(first, 1, 80), 'messages': messages})::varchar as body from t""")
def history_responses(spark, d):
    """The body of a conversation's history, as it is sent."""
    made = TM.iso_format(F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("turn").cast("int")))
    t = turns(spark, d).select("conv_id", "turn", "role", F.col("text").alias("content"), made.alias("created_at"))
    first = t.groupBy("conv_id").agg(F.min_by("content", "turn").alias("first"))
    rows = relations.histories(first, t, "conv_id", ["turn"], ["role", "content", "created_at"])
    value = F.struct(F.col("conv_id").cast("string").alias("id"), X.title_of(F.col("first")).alias("title"), "messages")
    return with_json(rows, "body", value, COMPACT).select("conv_id", "body")


@query("select l_orderkey as conversation_id, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 9 <> 0) group by 1")
def orphans(spark, d):
    parents = conversations(spark, d).where("conversation_id % 9 <> 0")
    return relations.orphans(counted_messages(spark, d), parents, "conversation_id", "conversation_id").groupBy("conversation_id").agg(F.count("*").alias("n"))


@query("""
select o_orderkey as conversation_id, c_name as email from orders join customer on c_custkey = o_custkey""")
def conversation_owner(spark, d):
    return conversations(spark, d).join(users(spark, d), "user_id").select("conversation_id", "email")


@query("""
with a as (
  select event_id // 3 as request_id, event_id % 3 as attempt,
    case when event_type in ('click', 'view') then 'provider_unavailable' when event_type = 'purchase' then 'provider_timeout' end as code, 0 as emitted from events
), t as (select * from a where attempt <= 1), s as (
  select *, code is null or code <> 'provider_unavailable' or attempt = 1 as stops from t
), p as (
  select *, row_number() over (partition by request_id order by case when stops then 0 else 1 end, case when stops then attempt else -attempt end) as n from s
) select request_id, attempt, code, attempt + 1 as attempts_made from p where n = 1""")
def retry_outcome(spark, d):
    e = table(spark, d, "events")
    code = F.when(F.col("event_type").isin("click", "view"), "provider_unavailable").when(F.col("event_type") == "purchase", "provider_timeout")
    attempts = e.select(F.floor(F.col("event_id") / 3).alias("request_id"), (F.col("event_id") % 3).alias("attempt"), code.alias("code"), F.lit(0).alias("emitted"))
    return replies.retry_outcomes(attempts, 1)


@query("select * from (values " + ", ".join(f"('{c}', {s})" for c, s in CODES) + ") t(code, http_status)")
def error_code_table(spark, d):
    return error_codes(spark)


@query("select true as database_ready, 'ready' as status")
def readiness(spark, d):
    return engine_readiness(spark)


@query("""
select event_id, case when epoch_us(ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') end as iso,
  cast(json_extract_string(props, '$.k') as bigint) as k, epoch_us(ts + interval 30 day) as later_us from events""")
def event_times(spark, d):
    ts = TM.as_utc(F.col("ts"))
    return table(spark, d, "events").select("event_id", TM.iso_format(ts).alias("iso"), F.from_json("props", "k long")["k"].alias("k"), F.unix_micros(TM.plus_days(ts, 30)).alias("later_us"))


@query("""
select event_id, json_extract_string(l, '$.level') as level, json_extract_string(l, '$.path') as path from (
  select event_id, case when event_id % 2 = 0 then json_object('level', 'INFO', 'path', '/' || event_type) else json_object('level', 'INFO') end as l from events)""")
def log_lines(spark, d):
    e = table(spark, d, "events")
    rows = e.select("event_id", TM.iso_format(F.col("ts")).alias("timestamp"), F.lit("INFO").alias("level"), F.lit("api").alias("logger"), F.col("event_type").alias("message"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/"), "event_type")).alias("path"))
    line = F.from_json(log_line(rows), "level string, path string")
    return rows.select("event_id", line["level"].alias("level"), line["path"].alias("path"))


@query("select conv_id, turn, case when role in ('user', 'assistant', 'system') then role else 'developer' end as payload_role, 'Mock assistant reply: ' || text as said from conversations")
def payload_roles(spark, d):
    return turns(spark, d).select("conv_id", "turn", relations.payload_role(F.col("role")).alias("payload_role"), F.concat(F.lit(X.REPLY_PREFIX), "text").alias("said"))


@query("select conv_id, turn, json_quote(text) as literal from (select conv_id, turn, regexp_replace(text, '[^ -~\n]', '?', 'g') as text from conversations)")
def json_literals(spark, d):
    plain = F.regexp_replace("text", r"[^ -~\n]", "?")
    return turns(spark, d).select("conv_id", "turn", X.python_json_string(plain).alias("literal"))


@query("""
select cast(o_orderkey as varchar) as id, substr(o_orderpriority, 1, 80) as title, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') as created_at,
  (select count(*) from lineitem where l_orderkey = o_orderkey) as message_count, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as newest_rank from orders""")
def conversation_summaries(spark, d):
    titled = conversations(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("conversation_id"), F.col("o_orderpriority").alias("title")), "conversation_id")
    return relations.summaries(titled, counted_messages(spark, d))


@query(f"""with {REPLY_SQL}, t as (
  select conv_id, turn, role, text from conversations
  union all select conv_id, 1000, 'user', 'again' from (select distinct conv_id from conversations)
  union all select conv_id, 1001, 'assistant', reply from replies
) select conv_id, string_agg(role || ':' || text, '|' order by turn) as history, count(*) as n from t group by conv_id""")
def stored_turns(spark, d):
    """Each conversation gets a user's turn and the reply to the one before, and is read back."""
    t = turns(spark, d)
    asked = t.select("conv_id").distinct().select("conv_id", F.lit(1000).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("again").alias("text"))
    answered = replies.mock_replies(t).select("conv_id", F.lit(1001).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text"))
    back = relations.stored_and_read(t, asked.unionByName(answered))
    return back.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|").alias("history"), F.size("messages").cast("long").alias("n"))


@query("select count(*) as n, count(*) as ids, count(*) as well_formed, count(*) as dated from orders")
def keyed_inserts(spark, d):
    rows = versions.with_defaults(table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(X.is_uuid(F.col("id"))).alias("well_formed"), F.count("created_at").alias("dated"))


@query(f"""with {TOKENS_SQL} select token_hash, user_id, epoch_us(expires_at) as expires_us, revoked_at is null as open from tokens
union all select sha256('login-' || c_custkey), c_custkey, epoch_us(timestamp '{AS_OF}' + interval 7 day), true from customer""")
def issue_tokens(spark, d):
    """Every user logs in."""
    logins = users(spark, d).select("user_id", F.concat(F.lit("login-"), "user_id").alias("new_token"))
    return versions.issued(tokens(spark, d), logins, as_of(), 7).select("token_hash", "user_id", F.unix_micros("expires_at").alias("expires_us"), F.col("revoked_at").isNull().alias("open"))


@query(f"""with {TOKENS_SQL}, p as (select o_orderkey as request_id, sha256(cast(o_orderkey + (o_orderkey % 5 = 0)::int * 100000000 as varchar)) as token_hash from orders)
select request_id, p.token_hash, case when t.token_hash is null or t.revoked_at is not null then 'auth_refresh_token_invalid' end as error from p left join tokens t using (token_hash)""")
def revoke_outcomes(spark, d):
    """Every fifth request presents an unknown token."""
    i = F.col("o_orderkey")
    presented = table(spark, d, "orders").select(i.alias("request_id"), X.token_hash((i + F.when(i % 5 == 0, 100_000_000).otherwise(0)).cast("string")).alias("token_hash"))
    return versions.revoke_outcomes(tokens(spark, d), presented)


@query("select conv_id, turn, text as refresh_token, length(text) between 32 and 512 as accepted from (select conv_id, turn, regexp_replace(text, '[^ -~]', '?', 'g') as text from conversations)")
def refresh_requests(spark, d):
    rows = turns(spark, d).select("conv_id", "turn", F.to_json(F.struct(F.regexp_replace("text", "[^ -~]", "?").alias("refresh_token"))).alias("body"))
    return parse_refresh_requests(rows).drop("body", "faults")


def said(name, value):
    """The JSON of an object with one field of text."""
    return F.to_json(F.struct(value.alias(name)))


def faulty_bodies(text, at, name):
    """Bodies by turns: good ones, wrong types, nothing, blanks, too much, no object, no JSON."""
    odd = [F.lit(x) for x in (f'{{"{name}": 5}}', f'{{"{name}": ["a"]}}', f'{{"{name}": {{"a": 1}}}}', f'{{"{name}": null}}', "{}", f'{{"{name}": " \\t\\u00a0 "}}', '["a"]', "no json")]
    long = said(name, F.repeat(text, 40))
    return F.element_at(F.array(said(name, text), *odd, long, F.concat(F.lit(f'{{"conversation_id": 7, "{name}": true, "more": '), said(name, text), F.lit("}"))), (at % 11 + 1).cast("int"))


BODIES_SQL = """bodies as (
  select *, case place % 11 when 0 then json_object('{name}', text)::varchar when 1 then '{{"{name}": 5}}' when 2 then '{{"{name}": ["a"]}}' when 3 then '{{"{name}": {{"a": 1}}}}' when 4 then '{{"{name}": null}}' when 5 then '{{}}'
    when 6 then '{{"{name}": " \\t\\u00a0 "}}' when 7 then '["a"]' when 8 then 'no json' when 9 then json_object('{name}', repeat(text, 40))::varchar else '{{"conversation_id": 7, "{name}": true, "more": ' || json_object('{name}', text)::varchar || '}}' end as body from source
), parsed as (select *, json_valid(body) as valid, case when json_valid(body) then json_type(body) end as whole, case when json_valid(body) then json_type(body, '$.{name}') end as kind, case when json_valid(body) then json_extract_string(body, '$.{name}') end as said from bodies)"""
BLANK_SQL = r"regexp_full_match(said, '[ \t\n\r\f\v\x{1c}-\x{1f}\x{85}\p{Z}]*')"
TURNS_SQL = "source as (select conv_id, turn, text, conv_id + turn as place from conversations)"


@query(f"""with {TURNS_SQL}, {BODIES_SQL.format(name="message")} select conv_id, turn, case when kind = 'VARCHAR' then length(said) end as n_chars,
  case when not valid then ':json_invalid' when whole <> 'OBJECT' then ':object_type' else concat_ws(',', case when kind is null then 'message:missing' when kind <> 'VARCHAR' then 'message:string_type' when length(said) < 1 then 'message:string_too_short'
    when length(said) > 4000 then 'message:string_too_long' when {BLANK_SQL} then 'message:value_error' end, case when json_type(body, '$.conversation_id') not in ('VARCHAR', 'NULL') then 'conversation_id:string_type' end) end as faults from parsed""")
def chat_request_faults(spark, d):
    t = turns(spark, d)
    bodies = t.select("conv_id", "turn", faulty_bodies(F.col("text"), F.col("conv_id") + F.col("turn"), "message").alias("body"))
    found = typed(bodies, CHAT)
    return found.select("conv_id", "turn", F.length("message").cast("long").alias("n_chars"), said_faults(F.col("faults")).alias("faults"))


@query(f"""with {TURNS_SQL}, {BODIES_SQL.format(name="refresh_token")} select conv_id, turn,
  case when not valid then ':json_invalid' when whole <> 'OBJECT' then ':object_type' when kind is null then 'refresh_token:missing' when kind <> 'VARCHAR' then 'refresh_token:string_type' when length(said) < 32 then 'refresh_token:string_too_short' when length(said) > 512 then 'refresh_token:string_too_long' else '' end as faults from parsed""")
def refresh_request_faults(spark, d):
    bodies = turns(spark, d).select("conv_id", "turn", faulty_bodies(F.col("text"), F.col("conv_id") + F.col("turn"), "refresh_token").alias("body"))
    return parse_refresh_requests(bodies).select("conv_id", "turn", said_faults(F.col("faults")).alias("faults"))


@query("""
with p as (select c_custkey as user_id, c_custkey % 7 as k, case c_custkey % 7 when 0 then json_object('email', 'c' || c_custkey || '@example.org', 'password', c_name) when 1 then json_object('email', c_name, 'password', c_name)
    when 2 then json_object('email', c_custkey, 'password', c_custkey) when 3 then json_object('email', 'a b@example.org', 'password', '   ') when 4 then json_object('email', 'c@example', 'password', repeat(c_name, 9)) when 5 then json_object('password', '          ') else '[' end as body from customer)
select user_id, case k when 0 then '' when 1 then 'email:value_error' when 2 then 'email:string_type,password:string_type' when 3 then 'email:value_error,password:string_too_short' when 4 then 'email:value_error,password:string_too_long'
  when 5 then 'email:missing,password:value_error' else ':json_invalid' end as faults, k = 0 as accepted from p""")
def credential_request_faults(spark, d):
    u = users(spark, d)
    i, name = F.col("user_id"), F.col("email")
    email = F.element_at(F.array(F.concat(F.lit("c"), i, F.lit("@example.org")), name, F.lit("a b@example.org"), F.lit("c@example")), F.element_at(F.array(*map(F.lit, (1, 2, 1, 3, 4, 1, 1))), (i % 7 + 1).cast("int")))
    password = F.when(i % 7 == 3, "   ").when(i % 7 == 4, F.repeat(name, 9)).when(i % 7 == 5, " " * 10).otherwise(name)
    texts = F.to_json(F.struct(F.when(i % 7 != 5, email).alias("email"), password.alias("password")))
    body = F.when(i % 7 == 2, F.to_json(F.struct(i.alias("email"), i.alias("password")))).when(i % 7 == 6, "[").otherwise(texts)
    found = credential_requests(u.select("user_id", body.alias("body")))
    return found.select("user_id", said_faults(F.col("faults")).alias("faults"), "accepted")


JSON_SQL = r"""
with chars as (
  select conv_id, turn, role, text, list_transform(string_split(text, ''), lambda c: case c when chr(34) then '\"' when chr(92) then '\\' when chr(10) then '\n' when chr(13) then '\r' when chr(9) then '\t' when chr(8) then '\b' when chr(12) then '\f'
    else case when unicode(c) between 32 and 126 then c when unicode(c) < 65536 then format('\u{:04x}', unicode(c)) else format('\u{:04x}\u{:04x}', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) end end) as c from conversations
), t as (select *, '"' || array_to_string(c, '') || '"' as escaped, to_json(text)::varchar as raw from chars)
select conv_id, turn, '{"id": ' || conv_id || ', "turn": {"role": "' || role || '", "texts": [' || escaped || ', null], "odd": ' || (turn % 2 = 1) || '}, "by_name": {"' || role || '": ' || turn || '.5}, "nothing": null}' as python,
  '{"id":' || conv_id || ',"turn":{"role":"' || role || '","texts":[' || raw || ',null],"odd":' || (turn % 2 = 1) || '},"by_name":{"' || role || '":' || turn || '.5},"nothing":null}' as compact from t"""


@query(JSON_SQL)
def json_documents(spark, d):
    """Turns as nested documents, their texts as they are."""
    odd, half = F.col("turn") % 2 == 1, F.col("turn") + F.lit(0.5).cast("double")
    value = F.struct(F.col("conv_id").alias("id"), F.struct("role", F.array("text", F.lit(None)).alias("texts"), odd.alias("odd")).alias("turn"), F.create_map("role", half).alias("by_name"), F.lit(None).alias("nothing"))
    t = with_json(with_json(turns(spark, d), "python", value), "compact", value, COMPACT)
    return t.select("conv_id", "turn", "python", "compact")


@query("select c_custkey as user_id, c_nationkey % 3 // 2 * (c_custkey % 40) as team, c_name as email from customer")
def database_read(spark, d):
    """Users stored in an embedded database (a file of the shared folder) and read back in parts; two thirds are of one team."""
    team = F.floor(F.col("c_nationkey") % 3 / 2) * (F.col("c_custkey") % 40)
    stored = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), team.cast("long").alias("team"), F.col("c_name").alias("email"))
    address = f"{shared_folder(spark).rstrip('/')}/users-{uuid.uuid4().hex}.db"
    store(stored, address, "people", ["team", "user_id"])
    return database_file_table(spark, address, "people", stored.schema, ["team", "user_id"], rows=200)


@query("select page_id, contains(url, 'example') as mentioned, starts_with(url, 'https://') as secure, regexp_replace(url, '/+$', '') as bare from pages")
def url_checks(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", X.mentions(url, "example").alias("mentioned"), X.is_secure(url).alias("secure"), X.without_trailing_slashes(url).alias("bare"))


PROVIDER_SQL = """
with asked as (select conv_id, arg_max(text, turn) filter (role = 'user') as said from conversations group by conv_id)
select conv_id, {reply} as reply, {error} as error, {attempts} as attempts from asked"""


def asked_histories(spark, d):
    return relations.histories(turns(spark, d).select("conv_id").distinct(), turns(spark, d).withColumnRenamed("text", "content"), "conv_id", ["turn"], ["role", "content"])


@query(PROVIDER_SQL.format(reply="'Mock assistant reply: ' || said", error="null", attempts=2))
def flaky_provider(spark, d):
    return replies.provider_replies(asked_histories(spark, d), replies.provider("flaky-mock")).withColumn("error", F.col("error").cast("int"))


@query(PROVIDER_SQL.format(reply="null", error="'provider_timeout'", attempts=1))
def timed_out_provider(spark, d):
    return replies.provider_replies(asked_histories(spark, d), replies.provider("Timeout-Mock ")).withColumn("reply", F.col("reply").cast("int"))


SPOKEN_SQL = f"""with {REPLY_SQL}, late as (select conv_id, length(reply) % 20 = 0 as late from replies)
select conv_id, cast(seq as bigint) as seq, 'chunk' as event, chunk as data from chunks join late using (conv_id) where not {{late}} or seq = 0
union all select conv_id, case when {{late}} then 1 else 3 end, case when {{late}} then 'error' else 'done' end, case when {{late}} then 'provider_timeout' else '' end from late"""


@query(SPOKEN_SQL.format(late="false"))
def reply_table_function(spark, d):
    """The table function, called from SQL."""
    replies.register_provider(spark, "mock_reply_rows", replies.mock_chunks)
    return spark.sql("SELECT conv_id, spoken.* FROM {histories}, LATERAL mock_reply_rows(messages) AS spoken", histories=asked_histories(spark, d))


@query(SPOKEN_SQL.format(late="late"))
def provider_deadline(spark, d):
    """A plug-in that hangs after its first chunk, on replies whose length divides by 20; an attempt may take two seconds, and 32 of a task are open at a time."""

    def hanging(turns, attempt):
        reply = "".join(replies.mock_chunks(turns, attempt))
        for n, chunk in enumerate(replies.mock_chunks(turns, attempt)):
            if n == 1 and len(reply) % 20 == 0:
                threading.Event().wait(60)
            yield chunk

    # the attempts are used twice, so they are written: made again they would wait again
    made = replies.plugged(hanging, seconds=2.0, at_once=32)
    return replies.provider_chunks(asked_histories(spark, d).repartition(64, "conv_id"), lambda *asked: written(made(*asked), "attempts"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
