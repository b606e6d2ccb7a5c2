"""Writes as pure rewrites: each function takes table versions and returns new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, title_of, token_hash
from ..functions.time import plus_days


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(table.columns))


def new_users(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming users whose email is new, one of each (the first by ``arrival``)."""
    first = incoming.groupBy("email").agg(F.min_by(F.struct(*incoming.columns), "arrival").alias("r")).select("r.*")
    return first.join(users.select("email"), "email", "left_anti")


def updated(table: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    return table.withColumns({name: F.when(where, value).otherwise(F.col(name)) for name, value in changes.items()})


def deleted_with_children(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """users, conversations, messages, refresh_tokens without the users of gone(user_id) and all that is theirs."""
    conversations = tables["conversations"]
    lost = conversations.join(gone, "user_id", "left_semi").select("conversation_id")
    return {
        "users": tables["users"].join(gone, "user_id", "left_anti"),
        "conversations": conversations.join(gone, "user_id", "left_anti"),
        "messages": tables["messages"].join(lost, "conversation_id", "left_anti"),
        "refresh_tokens": tables["refresh_tokens"].join(gone, "user_id", "left_anti"),
    }


def loaded_or_created(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """requests(request_id, user_id, conversation_id, message): outcome loaded, created (no id given; the
    title is the start of the message) or the error of an id that is not the user's."""
    own = conversations.select("conversation_id", "user_id", F.col("title").alias("_title"), F.lit(True).alias("_found"))
    joined = requests.join(own, ["conversation_id", "user_id"], "left")
    new = F.col("conversation_id").isNull()
    outcome = F.when(new, "created").when(F.col("_found"), "loaded").otherwise("chat_conversation_missing")
    return joined.select("request_id", "user_id", "conversation_id", F.when(new, title_of(strip(F.col("message")))).otherwise(F.col("_title")).alias("title"), outcome.alias("outcome"))


def active_tokens(tokens: DataFrame, as_of: Column) -> DataFrame:
    """Not revoked, and not expired (a token that expires at as_of is expired)."""
    return tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at") > as_of))


def revoked(tokens: DataFrame, presented: DataFrame, as_of: Column) -> DataFrame:
    """tokens with revoked_at set for presented(token_hash); expired ones too, those revoked before stay as they are."""
    hit = presented.select("token_hash").distinct().withColumn("_hit", F.lit(True))
    joined = tokens.join(hit, "token_hash", "left")
    return updated(joined, F.col("_hit") & F.col("revoked_at").isNull(), {"revoked_at": as_of}).select(tokens.columns)


def rotated(tokens: DataFrame, presented: DataFrame, as_of: Column, days: int) -> DataFrame:
    """tokens after rotation: active ones of presented(token_hash, new_token) are revoked, new ones are added."""
    swap = presented.groupBy("token_hash").agg(F.min("new_token").alias("_new"))
    live = F.col("_new").isNotNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > as_of)
    row = lambda *values: F.struct(*(v.alias(c) for v, c in zip(values, ("token_hash", "user_id", "expires_at", "revoked_at"), strict=True)))
    old = row(F.col("token_hash"), F.col("user_id"), F.col("expires_at"), F.when(live, as_of).otherwise(F.col("revoked_at")))
    fresh = row(token_hash(F.col("_new")), F.col("user_id"), plus_days(as_of, days), F.lit(None).cast("timestamp"))
    return tokens.join(swap, "token_hash", "left").select(F.inline(F.when(live, F.array(old, fresh)).otherwise(F.array(old))))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows to insert: an id and created_at of their own where these are absent or null."""
    made = {"id": F.uuid(), "created_at": F.current_timestamp()}
    return rows.withColumns({c: F.coalesce(F.col(c), value) if c in rows.columns else value for c, value in made.items()})


def issued(tokens: DataFrame, logins: DataFrame, as_of: Column, days: int) -> DataFrame:
    """tokens with an active one more for each of logins(user_id, new_token)."""
    fresh = logins.select(token_hash(F.col("new_token")).alias("token_hash"), "user_id", plus_days(as_of, days).alias("expires_at"))
    return tokens.unionByName(fresh, allowMissingColumns=True)


def revoke_outcomes(tokens: DataFrame, presented: DataFrame) -> DataFrame:
    """presented(request_id, token_hash) with error: a token that is unknown or revoked before is refused; an expired one is not."""
    own = tokens.select("token_hash", F.col("revoked_at").isNull().alias("_open"))
    return presented.join(own, "token_hash", "left").select("request_id", "token_hash", F.when(~F.coalesce("_open", F.lit(False)), "auth_refresh_token_invalid").alias("error"))


def with_created(conversations: DataFrame, outcomes: DataFrame, new_id: Column) -> DataFrame:
    """conversations(conversation_id, user_id, title) with those that loaded_or_created has made; new_id over its columns."""
    made = outcomes.where("outcome = 'created'").withColumn("conversation_id", new_id)
    return inserted(conversations.select("conversation_id", "user_id", "title"), made)
