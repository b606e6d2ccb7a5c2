"""Reads over users, conversations and messages, for all users at once; one user is a filter on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_of
from ..functions.time import as_utc, iso_format


def by_key(table: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a unique key, or none."""
    return table.where(F.col(key) == F.lit(value)).limit(1)


def owned(table: DataFrame, id_col: str, id_value: object, owner_col: str, owner: object) -> DataFrame:
    return table.where((F.col(id_col) == F.lit(id_value)) & (F.col(owner_col) == F.lit(owner)))


def looked_up(requests: DataFrame, table: DataFrame, on: list[str], columns: list[str], missing: str = "chat_conversation_missing") -> DataFrame:
    """Every request with the columns of the row that it finds, or the error code if there is none."""
    found = table.select(*on, *columns, F.lit(True).alias("_found"))
    joined = requests.join(found, on, "left")
    return joined.select(*requests.columns, *columns, F.when(F.col("_found").isNull(), missing).alias("error"))


def usage_summary(users: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """users(user_id), conversations(conversation_id, user_id), messages(conversation_id, role): four counts a user.

    Messages are counted per conversation before the join, so the larger table is shuffled once, as partial counts.
    """
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"))
    of_user = (
        conversations.join(counts, "conversation_id", "left")
        .groupBy("user_id")
        .agg(F.count("*").alias("conversation_count"), F.sum("n").alias("message_count"), F.sum("n_user").alias("user_message_count"), F.sum("n_assistant").alias("assistant_message_count"))
    )
    names = ["conversation_count", "message_count", "user_message_count", "assistant_message_count"]
    return users.join(of_user, "user_id", "left").select("user_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversations(conversation_id, user_id, created_at): with message_count (0 where there is none) and
    newest_rank, by created_at down, then conversation_id down."""
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("n"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("conversation_id"))
    return conversations.join(counts, "conversation_id", "left").select(
        "conversation_id", "user_id", "created_at", F.coalesce("n", F.lit(0)).alias("message_count"), F.row_number().over(newest).cast("long").alias("newest_rank")
    )


def histories(parents: DataFrame, children: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each parent with its children, in order, as an array of structs; empty where it has none."""
    item = F.struct(*order, *(c for c in columns if c not in order))
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = nested.schema["items"].dataType.simpleString()
    named = F.transform(F.coalesce("items", F.array().cast(kind)), lambda x: F.struct(*(x[c].alias(c) for c in columns)))
    return parents.join(nested, key, "left").select(*parents.columns, named.alias("messages"))


def history_rows(messages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Flat form: every message with its position (from 1) in its conversation."""
    return messages.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key no parent has (null keys included)."""
    return children.join(parents.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")


def payload_role(role: Column) -> Column:
    return F.when(role.isin("user", "assistant", "system"), role).otherwise("developer")


def summaries(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """The response shape of a listing: id, title, created_at (ISO 8601 text), message_count and newest_rank."""
    listed = conversation_list(conversations, messages).select("conversation_id", "message_count", "newest_rank")
    rows = conversations.join(listed, "conversation_id")
    return rows.select(F.col("conversation_id").cast("string").alias("id"), title_of(F.col("title")).alias("title"), iso_format(as_utc(F.col("created_at"))).alias("created_at"), "message_count", "newest_rank")


def stored_and_read(turns: DataFrame, new_turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each conversation after its new turns are stored: (key, messages array<struct<role,text>>)."""
    stored = turns.select(key, order, "role", "text").unionByName(new_turns.select(key, order, "role", "text"))
    return histories(stored.select(key).distinct(), stored, key, [order], ["role", "text"])
