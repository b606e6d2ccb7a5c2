from datetime import datetime

from colloquy.operators import relations, versions
from pyspark.sql import functions as F


def test_user_without_conversation_has_zeros(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    conversations = spark.createDataFrame([(10, 1), (11, 1)], "conversation_id long, user_id long")
    messages = spark.createDataFrame([(10, "user"), (10, "assistant"), (10, "system"), (11, "developer")], "conversation_id long, role string")
    got = {tuple(r) for r in relations.usage_summary(users, conversations, messages).collect()}
    assert got == {(1, 2, 4, 1, 1), (2, 0, 0, 0, 0)}


def test_list_breaks_ties_and_counts_zero(spark):
    at = datetime(2026, 1, 1)
    c = spark.createDataFrame([(1, 7, at), (2, 7, at)], "conversation_id long, user_id long, created_at timestamp")
    m = spark.createDataFrame([(1, "user")], "conversation_id long, role string")
    got = {(r.conversation_id, r.message_count, r.newest_rank) for r in relations.conversation_list(c, m).collect()}
    assert got == {(1, 1, 2), (2, 0, 1)}


def test_history_is_ordered_and_empty_stays(spark):
    parents = spark.createDataFrame([(1, "Support chat"), (2, "none")], "id long, title string")
    children = spark.createDataFrame([(1, 2, "assistant", "Hi there"), (1, 1, "user", "Hello")], "id long, at int, role string, content string")
    got = {r.id: [(m.role, m.content) for m in r.messages] for r in relations.histories(parents, children, "id", ["at"], ["role", "content"]).collect()}
    assert got == {1: [("user", "Hello"), ("assistant", "Hi there")], 2: []}


def test_lookup_names_what_is_missing(spark):
    table = spark.createDataFrame([(1, 5, "t")], "id long, user_id long, title string")
    asked = spark.createDataFrame([(1, 5), (1, 6)], "id long, user_id long")
    got = {(r.user_id, r.title, r.error) for r in relations.looked_up(asked, table, ["id", "user_id"], ["title"]).collect()}
    assert got == {(5, "t", None), (6, None, "chat_conversation_missing")}
    assert relations.owned(table, "id", 1, "user_id", 6).count() == 0 and relations.by_key(table, "id", 1).count() == 1


def tokens(spark):
    t = datetime
    rows = [("a", 1, t(2026, 1, 8), None), ("expired", 1, t(2026, 1, 1), None), ("gone", 2, t(2026, 2, 1), t(2025, 12, 1))]
    return spark.createDataFrame(rows, "token_hash string, user_id long, expires_at timestamp, revoked_at timestamp")


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def test_token_that_expires_now_is_expired(spark):
    assert [r.token_hash for r in versions.active_tokens(tokens(spark), now()).collect()] == ["a"]


def test_rotation_revokes_old_and_adds_new_once(spark):
    shown = spark.createDataFrame([("a", "n1"), ("gone", "n2"), ("unknown", "n3"), ("expired", "n4")], "token_hash string, new_token string")
    after = versions.rotated(tokens(spark), shown, now(), 7)
    assert after.count() == 4
    again = versions.rotated(after, shown, now(), 7)
    assert again.count() == 4
    assert after.where("token_hash = 'a'").first().revoked_at == datetime(2026, 1, 1)


def test_revoking_an_expired_token_is_accepted(spark):
    shown = spark.createDataFrame([("expired",), ("gone",)], "token_hash string")
    got = {r.token_hash: r.revoked_at for r in versions.revoked(tokens(spark), shown, now()).collect()}
    assert got == {"a": None, "expired": datetime(2026, 1, 1), "gone": datetime(2025, 12, 1)}


def test_delete_cascades(spark):
    one = spark.createDataFrame([(1,), (2,)], "user_id long")
    c = spark.createDataFrame([(10, 1), (20, 2)], "conversation_id long, user_id long")
    m = spark.createDataFrame([(10, "a"), (20, "b")], "conversation_id long, role string")
    left = versions.deleted_with_children({"users": one, "conversations": c, "messages": m, "refresh_tokens": c}, one.where("user_id = 1"))
    assert {k: v.count() for k, v in left.items()} == {"users": 1, "conversations": 1, "messages": 1, "refresh_tokens": 1}


def test_register_twice_keeps_one(spark):
    users = spark.createDataFrame([("old@x.org",)], "email string")
    incoming = spark.createDataFrame([("old@x.org", 1), ("new@x.org", 2), ("new@x.org", 3)], "email string, arrival int")
    assert [tuple(r) for r in versions.new_users(users, incoming).collect()] == [("new@x.org", 2)]


def test_create_uses_first_80_characters(spark):
    asked = spark.createDataFrame([(1, 1, None, " " + "\U0001F600" * 81), (2, 1, 99, "x")], "request_id int, user_id int, conversation_id int, message string")
    there = spark.createDataFrame([(5, 1, "t")], "conversation_id int, user_id int, title string")
    got = {r.request_id: (r.title, r.outcome) for r in versions.loaded_or_created(asked, there).collect()}
    assert got == {1: ("\U0001F600" * 80, "created"), 2: (None, "chat_conversation_missing")}


def test_settings_rules_of_production():
    import pytest
    from colloquy.sources.config import settings_from

    good = {"COLLOQUY_ENVIRONMENT": "production", "COLLOQUY_TOKEN_SECRET": "s"}
    assert settings_from(good).environment == "production" and settings_from({}).token_secret == ""
    for bad in ({"COLLOQUY_ENVIRONMENT": "production"}, good | {"COLLOQUY_PROVIDER__NAME": "remote", "COLLOQUY_PROVIDER__BASE_URL": "http://x"}):
        with pytest.raises(ValueError):
            settings_from(bad)


def test_created_conversations_and_defaults(spark):
    from colloquy.operators import versions
    from pyspark.sql import functions as F

    there = spark.createDataFrame([("1", "u", "old")], "conversation_id string, user_id string, title string")
    asked = spark.createDataFrame([(1, "u", "1", "x"), (2, "u", None, "  New talk "), (3, "v", "1", "x")], "request_id int, user_id string, conversation_id string, message string")
    made = versions.with_created(there, versions.loaded_or_created(asked, there), F.concat(F.lit("c"), "request_id"))
    assert {tuple(r) for r in made.collect()} == {("1", "u", "old"), ("c2", "u", "New talk")}
    rows = versions.with_defaults(spark.createDataFrame([("k",), (None,)], "id string")).collect()
    assert rows[0].id == "k" and len(rows[1].id) == 36 and all(r.created_at for r in rows)
