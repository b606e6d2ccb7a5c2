"""Fixed schemas of the stored tables and of requests; nothing is inferred."""

from pyspark.sql import types as T


def _row(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


S, B, TS = T.StringType(), T.BooleanType(), T.TimestampType()
USERS = _row(("id", S, False), ("email", S, False), ("password_hash", S, False), ("is_active", B, False), ("is_superuser", B, False), ("is_verified", B, False), ("created_at", TS, False))
CONVERSATIONS = _row(("id", S, False), ("user_id", S, False), ("title", S, False), ("created_at", TS, False))
MESSAGES = _row(("id", S, False), ("conversation_id", S, False), ("role", S, False), ("content", S, False), ("created_at", TS, False))
REFRESH_TOKENS = _row(("id", S, False), ("user_id", S, False), ("token_hash", S, False), ("expires_at", TS, False), ("revoked_at", TS, True), ("created_at", TS, False))
CHAT_REQUEST = _row(("message", S, True), ("conversation_id", S, True))
CREDENTIALS_REQUEST = _row(("email", S, True), ("password", S, True))
REFRESH_REQUEST = _row(("refresh_token", S, True))
TABLES = {"users": USERS, "conversations": CONVERSATIONS, "messages": MESSAGES, "refresh_tokens": REFRESH_TOKENS}
