"""Error codes as a status dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Code and HTTP status.
CODES = (
    ("auth_user_exists", 409),
    ("auth_credentials_invalid", 401),
    ("auth_token_invalid", 401),
    ("auth_refresh_token_invalid", 401),
    ("auth_secret_missing", 500),
    ("auth_credentials_missing", 401),
    ("chat_message_empty", 422),
    ("chat_conversation_missing", 404),
    ("quota_exceeded", 429),
    ("rate_limit_exceeded", 429),
    ("request_too_large", 413),
    ("provider_unavailable", 503),
    ("provider_stream_interrupted", 503),
    ("provider_timeout", 504),
    ("provider_request_failed", 503),
    ("provider_configuration_invalid", 500),
    ("provider_unsupported", 503),
)


def error_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODES), "code string, http_status int")
