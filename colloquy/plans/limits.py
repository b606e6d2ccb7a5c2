"""Limits and quotas as a parameter table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.config import Settings


def limit_table(spark: SparkSession, settings: Settings | None = None) -> DataFrame:
    """action, kind (rate: by address; quota: by user), limit, window_seconds, error."""
    s = settings or Settings()
    rates = [("auth_register", s.limits.register), ("auth_token", s.limits.token), ("chat_messages", s.limits.chat), ("chat_stream", s.limits.stream)]
    quotas = [("chat", s.quotas.chat), ("chat_stream", s.quotas.stream)]
    rows = [(a, "rate", n, s.limits.window_seconds, "rate_limit_exceeded") for a, n in rates] + [(a, "quota", n, s.quotas.window_seconds, "quota_exceeded") for a, n in quotas]
    return spark.createDataFrame(rows, "action string, kind string, limit int, window_seconds int, error string")
