"""JSON-lines log sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPTIONAL = ("path", "method", "status_code", "duration_ms", "event")


def log_line(frame: DataFrame) -> Column:
    """A compact JSON object; optional fields that are null or absent are left out."""
    named = ["timestamp", "level", "logger", "message", *(c for c in OPTIONAL if c in frame.columns)]
    return F.to_json(F.struct(*named))


def write_log(frame: DataFrame, path: str) -> None:
    frame.select(log_line(frame).alias("value")).write.mode("append").text(path)
