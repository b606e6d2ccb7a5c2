"""Time functions; the session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_utc(ts: Column) -> Column:
    """Naive timestamps are taken as UTC."""
    return ts.cast("timestamp")


def iso_format(ts: Column, aware: bool = True) -> Column:
    """ISO 8601; no fraction where microseconds are 0."""
    zone = "xxx" if aware else ""
    micros = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    return F.when(micros == 0, F.date_format(ts, f"yyyy-MM-dd'T'HH:mm:ss{zone}")).otherwise(F.date_format(ts, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}"))


def plus_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))


def lifetime_seconds(minutes: Column) -> Column:
    return minutes * 60


def python_round(x: Column, digits: int) -> Column:
    """A double to so many decimals (0 to 3) as Python rounds it: by its exact value, halves to the even neighbour.

    Whether 10**digits * x lies above the middle of its neighbours is told without error: the upper half of
    the double's bits times a small whole number is exact, and so is its distance to the middle; the lower
    half only decides the sign. From 2**40 on it is the engine's rounding.
    """
    scale = float(10**digits)
    size = F.abs(x.cast("double"))
    split = size * 134217729.0
    upper = split - (split - size)
    low = F.floor(size * scale).cast("double")
    beyond = (upper * (2 * scale) - (low * 2.0 + 1.0)) + (size - upper) * (2 * scale)
    nearest = F.when(beyond < 0, low).when(beyond > 0, low + 1.0).otherwise(low + low % 2.0)
    sign = F.when(x.cast("double") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(size < 2.0**40, sign * nearest / scale).otherwise(F.round(x.cast("double"), digits))


def elapsed_ms(seconds: Column) -> Column:
    """Milliseconds, rounded to two places."""
    return python_round(seconds * 1000, 2)


def timed_out_message(seconds: Column) -> Column:
    return F.format_string("LLM provider timed out after %.1f seconds.", python_round(seconds, 1))
