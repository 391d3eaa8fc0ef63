"""Time helpers. Public frames hold TIMESTAMP columns; arithmetic runs on epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(value: Column | str) -> Column:
    """Epoch microseconds of a timestamp."""
    return F.unix_micros(_col(value))


def bucket_of(us: Column | str, width: int) -> Column:
    """Number of the fixed-width time bucket an epoch-microsecond value falls in."""
    return F.floor(_col(us) / F.lit(width)).cast("bigint")


def floor_to(value: Column | str, width: int) -> Column:
    """Timestamp floored to an epoch-aligned multiple of ``width`` microseconds."""
    us = micros(value)
    return F.timestamp_micros(us - F.pmod(us, F.lit(width)))


def plus(value: Column | str, us: Column | int) -> Column:
    """Timestamp shifted by a number of microseconds."""
    shift = us if isinstance(us, Column) else F.lit(us)
    return F.timestamp_micros(micros(value) + shift)


def whole_seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds between two timestamps, truncated toward zero."""
    return ((micros(later) - micros(earlier)) / F.lit(SECOND)).cast("bigint")
