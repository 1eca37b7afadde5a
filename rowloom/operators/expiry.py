"""Time to live: when rows expire, what is left, and which rows are live at one fixed moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live_rows(df: DataFrame, expires: Column, as_of: Column) -> DataFrame:
    return df.where(expires.isNull() | (expires > as_of))


def expired_rows(df: DataFrame, expires: Column, as_of: Column) -> DataFrame:
    """What a sweep removes."""
    return df.where(expires.isNotNull() & (expires <= as_of))


def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def remaining_seconds(expires: Column, as_of: Column) -> Column:
    """Whole seconds left, rounded up; -1 for rows that never expire."""
    return F.when(expires.isNull(), F.lit(-1)).otherwise(F.ceil((micros(expires) - micros(as_of)) / 1_000_000)).cast("long")


def expiry_of(ttl: Column, default_ttl: int, as_of: Column) -> Column:
    """When a row written now expires: after ``ttl`` seconds; null takes the default, 0 is never, less is at once."""
    seconds = F.coalesce(ttl, F.lit(default_ttl or 0))
    later = F.timestamp_micros(micros(as_of) + seconds.cast("long") * 1_000_000)
    return F.when(seconds > 0, later).when(seconds < 0, as_of.cast("timestamp"))
