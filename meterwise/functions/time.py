"""Time helpers.  Every timestamp we produce is TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_ntz(col: Column) -> Column:
    return col.cast("timestamp_ntz")


def minute_start(ts: Column) -> Column:
    # date_trunc returns a session-zone TIMESTAMP; the session zone is UTC, so the cast back is exact.
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def rfc3339_seconds(ts: Column) -> Column:
    """``2024-01-01T10:30:00Z`` (UTC, whole seconds)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
