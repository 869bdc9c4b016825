"""Time expressions: buckets, calendar weeks, time filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = ("minute", "hour", "day", "week", "month")


def as_column(value) -> Column:
    """A column as given; any other value as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def bucket(ts: Column, size: str, tuesday_week: bool = False) -> Column:
    """Start of the bucket that holds ``ts``.

    Weeks start on Monday. ``tuesday_week`` gives weeks that end on Monday.
    """
    if size not in BUCKETS:
        raise ValueError(f"bucket must be one of {BUCKETS}, not {size!r}")
    if size == "week" and tuesday_week:
        return F.date_trunc("week", ts - F.expr("INTERVAL 1 DAY")) + F.expr("INTERVAL 1 DAY")
    return F.date_trunc(size, ts)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def sunday_week_label(ts: Column) -> Column:
    """Year and week number with weeks starting on Sunday, as ``2024-W05``."""
    week = F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7).cast("int")
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def time_filter(df: DataFrame, start=None, end=None, ts: str = "occurred_at",
                date_col: str = "occurred_date") -> DataFrame:
    """Closed time range, with the matching date range so that partitions are pruned."""
    dated = date_col in df.columns
    # The bound takes the column's own type; a cast of the column would not reach the scan.
    kind = df.schema[ts].dataType
    if start is not None:
        lower = as_column(start).cast(kind)
        df = df.where(F.col(ts) >= lower)
        if dated:
            df = df.where(F.col(date_col) >= F.to_date(lower))
    if end is not None:
        upper = as_column(end).cast(kind)
        df = df.where(F.col(ts) <= upper)
        if dated:
            df = df.where(F.col(date_col) <= F.to_date(upper))
    return df
