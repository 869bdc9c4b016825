"""Time windows for searches and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelex.functions.timefn import micros, seconds_between

STOP_AFTER_EMPTY = 3


def month_windows(df: DataFrame, start_year: str, end_year: str, step: str | int,
                  clip_on_reaching_end: bool = True) -> DataFrame:
    """Windows of ``step`` months from Jan 1 of the start year to Jan 1 of the end year.

    One input row gives the windows of one period. The last window is clipped to
    the end when it reaches the end year, or, with ``clip_on_reaching_end``
    off, only when it runs past the end year.
    """
    step_col = F.lit(step) if isinstance(step, int) else F.col(step)
    first = F.make_timestamp(F.col(start_year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    limit = F.make_timestamp(F.col(end_year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    months = (F.col(end_year) - F.col(start_year)) * 12
    offset = F.explode(F.when(months > 0, F.sequence(F.lit(0), months - 1, step_col)))
    df = df.withColumn("_offset", offset)
    start = first + F.make_ym_interval(F.lit(0), F.col("_offset"))
    end = first + F.make_ym_interval(F.lit(0), F.col("_offset") + step_col)
    past = F.year(end) >= F.col(end_year) if clip_on_reaching_end else F.year(end) > F.col(end_year)
    return (df.withColumn("window_start", start)
            .withColumn("window_end", F.when(past, limit).otherwise(end))
            .where(F.col("window_start") < F.col("window_end")).drop("_offset"))


def backward_index(ts: Column, end: Column, days: int) -> Column:
    """Number of the fixed window, counted back from ``end``, that holds ``ts``."""
    span = days * 86_400_000_000
    return F.floor((micros(end) - micros(ts) - 1) / span).cast("long")


def backward_windows(df: DataFrame, start: str, end: str, days: int,
                     max_windows: int | None = None) -> DataFrame:
    """Windows of ``days`` back from ``end``; the oldest is clipped to ``start``."""
    span = days * 86_400
    count = F.greatest(F.lit(1), F.ceil(seconds_between(F.col(end), F.col(start)) / span))
    if max_windows is not None:
        count = F.least(count, F.lit(max_windows))
    df = df.withColumn("window_no", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    back = lambda n: F.timestamp_micros(micros(F.col(end)) - n.cast("long") * F.lit(span * 1_000_000))
    return (df.withColumn("window_end", back(F.col("window_no")))
            .withColumn("window_start", F.greatest(back(F.col("window_no") + 1), F.col(start).cast("timestamp")))
            .where(F.col("window_start") < F.col("window_end")))


def forward_chunks(df: DataFrame, start: str, end: str, months: int) -> DataFrame:
    """Chunks of ``months`` from ``start``; the last is clipped to ``end``."""
    total = F.ceil(F.greatest(F.months_between(F.col(end), F.col(start)), F.lit(0.0)) / months)
    df = df.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), total.cast("int"))))
    step = lambda n: F.col(start).cast("timestamp") + F.make_ym_interval(F.lit(0), n * months)
    return (df.withColumn("chunk_start", step(F.col("chunk_no")))
            .withColumn("chunk_end", F.least(step(F.col("chunk_no") + 1), F.col(end).cast("timestamp")))
            .where(F.col("chunk_start") < F.col(end).cast("timestamp")))


def chunk_count(start: Column, end: Column) -> Column:
    """Number of equal chunks for a range: by day, by three days, then by week."""
    days = F.floor(seconds_between(end, start) / 86_400).cast("int")
    chosen = (F.when(days <= 7, days)
              .when(days <= 30, F.least(F.lit(10), F.floor(days / 3)))
              .otherwise(F.least(F.lit(20), F.floor(days / 7))))
    return F.greatest(F.lit(1), chosen).cast("int")


def adaptive_chunks(df: DataFrame, start: str, end: str) -> DataFrame:
    """Cut a range into equal chunks, their number chosen by its length."""
    df = (df.withColumn("chunk_count", chunk_count(F.col(start), F.col(end)))
          .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1))))
    span = micros(F.col(end)) - micros(F.col(start))
    edge = lambda n: F.timestamp_micros(
        (micros(F.col(start)) + F.round(span * n / F.col("chunk_count"))).cast("long"))
    return (df.withColumn("chunk_start", edge(F.col("chunk_no")))
            .withColumn("chunk_end", edge(F.col("chunk_no") + 1)))


def gap_days(seconds: Column) -> Column:
    """Whole days of a gap, at least one."""
    return F.greatest(F.lit(1), F.floor(seconds / 86_400)).cast("int")


def backfill_extent(df: DataFrame, group: str, ts: str, end, days: int,
                    patience: int = STOP_AFTER_EMPTY) -> DataFrame:
    """The last window each group reads when it stops after ``patience`` empty ones.

    Only windows that hold rows are aggregated; runs of empty windows show as
    jumps between neighbouring window numbers, so no group-by-window grid is
    built. Output: group, number of the last window read, windows with rows and
    rows collected before the stop.
    """
    end_col = end if isinstance(end, Column) else F.lit(end).cast("timestamp")
    filled = (df.where(F.col(ts) < end_col)
              .groupBy(F.col(group), backward_index(F.col(ts), end_col, days).alias("window_no"))
              .agg(F.count(F.lit(1)).alias("rows")))
    order = Window.partitionBy(group).orderBy("window_no")
    stepped = filled.withColumn("_prev", F.coalesce(F.lag("window_no").over(order), F.lit(-1)))
    broken = F.col("window_no") - F.col("_prev") > patience
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = stepped.withColumn("_stopped", F.max(broken.cast("int")).over(running))
    return kept.groupBy(group).agg(
        F.coalesce(F.min(F.when(broken, F.col("_prev") + patience)),
                   F.max("window_no") + patience).alias("last_window"),
        F.count_if(F.col("_stopped") == 0).alias("windows_with_rows"),
        F.coalesce(F.sum(F.when(F.col("_stopped") == 0, F.col("rows"))), F.lit(0)).alias("rows_collected"))


def backfill_rows(df: DataFrame, group: str, ts: str, end, days: int,
                  patience: int = STOP_AFTER_EMPTY) -> DataFrame:
    """The rows a backfill collects: those of the windows read before the stop."""
    end_col = end if isinstance(end, Column) else F.lit(end).cast("timestamp")
    extent = backfill_extent(df, group, ts, end, days, patience).select(group, "last_window")
    return (df.where(F.col(ts) < end_col)
            .withColumn("window_no", backward_index(F.col(ts), end_col, days))
            .join(extent, group)
            .where(F.col("window_no") <= F.col("last_window"))
            .drop("last_window"))
