"""Trends, heatmaps and rolling windows over time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelex.functions.timefn import bucket, sunday_week_label
from tidelex.operators.metrics import other_label
from tidelex.operators.scoring import LABELS

SCORE, LABEL = "sentiment_score", "sentiment_label"
MOVING_WIDTHS = (3, 6, 12)
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
QUANTILE_WIDTH = 12


def trend(results: DataFrame, size: str = "hour", tuesday_week: bool = False) -> DataFrame:
    """Mean, deviation, count, extremes and mean confidence per bucket and label."""
    return results.groupBy(bucket(F.col("occurred_at"), size, tuesday_week).alias("time_bucket"), LABEL).agg(
        F.avg(SCORE).alias("avg_score"), F.stddev_samp(SCORE).alias("std_score"),
        F.count(F.lit(1)).alias("events"), F.min(SCORE).alias("min_score"),
        F.max(SCORE).alias("max_score"), F.avg("confidence").alias("avg_confidence"))


def with_band(trended: DataFrame) -> DataFrame:
    """Mean plus and minus one deviation; a missing deviation counts as 0."""
    dev = F.coalesce("std_score", F.lit(0.0))
    return trended.withColumns({"band_low": F.col("avg_score") - dev, "band_high": F.col("avg_score") + dev})


def volume(df: DataFrame, size: str = "hour", *keys: str) -> DataFrame:
    """Rows per bucket, and per further keys."""
    return df.groupBy(bucket(F.col("occurred_at"), size).alias("time_bucket"), *keys).agg(
        F.count(F.lit(1)).alias("events"))


def simple_trend(results: DataFrame, size: str = "hour") -> DataFrame:
    """Mean score per bucket and label; any other size falls back to the hour."""
    chosen = size if size in ("hour", "day", "week") else "hour"
    return results.groupBy(bucket(F.col("occurred_at"), chosen).alias("time_bucket"), LABEL).agg(
        F.avg(SCORE).alias("avg_score"))


def label_pivot(results: DataFrame, *keys, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts per label as columns, 0 where there is none; ``other`` counts every other label and missing ones."""
    return results.groupBy(*keys).agg(*[
        F.count_if(F.col(LABEL) == lab).alias(lab) for lab in labels], F.count_if(other_label(labels)).alias("other"))


def heatmap(results: DataFrame, size: str = "hour") -> DataFrame:
    """Label counts by (date, hour), (Sunday week, weekday) or (year, ISO week)."""
    ts = F.col("occurred_at")
    axes = {
        "hour": (F.date_format(ts, "yyyy-MM-dd"), F.hour(ts).cast("string")),
        "day": (sunday_week_label(ts), F.date_format(ts, "EEEE")),
        "week": (F.date_format(ts, "yyyy"), F.weekofyear(ts).cast("string")),
    }
    period, slot = axes.get(size, axes["week"])
    return label_pivot(results, period.alias("period"), slot.alias("slot"))


def compact_heatmap(results: DataFrame, size: str = "hour", with_year: bool = False) -> DataFrame:
    """Label counts by (day, hour), (ISO week, weekday) or (month, ISO week); years mix unless asked for."""
    ts = F.col("occurred_at")
    axes = {
        "hour": (F.date_format(ts, "yyyy-MM-dd"), F.hour(ts).cast("string")),
        "day": (F.weekofyear(ts).cast("string"), F.date_format(ts, "EEEE")),
        "week": (F.month(ts).cast("string"), F.weekofyear(ts).cast("string")),
    }
    period, slot = axes.get(size, axes["week"])
    keys = [F.year(ts).alias("year")] if with_year else []
    return label_pivot(results, *keys, period.alias("period"), slot.alias("slot"))


def hourly_mean(results: DataFrame, *keys: str) -> DataFrame:
    """One row per hour that has rows. The windows below run on this small table."""
    return results.groupBy(*keys, bucket(F.col("occurred_at"), "hour").alias("hour")).agg(
        F.avg(SCORE).alias("avg_score"))


def _ordered(keys: tuple[str, ...]):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("hour")


def moving_average(results: DataFrame, widths: tuple[int, ...] = MOVING_WIDTHS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Centered moving averages of the hourly mean, null until the window is full.

    An even window reaches one row further back than forward.
    """
    series = hourly_mean(results, *keys)
    for width in widths:
        frame = _ordered(keys).rowsBetween(-(width // 2), width - 1 - width // 2)
        series = series.withColumn(f"ma_{width}", F.when(
            F.count("avg_score").over(frame) == width, F.avg("avg_score").over(frame)))
    return series


def rolling_quantiles(results: DataFrame, probs: tuple[float, ...] = QUANTILES,
                      width: int = QUANTILE_WIDTH, keys: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles of the last ``width`` hourly means, null until the window is full."""
    series = hourly_mean(results, *keys)
    frame = _ordered(keys).rowsBetween(-(width - 1), 0)
    found = F.percentile("avg_score", F.array(*[F.lit(p) for p in probs])).over(frame)
    series = series.withColumn("_q", F.when(F.count("avg_score").over(frame) == width, found))
    return series.select(*keys, "hour", "avg_score", *[
        F.col("_q")[i].alias(f"q{round(p * 100)}") for i, p in enumerate(probs)])


def metric_correlation(results: DataFrame, size: str = "hour") -> DataFrame:
    """Correlation of bucket volume with mean score and mean confidence."""
    series = results.groupBy(bucket(F.col("occurred_at"), size).alias("t")).agg(
        F.count(F.lit(1)).cast("double").alias("events"), F.avg(SCORE).alias("score"),
        F.avg("confidence").alias("confidence"))
    return series.agg(F.corr("events", "score").alias("volume_score"),
                      F.corr("score", "confidence").alias("score_confidence"))
