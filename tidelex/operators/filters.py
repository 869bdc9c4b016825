"""Row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.functions.timefn import time_filter


def unseen(df: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among the seen keys."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def closed_range(df: DataFrame, start_epoch: int, end_epoch: int, ts: str = "occurred_at") -> DataFrame:
    """Rows between two whole seconds, both ends kept; plain bounds, which reach the scan and the dates of a table."""
    kind = df.schema[ts].dataType
    low, high = (F.timestamp_seconds(F.lit(int(s))).cast(kind) for s in (start_epoch, end_epoch + 1))
    if "occurred_date" in df.columns and ts == "occurred_at":
        df = df.where(F.col("occurred_date").between(F.to_date(low), F.to_date(high)))
    return df.where((F.col(ts) >= low) & (F.col(ts) < high))


def result_filters(df: DataFrame, start=None, end=None, source: str | None = None,
                   source_id: str | None = None, label: str | None = None) -> DataFrame:
    """The optional filters of the result queries, combined with AND."""
    df = time_filter(df, start, end)
    for name, value in (("source", source), ("source_id", source_id), ("sentiment_label", label)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def advanced_filters(df: DataFrame, score_range: tuple[float, float] = (-1.0, 1.0),
                     min_confidence: float | None = None,
                     length_range: tuple[int, int] | None = None,
                     include: list[str] | None = None, exclude: list[str] | None = None,
                     text: str = "raw_text") -> DataFrame:
    """Score, confidence, length and keyword filters.

    Keywords are regular-expression alternatives and ignore case. A null text
    matches no keyword: it fails ``include`` and passes ``exclude``.
    """
    df = df.where(F.col("sentiment_score").between(*score_range))
    if min_confidence is not None:
        df = df.where(F.col("confidence") >= min_confidence)
    if length_range is not None:
        df = df.where(F.length(text).between(*length_range))

    def mentions(words: list[str]):
        return F.coalesce(F.col(text).rlike("(?iu)" + "|".join(words)), F.lit(False))

    if include:
        df = df.where(mentions(include))
    if exclude:
        df = df.where(~mentions(exclude))
    return df


def unprocessed(df: DataFrame) -> DataFrame:
    """Rows whose flag is false or null."""
    return df.where(~F.coalesce(F.col("processed"), F.lit(False)))


def entity_existed(periods: DataFrame, created: DataFrame, entity: str = "subreddit",
                   created_at: str = "created_at", period_end: str = "period_end") -> DataFrame:
    """Drop (entity, period) pairs that ended before the entity was created.

    An entity without a known creation time keeps all its periods.
    """
    return (periods.join(created.select(entity, created_at), entity, "left")
            .where(F.col(created_at).isNull() | (F.col(created_at) <= F.col(period_end)))
            .drop(created_at))
