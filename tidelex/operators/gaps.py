"""Collection gaps, freshness and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.functions.ordering import first_per_key, interval_join, time_gaps, with_row_index
from tidelex.functions.timefn import as_column, micros
from tidelex.operators.filters import unseen
from tidelex.operators.search import first_matched_term, searchable
from tidelex.operators.windows import gap_days

# Gap threshold and fetch-age alert limit, in seconds.
GAP_SECONDS = 600
MAX_FETCH_AGE_SECONDS = 1200


def group_gaps(df: DataFrame, group: str, ts: str = "occurred_at",
               min_gap: float = GAP_SECONDS) -> DataFrame:
    """Gaps longer than ``min_gap`` inside each group."""
    return time_gaps(df, [group], ts, min_gap)


def table_gaps(df: DataFrame, ts: str = "occurred_at", min_gap: float = GAP_SECONDS) -> DataFrame:
    """Gaps of the whole table, whatever the group."""
    return time_gaps(df, [], ts, min_gap)


def largest(gaps: DataFrame, n: int) -> DataFrame:
    return gaps.orderBy(F.desc("gap_duration_seconds"), "gap_start").limit(n)


def recent_gaps(df: DataFrame, ts: str = "occurred_at", min_gap: float = GAP_SECONDS,
                days: int = 1) -> DataFrame:
    """Gaps that end within the last ``days`` of the data."""
    newest = df.agg(F.max(ts).cast("timestamp").alias("_newest"))
    edge = newest.select((F.col("_newest") - F.make_dt_interval(F.lit(days))).alias("_edge"))
    gaps = table_gaps(df, ts, min_gap)
    return gaps.where(F.col("gap_end") > edge.scalar())


def newest(df: DataFrame, n: int, ts: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


def last_time(df: DataFrame, epoch: str = "created_utc") -> DataFrame:
    """Latest epoch, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(epoch), F.lit(0)).alias("last_epoch"))


def staleness(df: DataFrame, as_of, group: str | None = None, ts: str = "occurred_at",
              threshold: float = GAP_SECONDS) -> DataFrame:
    """Is the newest row at least ``threshold`` seconds old? No rows means no gap."""
    keys = [group] if group else []
    now = as_column(as_of).cast("timestamp")
    out = df.groupBy(*keys).agg(F.max(ts).cast("timestamp").alias("last_at"))
    age = (micros(now) - micros(F.col("last_at"))) / 1_000_000.0
    return out.select(*keys, "last_at", age.alias("age_seconds"),
                      F.coalesce(age >= threshold, F.lit(False)).alias("is_gap"))


def fill_plan(gaps: DataFrame, group: str | None = None) -> DataFrame:
    """All gaps ranked by length over the whole table, with their window in days."""
    ties = [F.col(group)] if group else []
    order = [F.desc("gap_duration_seconds"), F.col("gap_start"), *ties]
    return (with_row_index(gaps, order, "_index")
            .withColumn("fill_rank", F.col("_index") + 1)
            .withColumn("window_days", gap_days(F.col("gap_duration_seconds")))
            .drop("_index"))


def fill_from_archive(known: DataFrame, archive: DataFrame, gaps: DataFrame, group: str,
                      ts: str = "occurred_at", key: str = "id",
                      terms: list[str] | None = None) -> DataFrame:
    """Archive rows inside the gaps that are not known yet, each once; ``sources.fill`` appends them.

    ``terms`` keeps only rows that hold one, named in ``term``; their texts are
    dropped before the join.
    """
    if terms:
        archive = archive.withColumn("term", first_matched_term(searchable(archive), terms)).where("term IS NOT NULL")
        archive = archive.drop("title", "selftext")
    found = unseen(interval_join(archive, gaps.select(group, "gap_start", "gap_end"), [group],
                                 ts, "gap_start", "gap_end"), known, key)
    return first_per_key(found, [key], [F.col("gap_start")])


def collection_counters(df: DataFrame, as_of, key: str = "id", ts: str = "occurred_at",
                        fetched: str = "ingested_at",
                        max_age: float = MAX_FETCH_AGE_SECONDS) -> DataFrame:
    """Counters in long form: metric, value, alert."""
    now = micros(as_column(as_of).cast("timestamp"))
    one = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.countDistinct(key).cast("double").alias("known_keys"),
        ((now - F.max(micros(F.col(fetched)))) / 1_000_000.0).alias("fetch_age_seconds"),
        ((now - F.max(micros(F.col(ts)))) / 1_000_000.0).alias("data_gap_seconds"))
    named = ", ".join(f"'{c}', {c}" for c in one.columns)
    return one.selectExpr(f"stack(4, {named}) as (metric, value)").withColumn(
        "alert", F.coalesce((F.col("metric") == "fetch_age_seconds") & (F.col("value") > max_age),
                            F.lit(False)))
