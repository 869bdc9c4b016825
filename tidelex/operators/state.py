"""Claiming events and reporting on processing state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.functions.timefn import as_column, bucket, micros
from tidelex.operators.filters import unprocessed

CLAIM_SIZE = 100


def claim_oldest(events: DataFrame, ledger: DataFrame | None = None, n: int = CLAIM_SIZE) -> DataFrame:
    """The ``n`` oldest unprocessed events that no earlier claim has taken."""
    open_events = unprocessed(events)
    if ledger is not None:
        open_events = open_events.join(ledger.select("id", "occurred_at").distinct(),
                                       ["id", "occurred_at"], "left_anti")
    return open_events.orderBy("occurred_at", "id").limit(n)


def with_claims(events: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Events as the claims have left them: a claimed one is processed, from the time of its first claim.

    The event table is not rewritten when events are claimed; every report on
    processing state reads it through this.
    """
    if ledger is None:
        return events
    taken = ledger.groupBy("id", "occurred_at").agg(F.min("claimed_at").alias("_claimed"))
    claimed = F.col("_claimed").isNotNull()
    return events.join(taken, ["id", "occurred_at"], "left").withColumns({
        "processed": F.when(claimed, F.lit(True)).otherwise(F.col("processed")),
        "processed_at": F.coalesce("processed_at", "_claimed")}).select(*events.columns)


def state_summary(events: DataFrame) -> DataFrame:
    """Count and time span by processing flag; null is a group of its own."""
    return events.groupBy("processed").agg(
        F.count(F.lit(1)).alias("events"), F.min("occurred_at").alias("oldest"),
        F.max("occurred_at").alias("newest"))


def backlog(events: DataFrame, as_of) -> DataFrame:
    """Open events, the oldest of them, and events processed in the last hour."""
    now = as_column(as_of).cast("timestamp")
    open_event = ~F.coalesce(F.col("processed"), F.lit(False))
    done = F.col("processed") & (F.col("processed_at") > now - F.expr("INTERVAL 1 HOUR")) & (
        F.col("processed_at") <= now)
    return events.agg(
        F.count_if(open_event).alias("backlog"),
        F.min(F.when(open_event, F.col("occurred_at"))).alias("oldest_open"),
        F.count_if(done).alias("processed_last_hour"))


def hourly_activity(events: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Processed events per hour over the last ``hours``."""
    now = as_column(as_of).cast("timestamp")
    since = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    return (events.where(F.col("processed") & (F.col("processed_at") >= since)
                         & (F.col("processed_at") <= now))
            .groupBy(bucket(F.col("processed_at"), "hour").alias("hour"))
            .agg(F.count(F.lit(1)).alias("processed_count")))


def freshness(events: DataFrame, limit_seconds: int = 3600) -> DataFrame:
    """Share of processed events done within the limit, and mean processed per busy minute."""
    done = events.where(F.col("processed") & F.col("processed_at").isNotNull())
    in_time = micros(F.col("processed_at")) - micros(F.col("ingested_at")) <= limit_seconds * 1_000_000
    minutes = done.groupBy(bucket(F.col("processed_at"), "minute").alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(in_time).alias("ok"))
    return minutes.agg((F.sum("ok") / F.sum("n")).alias("share_in_time"),
                       F.avg("n").alias("mean_per_minute"))


def batch_outcome(routed: DataFrame) -> DataFrame:
    """Attempted, succeeded and failed events of a routed batch; a skip is a success."""
    failed = F.col("route") == "dead_letter"
    return routed.agg(F.count(F.lit(1)).alias("attempted"),
                      F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))
