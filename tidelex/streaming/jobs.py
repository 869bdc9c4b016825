"""Streaming jobs: ingest, analysis, hourly metrics, late rows, idle sources, push.

Each micro-batch writes below ``batch_id=N`` in overwrite mode, so a replayed
batch replaces its own output. Removing copies is done inside the micro-batch
with an aggregate that works before the shuffle, then against the stored table,
which finds repeats of any age and keeps no key state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelex.functions.timefn import as_column, micros
from tidelex.operators.mapping import normalize_submission, split_bad, to_envelope
from tidelex.operators.metrics import hourly_metric, merge_metrics
from tidelex.operators.results import dead_letters, result_rows, route_events, skipped_rows
from tidelex.operators.state import CLAIM_SIZE, claim_oldest
from tidelex.session import materialize
from tidelex.sources.sinks import append_events, fan_out, push_batches, table_exists

CYCLE = "60 seconds"


def start(stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None],
          once: bool = True, mode: str = "append", cycle: str = CYCLE) -> StreamingQuery:
    """Start a query: all available input once, or a cycle that goes on."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(each_batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=cycle)).start()


def ingest(posts: DataFrame, table: str, quarantine: str, source: str, checkpoint: str, once: bool = True,
           sinks: list[Callable[[DataFrame], object]] | None = None) -> StreamingQuery:
    """Landing records into the event table, unreadable ones into quarantine.

    ``sinks`` get the envelopes of each batch too; one that fails does not keep the others from theirs.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        good, bad = split_bad(df)
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
        fan_out(to_envelope(normalize_submission(good), source), [lambda rows: append_events(rows, table), *(sinks or [])])

    return start(posts, checkpoint, batch, once)


def analyze(events: DataFrame, out: str, checkpoint: str, make_scorer=None, once: bool = True,
            clock: Callable[[], Column] = F.current_timestamp) -> StreamingQuery:
    """Events to results, dead letters, skips and metric parts.

    The routed batch is written once and every output is derived from it. Metric
    parts are per batch and merge by addition, so rows of any age count and no
    state is kept.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        routed_path = f"{out}/routed/batch_id={batch_id}"
        route_events(df, make_scorer=make_scorer).withColumn("_now", clock().cast("timestamp")).write.mode(
            "overwrite").parquet(routed_path)
        routed = spark.read.parquet(routed_path)
        at = F.col("_now")
        results = result_rows(routed, at)
        results.write.mode("overwrite").parquet(f"{out}/results/batch_id={batch_id}")
        dead_letters(routed, at).write.mode("overwrite").parquet(f"{out}/dead_letters/batch_id={batch_id}")
        skipped_rows(routed).write.mode("overwrite").parquet(f"{out}/skipped/batch_id={batch_id}")
        stored = spark.read.parquet(f"{out}/results/batch_id={batch_id}")
        hourly_metric(stored, "occurred_at").write.mode("overwrite").parquet(f"{out}/metrics/batch_id={batch_id}")

    return start(events, checkpoint, batch, once)


def merged_metrics(spark: SparkSession, out: str) -> DataFrame:
    """Metric table of an analysis job, over all its batches."""
    return merge_metrics(spark.read.parquet(f"{out}/metrics").drop("batch_id"))


def windowed_counts(events: DataFrame, keys: list[str], value: str, width: str = "1 hour", ts: str = "occurred_at") -> DataFrame:
    """Count and sum per tumbling window and key; these parts add up over batches."""
    return (events.groupBy(F.window(ts, width).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("score_sum"))
            .select(F.col("w.start").alias("time_bucket"), *keys, "n", "score_sum"))


def hourly_metrics(events: DataFrame, keys: list[str], value: str, out: str, checkpoint: str,
                   width: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Windowed metrics. Each batch writes the part its rows add to every window, so rows of any age count and no
    state is kept."""
    def batch(df: DataFrame, batch_id: int) -> None:
        windowed_counts(df, keys, value, width).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return start(events, checkpoint, batch, once)


def total_per_window(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The value of each window over all batches."""
    return spark.read.parquet(out).groupBy("time_bucket", *keys).agg(F.sum("n").alias("n"), F.sum("score_sum").alias("score_sum"))


def split_late(events: DataFrame, out: str, checkpoint: str, delay_seconds: int, ts: str = "occurred_at",
               once: bool = True) -> StreamingQuery:
    """Separate rows that are older than the newest earlier row by more than the delay.

    The newest time of each batch is stored with the batch; batch N compares with
    the batches before it, so a replay gives the same split.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        spark, marks = df.sparkSession, f"{out}/marks"
        seen = None
        if table_exists(spark, marks):
            seen = spark.read.parquet(marks).where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        age = F.lit(False) if seen is None else micros(F.col(ts)) < seen - delay_seconds * 1_000_000
        df.withColumn("late", F.coalesce(age, F.lit(False))).write.mode("overwrite").partitionBy("late").parquet(
            f"{out}/rows/batch_id={batch_id}")
        df.agg(F.max(micros(F.col(ts))).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")

    return start(events, checkpoint, batch, once)


def last_seen(spark: SparkSession, out: str, group: str) -> DataFrame:
    """Newest time of each group over all batches of ``idle_sources``."""
    return spark.read.parquet(f"{out}/last_seen").groupBy(group).agg(F.max("last_us").alias("last_us"))


def raise_idle_alarms(spark: SparkSession, out: str, group: str, as_of, threshold_seconds: int = 600) -> DataFrame:
    """Alarms for groups whose newest row is at least the threshold older than ``as_of``.

    It needs no new data, so it also finds that everything has stopped: run it by
    the clock. A group alarms once for each time it stops; what was raised before is
    not raised again. Returns and stores the new alarms.
    """
    now = micros(as_column(as_of).cast("timestamp"))
    idle = (last_seen(spark, out, group).withColumn("idle_seconds", (now - F.col("last_us")) / 1_000_000.0)
            .where(F.col("idle_seconds") >= threshold_seconds)
            .select(group, F.timestamp_micros("last_us").alias("gap_start"), "idle_seconds"))
    path = f"{out}/alarms"
    if table_exists(spark, path):
        idle = idle.join(spark.read.parquet(path).select(group, "gap_start"), [group, "gap_start"], "left_anti")
    new = materialize(idle)
    new.write.mode("append").parquet(path)
    return new


def idle_sources(events: DataFrame, group: str, out: str, checkpoint: str, threshold_seconds: int = 600,
                 ts: str = "occurred_at", once: bool = True, clock: Callable[[], Column] | None = None) -> StreamingQuery:
    """Keep the newest time of every group, and raise idle alarms after each cycle.

    A batch stores the newest times of the groups it holds, taken before the
    shuffle, so a busy group is as cheap as a quiet one. Without a ``clock`` the
    newest time of all stands for now; a caller with a clock also runs
    ``raise_idle_alarms`` when no batch comes.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        df.groupBy(group).agg(F.max(micros(F.col(ts))).alias("last_us")).write.mode("overwrite").parquet(
            f"{out}/last_seen/batch_id={batch_id}")
        newest = last_seen(spark, out, group).agg(F.max("last_us")).first()[0]
        now = clock() if clock else F.timestamp_micros(F.lit(newest))
        raise_idle_alarms(spark, out, group, now, threshold_seconds)

    return start(events, checkpoint, batch, once)


def claim(spark: SparkSession, events: DataFrame, ledger: str, n: int = CLAIM_SIZE, at: Column | None = None) -> DataFrame:
    """Take the ``n`` oldest unprocessed events and record them with the time, so that the next claim takes others
    and reports count them as processed (``state.with_claims``)."""
    claimed = materialize(claim_oldest(events, claims(spark, ledger), n))
    now = F.current_timestamp() if at is None else at.cast("timestamp")
    claimed.select("id", "occurred_at", now.alias("claimed_at")).write.mode("append").parquet(ledger)
    return claimed


def claims(spark: SparkSession, ledger: str) -> DataFrame | None:
    """All claims recorded so far, null if there are none."""
    return spark.read.parquet(ledger) if table_exists(spark, ledger) else None


def without_repeats(stream: DataFrame, key: list[str], remembered: str = "1 day") -> DataFrame:
    """Rows of a stream whose key did not arrive within the time ``remembered`` before.

    Keys are remembered by the time they arrive, not by the time of the event, so
    rows of any age pass and the state holds the keys of that time only. Repeats
    that come later are left to the sink.
    """
    return (stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remembered)
            .dropDuplicatesWithinWatermark(key).drop("_arrived"))


def push(results: DataFrame, outbox: str, checkpoint: str, size: int = 100, once: bool = True) -> StreamingQuery:
    """Push rows in groups, written to an outbox folder."""
    def batch(df: DataFrame, batch_id: int) -> None:
        push_batches(df, size).write.mode("overwrite").json(f"{outbox}/batch_id={batch_id}")

    return start(results, checkpoint, batch, once)
