"""Idle alarms by event-time timers: one small state per group instead of a folder per batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidelex.functions.timefn import micros

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FORGET_SECONDS = 30 * 86_400


def _millis(us: int) -> int:
    return -(-us // 1000)


class IdleTimer(StatefulProcessor):
    """Newest time of a group, with a timer for the time after which it is idle, and then one after which it is forgotten.

    Spark passes arguments by keyword, so their names are fixed.
    """

    def __init__(self, threshold_seconds: int, forget_seconds: int):
        self.threshold, self.forget = threshold_seconds * 1000, forget_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("newest", "us long, raised boolean")

    def _await(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        newest = max(int(part["us"].max()) for part in rows)
        # A null group is the clock: it moves the watermark and has no state.
        if key[0] is not None and (not self.held.exists() or newest > self.held.get()[0]):
            self.held.update((newest, False))
            self._await(_millis(newest) + self.threshold)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.held.exists():
            return
        newest, raised = self.held.get()
        if raised:
            self.held.clear()
            return
        now = timerValues.getCurrentWatermarkInMs()
        self.held.update((newest, True))
        self._await(_millis(newest) + max(self.forget, self.threshold + 1))
        yield pd.DataFrame({"group": [key[0]], "us": [newest], "idle_seconds": [(now * 1000 - newest) / 1e6]})

    def close(self) -> None:
        pass


def idle_alarms(events: DataFrame, group: str, threshold_seconds: int = 600, ts: str = "occurred_at",
                late: str = "0 seconds", forget_seconds: int = FORGET_SECONDS) -> DataFrame:
    """A stream of alarms: group, gap_start, idle_seconds, one each time a group has been silent for the threshold.

    Now is the watermark: the newest time of all rows, less ``late``. Rows that are
    older than that do not count any more, so ``late`` is the disorder that is to
    be expected. To notice that everything is silent, mix in rows with a null group
    and the time of the clock. A group is one number and one timer, until it has
    been silent for ``forget_seconds``.
    """
    rows = (events.select(F.col(group).cast("string").alias("group"), F.col(ts).alias("ts")).where(F.col("ts").isNotNull())
            .withWatermark("ts", late).withColumn("us", micros(F.col("ts"))))
    found = rows.groupBy("group").transformWithStateInPandas(
        IdleTimer(threshold_seconds, forget_seconds), "group string, us long, idle_seconds double", "append", "eventTime")
    return found.select(F.col("group").alias(group), F.timestamp_micros("us").alias("gap_start"), "idle_seconds")


def watch(alarms: DataFrame, out: str, checkpoint: str, once: bool = True, cycle: str = "60 seconds") -> StreamingQuery:
    """Write alarms to a folder, each once. Timers need the RocksDB state store, which only this query is started with."""
    spark = alarms.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = alarms.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=cycle)).start()
    finally:
        spark.conf.set(PROVIDER, before)
