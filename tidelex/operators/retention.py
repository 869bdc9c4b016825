"""Compaction of old partitions and payload archiving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.sources import dated

COMPACT_AFTER_DAYS = 90
ARCHIVE_AFTER_DAYS = 365


def older_than(df: DataFrame, as_of: str, days: int, ts: str = "occurred_at") -> DataFrame:
    edge = F.date_sub(F.to_date(F.lit(as_of)), days)
    day = F.col("occurred_date") if "occurred_date" in df.columns else F.to_date(ts)
    return df.where(day < edge)


def compact(events: DataFrame, as_of: str, out: str, days: int = COMPACT_AFTER_DAYS) -> None:
    """Rewrite old dates as few sorted zstd files.

    The range shuffle sizes files by rows, so a hot date gets several files and
    small dates share a task.
    """
    old = older_than(events, as_of, days)
    order = ["occurred_date", "source", "occurred_at"]
    (old.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").option("compression", "zstd").partitionBy("occurred_date").parquet(out))


def split_payload(events: DataFrame, as_of: str, days: int = ARCHIVE_AFTER_DAYS) -> tuple[DataFrame, DataFrame]:
    """(hot, cold): hot has null payloads for old rows, cold holds those payloads by key."""
    edge = F.date_sub(F.to_date(F.lit(as_of)), days)
    old = F.to_date("occurred_at") < edge
    hot = events.withColumn("payload", F.when(~old, F.col("payload")))
    cold = events.where(old).select("id", "occurred_at", "payload")
    return hot, cold


def restore_payload(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Put archived payloads back by key."""
    archived = cold.withColumnRenamed("payload", "_cold")
    return (hot.join(archived, ["id", "occurred_at"], "left")
            .withColumn("payload", F.coalesce("payload", "_cold")).drop("_cold").select(*hot.columns))


def compact_table(table: str, spark: SparkSession, as_of: str, days: int = COMPACT_AFTER_DAYS, order: list[str] | None = None) -> list[str]:
    """Swap old dates of a dated table for few sorted files. Returns the dates rewritten.

    Readers see the old files or the new ones. A date that was compacted is noted
    and left alone until it is written again.
    """
    held = dated.manifest(spark, table)
    edge = str(spark.range(1).select(F.date_sub(F.to_date(F.lit(as_of)), days)).first()[0])
    done = held.note.get("compacted", {})
    old = sorted(d for d, v in held.days.items() if d < edge and done.get(d) != v)
    if old:
        note = held.note | {"compacted": {d: v for d, v in done.items() if held.days.get(d) == v} | {d: held.version + 1 for d in old}}
        dated.replace_days(dated.read(spark, table, held, old), table, old, held.date, note, order or ["source", "occurred_at"])
    return old


def archive_payloads(table: str, cold: str, spark: SparkSession, as_of: str, days: int = ARCHIVE_AFTER_DAYS) -> list[str]:
    """Move the payloads of old dates of a dated table to a cold table. Returns the dates moved.

    The cold rows are written first and the hot dates rewritten after that, so a
    run that is lost in between is repeated without losing a payload; a date whose
    payloads are moved already is left alone.
    """
    held = dated.manifest(spark, table)
    edge = str(spark.range(1).select(F.date_sub(F.to_date(F.lit(as_of)), days)).first()[0])
    moved = set(held.note.get("archived", []))
    old = sorted(d for d in held.days if d < edge and d not in moved)
    if old:
        rows = dated.read(spark, table, held, old)
        dated.replace_days(rows.select("id", "occurred_at", "payload", held.date), cold, old, held.date)
        note = held.note | {"archived": sorted(moved | set(old))}
        dated.replace_days(rows.withColumn("payload", F.lit(None).cast("string")), table, old, held.date, note)
    return old


def restored(spark: SparkSession, table: str, cold: str) -> DataFrame:
    """The hot table with archived payloads put back."""
    hot, held = dated.read(spark, table), dated.read(spark, cold)
    return hot if held is None else restore_payload(hot, held.select("id", "occurred_at", "payload"))
