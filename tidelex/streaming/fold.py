"""Folding the parts of many micro-batches into one dated metric table.

A streaming job writes one folder per batch, whose counts and sums add up. A
fold takes the finished batches after the last one it holds, adds their parts to
the dates they touch, and publishes these dates together with the number of the
last batch. A fold that is lost before that, or run again, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.sources import dated

DATE = "bucket_date"
SUMS = ("n", "score_sum")


def _added(df: DataFrame, ts: str, sums: tuple[str, ...]) -> DataFrame:
    keys = [c for c in df.columns if c not in (*sums, DATE)]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).withColumn(DATE, F.to_date(ts))


def _parts(spark: SparkSession, parts: str, batches: list[int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{parts}/batch_id={b}" for b in batches]) if batches else None


def open_batches(spark: SparkSession, parts: str, through: int | None) -> list[int]:
    """Finished batches that are not folded yet, up to the first that is not finished."""
    there = [b for b in dated.finished(spark, parts, "batch_id") if through is None or b > through]
    first = there[0] if there and through is None else (through or 0) + 1
    return [b for i, b in enumerate(there) if b == first + i]


def fold(spark: SparkSession, parts: str, table: str, ts: str = "time_bucket", sums: tuple[str, ...] = SUMS) -> dict:
    """Fold finished batches below ``parts`` into ``table``. Returns what it did: version, batches, days.

    Only the dates that the new batches touch are read and rewritten. Rows
    without a time are not folded.
    """
    held = dated.manifest(spark, table)
    batches = open_batches(spark, parts, held.note.get("through"))
    if not batches:
        return {"version": held.version, "batches": 0, "days": []}
    new = _added(_parts(spark, parts, batches).where(F.col(ts).isNotNull()), ts, sums)
    days = dated.days_of(new, DATE)
    old = dated.read(spark, table, held, days)
    merged = new if old is None else _added(old.unionByName(new), ts, sums)
    told = dated.replace_days(merged, table, days, DATE, held.note | {"through": batches[-1]})
    return {"version": told.version, "batches": len(batches), "days": days}


def folded(spark: SparkSession, parts: str, table: str, ts: str = "time_bucket", sums: tuple[str, ...] = SUMS) -> DataFrame:
    """The metric table with the batches that are not folded yet: one folder per date, and one per open batch."""
    held = dated.manifest(spark, table)
    rows = dated.read(spark, table, held)
    late = _parts(spark, parts, open_batches(spark, parts, held.note.get("through")))
    if late is not None:
        late = _added(late.where(F.col(ts).isNotNull()), ts, sums)
        rows = late if rows is None else _added(rows.unionByName(late), ts, sums)
    if rows is None:
        raise ValueError(f"neither {parts} nor {table} holds a batch")
    return rows.drop(DATE)


def rebuild(metric: DataFrame, table: str, changed: DataFrame, ts: str = "time_bucket", changed_ts: str = "occurred_at") -> list[str]:
    """Rewrite the dates of ``changed`` rows from ``metric``, the metric over corrected rows. Returns these dates.

    The metric is evaluated for them only. The note on folded batches stays: run
    it when the batches the correction knows of are folded.
    """
    days = dated.days_of(changed.select(F.to_date(changed_ts).alias(DATE)), DATE)
    if days:
        rows = metric.withColumn(DATE, F.to_date(ts)).where(F.col(DATE).cast("string").isin(days))
        dated.replace_days(rows, table, days, DATE)
    return days


def drop_folded(spark: SparkSession, parts: str, table: str, keep: int = 2) -> int:
    """Delete batch folders that the manifest before the newest already held, and folders no manifest names."""
    versions = dated.finished(spark, f"{table}/manifest", "version")
    gone = dated.clean(spark, table, keep)
    if len(versions) < 2:
        return gone
    through = dated.manifest(spark, table, versions[-2]).note.get("through")
    jvm = spark._jvm
    for b in dated.finished(spark, parts, "batch_id"):
        if through is not None and b <= through:
            path = jvm.org.apache.hadoop.fs.Path(f"{parts}/batch_id={b}")
            gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone
