"""Tables of dated folders that change date by date.

A write puts the rows of some dates into a new folder and then publishes a
manifest that says which folder holds each date. Readers open one folder per
date, and see a change whole or not at all; a write that is lost before its
manifest leaves nothing that is read, and is written over by the next one.
Each table has one writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROWS = "day string, version long, note string"


@dataclass
class Manifest:
    """What a table holds: its date column, rows' schema, a version for each date, and the writer's own note."""

    version: int = 0
    date: str = "occurred_date"
    schema: T.StructType | None = None
    days: dict[str, int] = field(default_factory=dict)
    note: dict = field(default_factory=dict)


def finished(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Numbers of the finished folders ``prefix=N`` below ``root``."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(base)]
    found = [int(n.split("=")[1]) for n in names if n.startswith(f"{prefix}=")]
    return sorted(n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{prefix}={n}/_SUCCESS")))


def manifest(spark: SparkSession, table: str, version: int | None = None) -> Manifest:
    """The newest finished manifest, or that of a version; an empty one for a new table."""
    versions = finished(spark, f"{table}/manifest", "version")
    if version is not None:
        versions = [v for v in versions if v <= version]
    if not versions:
        return Manifest()
    # One row per date.
    rows = spark.read.schema(_ROWS).json(f"{table}/manifest/version={versions[-1]}").collect()
    told = json.loads(next(r.note for r in rows if r.day is None))
    return Manifest(versions[-1], told["date"], T.StructType.fromJson(told["schema"]),
                    {r.day: r.version for r in rows if r.day is not None}, told["note"])


def read(spark: SparkSession, table: str, held: Manifest | None = None, days: list[str] | None = None) -> DataFrame | None:
    """The table's rows, or those of some dates; null if it was never written."""
    held = held or manifest(spark, table)
    if held.schema is None:
        return None
    paths = [f"{table}/data/version={v}/{held.date}={d}" for d, v in sorted(held.days.items()) if days is None or d in days]
    if not paths:
        return spark.createDataFrame([], held.schema)
    kinds = T.StructType([*held.schema.fields, T.StructField("version", T.LongType())])
    rows = spark.read.schema(kinds).option("basePath", f"{table}/data").parquet(*paths)
    return rows.select(*held.schema.names)


def days_of(df: DataFrame, date: str) -> list[str]:
    """The dates of some rows, as text; as many as there are days."""
    return sorted(r[0] for r in df.select(F.col(date).cast("string")).where(F.col(date).isNotNull()).distinct().collect())


def replace_days(rows: DataFrame, table: str, days: list[str], date: str = "occurred_date", note: dict | None = None,
                 order: list[str] | None = None, compression: str = "zstd") -> Manifest:
    """Make ``rows`` the whole content of ``days``; other dates stay as they are. A day without rows goes.

    The range shuffle sizes files by rows, so a hot date has several files and
    small dates share a task.
    """
    spark = rows.sparkSession
    held = manifest(spark, table)
    version = held.version + 1
    path = f"{table}/data/version={version}"
    keys = [date, *(order or [])]
    kept = rows.where(F.col(date).cast("string").isin(days)) if days else rows.limit(0)
    (kept.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
     .option("compression", compression).partitionBy(date).parquet(path))
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    written = {d for d in days if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{date}={d}"))}
    content = {d: v for d, v in held.days.items() if d not in days} | {d: version for d in written}
    told = Manifest(version, date, rows.schema, content, held.note if note is None else note)
    publish(spark, table, told)
    return told


def publish(spark: SparkSession, table: str, told: Manifest) -> None:
    """Write a manifest; from now on readers follow it."""
    head = json.dumps({"date": told.date, "schema": told.schema.jsonValue(), "note": told.note})
    listed = [(None, None, head), *((d, v, None) for d, v in sorted(told.days.items()))]
    spark.createDataFrame(listed, _ROWS).coalesce(1).write.mode("overwrite").json(f"{table}/manifest/version={told.version}")


def clean(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Delete folders that none of the newest ``keep`` manifests names, and older manifests. Returns how many went."""
    jvm = spark._jvm
    versions = finished(spark, f"{table}/manifest", "version")
    newest = versions[-keep:]
    used = {(v, d) for n in newest for d, v in manifest(spark, table, n).days.items()}
    base = jvm.org.apache.hadoop.fs.Path(f"{table}/data")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for v in versions:
        folder = jvm.org.apache.hadoop.fs.Path(f"{table}/data/version={v}")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            name = status.getPath().getName()
            if "=" in name and (v, name.split("=")[1]) not in used:
                gone += bool(fs.delete(status.getPath(), True))
        if v not in newest:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{table}/manifest/version={v}"), True)
    return gone
