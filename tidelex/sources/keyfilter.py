"""Stored Bloom filters over the keys of a dated table.

A filter belongs to a date. It is kept as words of 64 bits, one row per word
that has a bit, below the table in a folder that readers of the table skip, so
it is built and tested by joins and aggregates whatever its size is. The filters
of a month lie in one folder, in the order of their dates, so that a table of
many small days has few filter files. A key that a filter does not hold is
certainly not stored; the others are compared with the stored keys.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Filters in folders per date, as they were kept before, are not read: such dates get a filter here when they are met.
FOLDER = "_key_filter/by_month"
#: Bits of a date's filter. About a tenth of them per key and hash keeps wrong hits below one in a thousand.
BITS = 1 << 23
HASHES = 4
DATE = "occurred_date"
MONTH = "month"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _files(spark, path)
    return fs.exists(target)


def bits_of(spark: SparkSession, table: str) -> int | None:
    """Bits of the table's filters, null if it has none."""
    fs, target = _files(spark, f"{table}/{FOLDER}")
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    found = [int(n.split("=")[1]) for n in names if n.startswith("bits=")]
    return found[0] if found else None


def stored_dates(spark: SparkSession, table: str) -> set[str]:
    """Dates that have a folder, as text: one listing and one answer, however many there are."""
    fs, target = _files(spark, table)
    jvm = spark._jvm
    names = jvm.org.apache.commons.lang3.ArrayUtils.toString(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(target)))
    return set(re.findall(rf"/{DATE}=([^,/}}]+)(?=[,}}])", names))


def _frame(spark: SparkSession, dates: list) -> DataFrame:
    return spark.createDataFrame(pa.table({DATE: pa.array(dates, pa.date32())}))


def _of_dates(rows: DataFrame, dates: list) -> DataFrame:
    """Rows of some dates, by a join: a list of thousands of literals would have to be planned."""
    return rows.join(F.broadcast(_frame(rows.sparkSession, dates)), DATE, "left_semi")


def _words(keys: DataFrame, key: list[str], bits: int) -> DataFrame:
    """(columns of ``keys``, word, mask) for every hash of a key."""
    def place(i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(i), *[F.col(c) for c in key]), F.lit(bits))
    places = keys.withColumn("_place", F.explode(F.array(*[place(i) for i in range(HASHES)])))
    return places.select(*keys.columns, F.shiftright("_place", 6).alias("word"),
                         F.expr("shiftleft(1L, cast(_place & 63 as int))").alias("mask"))


def stored_filter(spark: SparkSession, table: str, bits: int, dates: list) -> DataFrame:
    """Words of the filters of some dates; only files of their months are opened."""
    words = spark.read.schema(f"{DATE} date, word long, bits long, {MONTH} date").parquet(f"{table}/{FOLDER}/bits={bits}")
    of_months = words.where(F.col(MONTH).isin(sorted({d.replace(day=1) for d in dates})))
    if dates:
        of_months = of_months.where(F.col(DATE).between(F.lit(min(dates)), F.lit(max(dates))))
    return _of_dates(of_months, dates).groupBy(DATE, "word").agg(F.bit_or("bits").alias("bits"))


def add(keys: DataFrame, table: str, key: list[str], bits: int = BITS) -> None:
    """Add keys (with their date) to the filters.

    Parts are combined when they are read, so adding a key again changes
    nothing. Add keys before their rows are written: a run that is lost in between
    leaves keys too many, which costs a comparison, and never one too few.
    """
    spark = keys.sparkSession
    bits = bits_of(spark, table) or bits
    words = _words(keys.select(DATE, *key), key, bits).groupBy(DATE, "word").agg(F.bit_or("mask").alias("bits"))
    (words.withColumn(MONTH, F.trunc(DATE, "month")).repartitionByRange(DATE, "word").sortWithinPartitions(MONTH, DATE, "word")
     .write.mode("append").partitionBy(MONTH).parquet(f"{table}/{FOLDER}/bits={bits}"))


def maybe_stored(keys: DataFrame, table: str, key: list[str], dates: list) -> DataFrame:
    """The keys that the filters of their dates may hold: all that are stored, and few others."""
    spark = keys.sparkSession
    bits = bits_of(spark, table)
    asked = _words(_of_dates(keys, dates).select(DATE, *key), key, bits)
    told = asked.join(stored_filter(spark, table, bits, dates), [DATE, "word"], "left")
    hit = F.col("bits").isNotNull() & (F.col("bits").bitwiseAND(F.col("mask")) != 0)
    return told.groupBy(DATE, *key).agg(F.bool_and(hit).alias("_all")).where("_all").drop("_all")


def _dates(rows: DataFrame) -> list:
    return [r[0] for r in rows.select(DATE).distinct().collect() if r[0] is not None]


def _rows(spark: SparkSession, table: str, dates: list) -> DataFrame:
    """Rows of some dates; no other folder is listed or opened."""
    return spark.read.option("basePath", table).parquet(*[f"{table}/{DATE}={d}" for d in dates])


def stored_keys(keys: DataFrame, table: str, key: list[str]) -> DataFrame | None:
    """Those of ``keys`` (one row each, with their date) that the table holds; null if none can be.

    Reads the filters of the dates concerned, and the key columns of dates where a
    filter says maybe. Dates that were written without a filter are compared whole
    and get one.
    """
    spark = keys.sparkSession
    # As many rows as the batch has days.
    stored = stored_dates(spark, table)
    held = [d for d in _dates(keys) if str(d) in stored]
    bits = bits_of(spark, table)
    filtered = set(_dates(stored_filter(spark, table, bits, held))) if bits and held else set()
    bare = [d for d in held if d not in filtered]
    suspects, open_dates = _of_dates(keys, bare).select(DATE, *key), list(bare)
    if filtered:
        maybe = maybe_stored(keys, table, key, sorted(filtered)).checkpoint()
        open_dates += _dates(maybe)
        suspects = suspects.unionByName(maybe)
    if not open_dates:
        return None
    if bare:
        add(_rows(spark, table, bare).select(DATE, *key), table, key)
    return suspects.select(*key).join(_rows(spark, table, open_dates).select(*key), key, "left_semi")
