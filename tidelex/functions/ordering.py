"""Row numbers, latest-row selection and time gaps that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelex.functions.timefn import micros
from tidelex.session import materialize

_ROW_MASK = (1 << 33) - 1


def with_row_index(df: DataFrame, order: list[Column], name: str = "row_index",
                   partitions: int | None = None) -> DataFrame:
    """Number all rows from 0 in the given (total) order.

    A range shuffle spreads the rows evenly whatever their keys are; the only
    table brought together is one row count per partition.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
               .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")))
    # One row per partition: the size is bounded by ``n``.
    return (ranged.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_pos"))
            .drop("_part", "_pos", "_offset"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Number the rows of each key (all rows, without keys) from 1 in ascending ``order``, nulls first.

    Only keys and order columns are put in order and checkpointed: a range
    shuffle spreads them evenly, each range counts its rows of a key, and a sum
    over the ranges of a key tells where each of them starts. Whole rows are
    shuffled once, to meet their number. The order should be total: rows equal in
    keys and order meet in one task, where a hash of the others decides.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.struct(*[F.col(c) for c in [*keys, *order]])
    by = [F.col(f"_at.`{c}`") for c in [*keys, *order]]
    ranged = materialize(df.groupBy(at.alias("_at")).agg(F.count(F.lit(1)).alias("_rows"))
                         .repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()))
    told = ranged.select("_at", "_rows", "_part", F.struct(*(by[:len(keys)] or [F.lit(0)])).alias("_key"))
    in_range = Window.partitionBy("_part", "_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row for each key and range.
    ranges = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (told.groupBy("_key", "_part").agg(F.sum("_rows").alias("_size"))
              .select("_key", "_part", F.coalesce(F.sum("_size").over(ranges), F.lit(0)).alias("_start")))
    first = (told.withColumn("_inside", F.coalesce(F.sum("_rows").over(in_range), F.lit(0)))
             .join(starts, ["_key", "_part"]).select("_at", (F.col("_start") + F.col("_inside")).alias("_before")))
    rest = [F.col(c) for c in df.columns if c not in keys and c not in order]
    tied = Window.partitionBy("_at").orderBy(F.xxhash64(*(rest or [F.lit(0)])))
    return (df.withColumn("_at", at).join(first, "_at")
            .select(*df.columns, (F.col("_before") + F.row_number().over(tied)).alias(name)))


def with_occurrence(df: DataFrame, keys: list[str], order: list[str],
                    name: str = "occurrence") -> DataFrame:
    """Number the rows of each key from 1; a hot key is not brought into one task."""
    return numbered(df, keys, order, name)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key: the first in ``order``.

    Written as an aggregate, so each task reduces its copies of a key to one
    before the shuffle. Every order column must be sortable.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c)
                           for c in df.columns])


def bin_of(us: Column, width: int) -> Column:
    """Whole number of the bin of ``width`` microseconds that holds ``us``, exact also at its edges."""
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long")


def time_gaps(df: DataFrame, keys: list[str], ts: str, min_gap_seconds: float) -> DataFrame:
    """Pauses strictly longer than ``min_gap_seconds`` between neighbouring rows.

    Two rows of one bin of that width can never be far enough apart, so only the
    first and last time of each bin matter. They are aggregated before the
    shuffle, and the ordered table has at most (time span / bin width) rows per
    key, however many rows the key has. That table is cut once more into chunks of
    65,536 bins, whose edges are compared separately, so no task holds a whole key.
    """
    least = int(round(min_gap_seconds * 1_000_000))
    width = max(least, 1)
    us = micros(F.col(ts))
    bins = (df.where(F.col(ts).isNotNull())
            .groupBy(*keys, bin_of(us, width).alias("_bin"))
            .agg(F.min(us).alias("_lo"), F.max(us).alias("_hi")))
    chunked = bins.withColumn("_chunk", F.floor(F.col("_bin") / 65536).cast("long"))
    inner = chunked.withColumn("_prev", F.lag("_hi").over(
        Window.partitionBy(*keys, "_chunk").orderBy("_bin")))
    edges = (chunked.groupBy(*keys, "_chunk")
             .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
             .withColumn("_prev", F.lag("_hi").over(
                 Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk"))))
    columns = [*keys, "_lo", "_hi", "_prev"]
    pairs = inner.select(*columns).unionByName(edges.select(*columns))
    return (pairs.where(F.col("_lo") - F.col("_prev") > least)
            .select(*keys,
                    F.timestamp_micros(F.col("_prev")).alias("gap_start"),
                    F.timestamp_micros(F.col("_lo")).alias("gap_end"),
                    ((F.col("_lo") - F.col("_prev")) / 1_000_000.0).alias("gap_duration_seconds")))


def range_join(rows: DataFrame, ranges: DataFrame, keys: list[str], ts: str,
               lo: str, hi: str, bin_seconds: int = 86_400, salts: int = 1,
               salt_by: list[str] | None = None) -> DataFrame:
    """Rows whose time lies in ``[lo, hi]`` of a range with the same keys.

    The ranges are expanded to the time bins they touch, which makes the join an
    equality join on (keys, bin); the exact bounds are tested afterwards. A row
    is in one bin only, so a pair is found once. AQE splits skewed bins; where
    one key and bin is known to be hot, ``salts`` spreads its rows over that
    many tasks (by ``salt_by``, or by time) and repeats the few ranges for each.
    """
    width = bin_seconds * 1_000_000
    left = rows.withColumns({"_bin": bin_of(micros(F.col(ts)), width),
                             "_salt": F.pmod(F.xxhash64(*(salt_by or [ts])), F.lit(salts))})
    right = ranges.withColumn("_bin", F.explode(F.sequence(
        bin_of(micros(F.col(lo)), width), bin_of(micros(F.col(hi)), width))))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return (left.join(right, [*keys, "_bin", "_salt"])
            .where((F.col(ts) >= F.col(lo)) & (F.col(ts) <= F.col(hi)))
            .drop("_bin", "_salt"))


def interval_join(rows: DataFrame, ranges: DataFrame, keys: list[str], ts: str,
                  lo: str, hi: str, chunk_seconds: int = 21_600) -> DataFrame:
    """Rows whose time lies in ``[lo, hi]`` of a range with the same keys, for ranges that do not overlap.

    Ranges of one key may touch: a row at a shared end is in both. Range starts
    and rows are put in time order and the last start at or before a row is
    carried forward, so a range of any length is one row. Keys are cut into
    chunks of time, whose last starts are carried on apart: a hot key is spread
    over its chunks, and no task holds a whole key. Give it narrow rows: all
    their columns are shuffled. Null keys, times and bounds match nothing.
    """
    width = chunk_seconds * 1_000_000
    others = [c for c in ranges.columns if c not in keys]
    there = F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    left = rows.where(there & F.col(ts).isNotNull()).select(
        *keys, micros(F.col(ts)).alias("_us"), F.struct(*[F.col(c) for c in rows.columns if c not in keys]).alias("_row"))
    right = ranges.where(there & F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(*keys, micros(F.col(lo)).alias("_us"), F.struct(
        micros(F.col(lo)).alias("_lo"), micros(F.col(hi)).alias("_hi"), *others).alias("_range"))
    empty = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    both = (left.select(*keys, "_us", "_row", empty(right, "_range"))
            .unionByName(right.select(*keys, "_us", empty(left, "_row"), "_range"))
            .withColumn("_chunk", F.floor(F.col("_us") / width)))
    # The last start at or before a row, and the one before that where two ranges touch at the row.
    order = Window.partitionBy(*keys, "_chunk").orderBy("_us")
    carried = both.select(
        *keys, "_chunk", "_us", "_row",
        F.last("_range", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("_at"),
        F.last("_range", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, -1)).alias("_before")).where(F.col("_row").isNotNull())
    edges = both.groupBy(*keys, "_chunk").agg(F.max_by("_range", F.when(F.col("_range").isNotNull(), F.col("_us"))).alias("_last"))
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(past).alias("_earlier"))
    found = carried.join(edges, [*keys, "_chunk"]).withColumn("_range", F.explode(F.array_distinct(F.array(
        F.coalesce("_at", "_earlier"), F.coalesce("_before", "_earlier"))))).where(F.col("_us") <= F.col("_range._hi"))
    return found.select(*keys, "_row.*", *[F.col(f"_range.`{c}`").alias(c) for c in others])
