"""Percentiles that roll up: metric tables with a mergeable quantile sketch next to count and sum.

A finer table gives a coarser one, and batches add up, without reading the rows
again. The sketch is Spark's KLL sketch of doubles, a few kB a row whatever the
number of values: the rank of an answer differs from the wanted one by less than
``RANK_ERROR`` (``SIZE`` is chosen so that this is more than twice the error
that holds 99 times in 100). Up to ``SIZE`` values it is exact.
``stats.exact_percentiles`` stays the way to exact answers of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.timefn import bucket, seconds_between

#: Values that a sketch holds before it thins, and the largest difference of ranks, as a share of all values.
SIZE, RANK_ERROR = 800, 0.01


def sketch_metric(rows: DataFrame, time: str, keys: list[str], value: str, size: str = "hour") -> DataFrame:
    """One row per (bucket, keys): rows ``n``, values ``n_values``, their sum, extremes and sketch.

    Null and NaN are no values; a bucket without any has a null sum and sketch.
    Rows without a time have the null bucket. Each task sketches its own rows, so
    a bucket that holds a third of all rows costs one small row a task.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    held = rows.select(bucket(F.col(time), size).alias("time_bucket"), *keys, v.alias("_v"))
    n = F.count("_v")
    return held.groupBy("time_bucket", *keys).agg(
        F.count(F.lit(1)).alias("n"), n.alias("n_values"), F.sum("_v").alias("value_sum"), F.min("_v").alias("value_min"),
        F.max("_v").alias("value_max"), F.when(n > 0, F.kll_sketch_agg_double("_v", F.lit(SIZE))).alias("sketch"))


def roll_up_sketches(*parts: DataFrame, size: str | None = None) -> DataFrame:
    """Metric tables of ``sketch_metric`` added up, in coarser buckets with ``size``."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if size is not None:
        whole = whole.withColumn("time_bucket", bucket(F.col("time_bucket"), size))
    values = ("n", "n_values", "value_sum", "value_min", "value_max", "sketch")
    found = F.count("sketch")
    return whole.groupBy(*[c for c in whole.columns if c not in values]).agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("value_sum").alias("value_sum"),
        F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"),
        F.when(found > 0, F.kll_merge_agg_double("sketch", F.lit(SIZE))).alias("sketch"))


def quantile(sketch: Column, p: float) -> Column:
    """The value of rank ``p``: the smallest with at least that share of all values at or below it, within the rank error."""
    return F.when(sketch.isNotNull(), F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))


def sketch_percentiles(metric: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Mean and percentiles instead of the sketch."""
    keep = [c for c in metric.columns if c != "sketch"]
    return metric.select(*keep, F.try_divide("value_sum", "n_values").alias("value_mean"),
                         *[quantile(F.col("sketch"), p).alias(name) for name, p in probs.items()])


def rank_errors(rows: DataFrame, found: DataFrame, time: str, keys: list[str], value: str, size: str,
                probs: dict[str, float]) -> DataFrame:
    """How far the ranks of percentiles are from the wanted ones: ``<name>_error`` per row of ``found``, as a share.

    An audit that reads the rows again. A value stands for all ranks from the
    share of smaller values to the share of those not larger.
    """
    at = ["time_bucket", *keys]
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    held = rows.select(bucket(F.col(time), size).alias("time_bucket"), *keys, v.alias("_v")).where("_v IS NOT NULL")
    # Equal values first, so that a hot bucket is smaller before it meets its percentiles.
    held = held.groupBy(*at, "_v").agg(F.count(F.lit(1)).alias("_k"))
    names = {k: F.col(k).alias(f"_a{i}") for i, k in enumerate(at)}
    told = found.select(*names.values(), *probs)
    same = [F.col(k).eqNullSafe(F.col(f"_a{i}")) for i, k in enumerate(at)]
    shares = []
    for name, p in probs.items():
        below = F.sum(F.when(F.col("_v") < F.col(name), F.col("_k")).otherwise(0)) / F.sum("_k")
        upto = F.sum(F.when(F.col("_v") <= F.col(name), F.col("_k")).otherwise(0)) / F.sum("_k")
        shares.append(F.greatest(below - p, p - upto, F.lit(0.0)).alias(f"{name}_error"))
    return held.join(told, same).groupBy(*at).agg(*shares)


def lag_percentiles(raw: DataFrame, probs: dict[str, float], size: str = "day") -> DataFrame:
    """Ingest lag per bucket and source from hourly sketches, each step merging those of the finer table."""
    return sketch_percentiles(rolled(with_lag(raw), "lag_seconds", size), probs)


def with_lag(raw: DataFrame) -> DataFrame:
    return raw.select("occurred_at", "source", seconds_between(F.col("ingested_at"), F.col("occurred_at")).alias("lag_seconds"))


def rolled(rows: DataFrame, value: str, size: str) -> DataFrame:
    """Hourly sketches per source, merged to days and then to ``size``."""
    hourly = sketch_metric(rows, "occurred_at", ["source"], value)
    return hourly if size == "hour" else roll_up_sketches(roll_up_sketches(hourly, size="day"), size=size)


def audited(rows: DataFrame, value: str, size: str, probs: dict[str, float]) -> DataFrame:
    """Rolled-up counts, sums and extremes, and whether every percentile keeps the rank error against all rows."""
    found = sketch_percentiles(rolled(rows, value, size), probs)
    errors = rank_errors(rows, found, "occurred_at", ["source"], value, size, probs)
    worst = F.greatest(*[F.col(f"{p}_error") for p in probs], F.lit(0.0))
    kept = errors.select(F.col("time_bucket").alias("_t"), F.col("source").alias("_s"), (worst <= RANK_ERROR).alias("within_rank_error"))
    return (found.join(kept, F.col("time_bucket").eqNullSafe(F.col("_t")) & F.col("source").eqNullSafe(F.col("_s")), "left")
            .select("time_bucket", "source", "n", "value_sum", "value_min", "value_max", "within_rank_error"))
