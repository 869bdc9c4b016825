"""Aggregates over results and raw events.

Every grouping here uses mergeable aggregates, so each task reduces its rows
before the shuffle and a hot source or bucket costs one small row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelex.functions.binding import let
from tidelex.functions.stats import exact_percentiles
from tidelex.functions.timefn import as_column, bucket, seconds_between
from tidelex.operators.filters import result_filters
from tidelex.operators.scoring import LABELS

# Bucket names.
BUCKET_SIZES = ("hour", "day", "week", "month")
SCORE, LABEL = "sentiment_score", "sentiment_label"


def count_all() -> Column:
    return F.count(F.lit(1))


def hourly_metric(results: DataFrame, by: str = "processed_at") -> DataFrame:
    """Mergeable hourly metric: count and score sum per (hour, source, source_id, label)."""
    return results.groupBy(
        bucket(F.col(by), "hour").alias("time_bucket"), "source",
        F.coalesce("source_id", F.lit("unknown")).alias("source_id"),
        F.col(LABEL).alias("label")).agg(
        count_all().alias("n"), F.sum(SCORE).alias("score_sum"))


def merge_metrics(*parts: DataFrame) -> DataFrame:
    """Add metric tables up. Sums merge; averages would not."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("time_bucket", "source", "source_id", "label").agg(
        F.sum("n").alias("n"), F.sum("score_sum").alias("score_sum"))


def with_average(metric: DataFrame) -> DataFrame:
    return metric.withColumn("avg_score", F.col("score_sum") / F.col("n"))


def roll_up(metric: DataFrame, size: str) -> DataFrame:
    """Coarser buckets from a finer metric table."""
    return metric.groupBy(bucket(F.col("time_bucket"), size).alias("time_bucket"),
                          "source", "source_id", "label").agg(
        F.sum("n").alias("n"), F.sum("score_sum").alias("score_sum"))


def bucket_aggregate(results: DataFrame, size: str = "day", limit: int | None = None,
                     extended: bool = False, **filters) -> DataFrame:
    """Count and mean score per (bucket, source, label), newest bucket first; all of them unless ``limit`` is given."""
    if size not in BUCKET_SIZES:
        raise ValueError(f"bucket must be one of {BUCKET_SIZES}, not {size!r}")
    if limit is not None and limit < 1:
        raise ValueError("limit must be 1 or more")
    aggs = [count_all().alias("count"), F.avg(SCORE).alias("avg_score")]
    if extended:
        aggs += [F.min(SCORE).alias("min_score"), F.max(SCORE).alias("max_score"),
                 F.stddev_samp(SCORE).alias("std_score")]
    out = (result_filters(results, **filters)
           .groupBy(bucket(F.col("occurred_at"), size).alias("time_bucket"), "source",
                    F.col(LABEL).alias("label")).agg(*aggs)
           .withColumn("source_id", F.lit("")))
    out = out.orderBy(F.desc("time_bucket"), "source", "label")
    return out if limit is None else out.limit(limit)


def metric_range(metric: DataFrame, start, end, size: str = "hour") -> DataFrame:
    """Metric rows between two truncated times, re-aggregated to the bucket size."""
    low = bucket(as_column(start).cast("timestamp"), size)
    high = bucket(as_column(end).cast("timestamp"), size)
    rolled = roll_up(metric, size)
    return with_average(rolled.where(F.col("time_bucket").between(low, high)))


def to_long_metrics(metric: DataFrame) -> DataFrame:
    """Wide metric rows to (metric_name, metric_value) rows."""
    keys = ["time_bucket", "source", "source_id", "label"]
    return metric.selectExpr(
        *keys, "stack(2, 'event_count', cast(n as double), 'score_sum', score_sum) "
               "as (metric_name, metric_value)")


def averages_from_long(long: DataFrame) -> DataFrame:
    """Mean score from the sum and count rows of a long metric table."""
    keys = ["time_bucket", "source", "source_id", "label"]
    wide = long.groupBy(*keys).pivot("metric_name", ["event_count", "score_sum"]).agg(
        F.sum("metric_value"))
    return wide.withColumn("avg_score", F.try_divide("score_sum", "event_count"))


def long_to_wide(long: DataFrame) -> DataFrame:
    """Older long layout to the wide one; the bucket falls back to the metric time."""
    return (long.withColumn("time_bucket", F.coalesce("time_bucket", bucket(F.col("metric_timestamp"), "hour")))
            .where(F.col("time_bucket").isNotNull())
            .groupBy("time_bucket", "source", "source_id", "label")
            .pivot("metric_name", ["event_count", "score_sum"]).agg(F.sum("metric_value"))
            .select("time_bucket", "source", "source_id", "label",
                    F.col("event_count").cast("long").alias("n"), "score_sum"))


def other_label(labels: tuple[str, ...]) -> Column:
    """Rows whose label is none of these, or missing."""
    return F.coalesce(~F.col(LABEL).isin(*labels), F.lit(True))


def overview(results: DataFrame) -> DataFrame:
    """Total, means, source count, and count and share per label; labels beside the usual three, and rows without
    one, are ``other``, so the counts add up to the total."""
    matches = {lab: F.col(LABEL) == lab for lab in LABELS}
    matches["other"] = other_label(LABELS)
    counts = {lab: F.count_if(match).alias(f"{lab}_count") for lab, match in matches.items()}
    shares = {lab: F.coalesce(F.try_divide(F.count_if(match), count_all()), F.lit(0.0))
              .alias(f"{lab}_share") for lab, match in matches.items()}
    return results.agg(
        count_all().alias("total_events"),
        F.coalesce(F.avg(SCORE), F.lit(0.0)).alias("avg_sentiment"),
        *counts.values(), *shares.values(),
        F.countDistinct("source").alias("sources"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))


def score_stats(results: DataFrame, *keys) -> DataFrame:
    """Mean, count, sample deviation and mean confidence per key."""
    return results.groupBy(*keys).agg(
        F.avg(SCORE).alias("avg_score"), count_all().alias("events"),
        F.stddev_samp(SCORE).alias("std_score"), F.avg("confidence").alias("avg_confidence"))


def hourly_series(results: DataFrame) -> DataFrame:
    return score_stats(results, bucket(F.col("occurred_at"), "hour").alias("hour"), LABEL)


def source_by_label(results: DataFrame) -> DataFrame:
    return score_stats(results, "source", LABEL)


def _per_source_and_label(results: DataFrame) -> DataFrame:
    """One row per source and label, from which statistics per source add up."""
    return results.groupBy("source", LABEL).agg(
        count_all().alias("n"), F.count(SCORE).alias("k"), F.avg(SCORE).alias("mean"), F.var_pop(SCORE).alias("var"),
        F.min(SCORE).alias("lo"), F.max(SCORE).alias("hi"))


def _combined() -> tuple[Column, Column]:
    """Mean and sample deviation of the parts of a group.

    The parts' means are compared with the group's own mean, so values that are
    large beside their deviation lose nothing.
    """
    total = F.sum("k")
    mean = F.try_divide(F.sum(F.col("k") * F.col("mean")), total)
    parts = F.sort_array(F.collect_list(F.when(F.col("k") > 0, F.struct("k", "mean", "var"))))
    squares = let(mean, lambda m: F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["k"] * (
        p["var"] + (p["mean"] - m) * (p["mean"] - m))))
    return mean, F.when(total > 1, F.sqrt(squares / (total - 1)))


def label_map_per_source(results: DataFrame, digits: int = 3) -> DataFrame:
    """Statistics per source with a sorted label-to-count map, in one pass."""
    mean, deviation = _combined()
    return _per_source_and_label(results).groupBy("source").agg(
        F.sum("n").alias("events"), F.round(mean, digits).alias("avg_score"), F.round(deviation, digits).alias("std_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(LABEL, "n")))).alias("labels"))


def source_comparison(results: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Statistics per source and its most frequent label (ties: smallest), in one pass."""
    if sources:
        results = results.where(F.col("source").isin(sources))
    mean, deviation = _combined()
    return _per_source_and_label(results).groupBy("source").agg(
        F.sum("n").alias("events"), mean.alias("avg_score"), deviation.alias("std_score"),
        F.min("lo").alias("min_score"), F.max("hi").alias("max_score"),
        F.min_by(LABEL, F.struct(-F.col("n"), F.col(LABEL))).alias("dominant_label"))


def label_summary(results: DataFrame, digits: int = 3) -> DataFrame:
    """Per label: count, mean, deviation, extremes and number of sources."""
    return results.groupBy(LABEL).agg(
        count_all().alias("events"), F.round(F.avg(SCORE), digits).alias("avg_score"),
        F.round(F.stddev_samp(SCORE), digits).alias("std_score"),
        F.round(F.min(SCORE), digits).alias("min_score"),
        F.round(F.max(SCORE), digits).alias("max_score"),
        F.countDistinct("source").alias("sources"))


def moments(results: DataFrame, value: str = SCORE, keys: list[str] | None = None) -> DataFrame:
    """Sample skewness, excess kurtosis, variance and interquartile range."""
    keys = keys or []
    found = exact_percentiles(results, keys, value, {"q1": 0.25, "q3": 0.75}, also=("count", "skewness", "kurtosis", "variance"))
    return found.select(*keys, F.col("count").alias("events"), "skewness", "kurtosis", "variance", (F.col("q3") - F.col("q1")).alias("iqr"))


def spread(results: DataFrame, *keys) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.stddev_samp(SCORE).alias("volatility"), F.min(SCORE).alias("min_score"),
        F.max(SCORE).alias("max_score"), (F.max(SCORE) - F.min(SCORE)).alias("score_range"))


def data_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        count_all().alias("rows"), F.countDistinct(F.to_date("occurred_at")).alias("days"),
        F.countDistinct("source").alias("sources"), F.avg(SCORE).alias("avg_score"))


def count_by(df: DataFrame, key: str, name: str = "events") -> DataFrame:
    return df.groupBy(key).agg(count_all().alias(name)).orderBy(F.desc(name), key)


def mean_by_source(results: DataFrame) -> DataFrame:
    """Mean score per source, ascending, with its sign."""
    out = results.groupBy("source").agg(F.avg(SCORE).alias("avg_score"))
    sign = (F.when(F.col("avg_score") > 0, F.lit("positive"))
            .when(F.col("avg_score") < 0, F.lit("negative")).otherwise(F.lit("neutral")))
    return out.withColumn("sign", sign).orderBy("avg_score", "source")


def availability(results: DataFrame, newest: int | None = 10) -> DataFrame:
    """Is there data, its date range and sources: of the newest rows, or of all with ``None``."""
    if newest is not None:
        results = results.orderBy(F.desc("occurred_at"), F.desc("id")).limit(newest)
    pairs = results.groupBy("source").agg(
        count_all().alias("n"), F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"))
    return pairs.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("has_data"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.date_format(F.min("lo"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("hi"), "yyyy-MM-dd").alias("last_day"),
        F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"))


def table_info(raw: DataFrame) -> DataFrame:
    """Rows, first and last time per source, and the share of all rows."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    per = raw.groupBy("source").agg(
        count_all().alias("rows"), F.date_format(F.min("occurred_at"), fmt).alias("earliest"),
        F.date_format(F.max("occurred_at"), fmt).alias("latest"))
    total = raw.agg(count_all().alias("n"))
    return per.withColumn("total_rows", total.scalar()).orderBy(F.desc("rows"), "source")


def source_states(raw: DataFrame) -> DataFrame:
    """Rows per source with processed and unprocessed counts; a null flag is in neither."""
    return raw.groupBy("source").agg(
        count_all().alias("event_count"), F.min("occurred_at").alias("first_event"),
        F.max("occurred_at").alias("last_event"),
        F.count_if(F.col("processed")).alias("processed_count"),
        F.count_if(~F.col("processed")).alias("unprocessed_count"))


def ingest_lag(raw: DataFrame, as_of=None, days: int = 1) -> DataFrame:
    """Ingest lag per hour: count, mean, exact 95th percentile and maximum."""
    rows = _recent(raw, as_of, days).select(
        bucket(F.col("occurred_at"), "hour").alias("hour"),
        seconds_between(F.col("ingested_at"), F.col("occurred_at")).alias("lag_seconds"))
    found = exact_percentiles(rows.where("hour IS NOT NULL"), ["hour"], "lag_seconds", {"p95_lag": 0.95}, also=("rows", "mean", "max"))
    return found.select("hour", F.col("rows").alias("event_count"), F.col("mean").alias("avg_lag"), F.col("max").alias("max_lag"), "p95_lag")


def _recent(raw: DataFrame, as_of, days: int) -> DataFrame:
    if as_of is None:
        return raw
    since = as_column(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return raw.where(F.col("occurred_at") > since)


def pretty_bytes(size: Column) -> Column:
    """A byte count as text with a unit that keeps it below five digits."""
    out = F.concat(size.cast("string"), F.lit(" bytes"))
    limit = 10 * 1024
    for power, unit in enumerate(("kB", "MB", "GB", "TB"), start=1):
        scaled = F.round(size / float(1024 ** power)).cast("long")
        out = F.when(size >= limit * 1024 ** (power - 1), F.concat(scaled.cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def payload_sizes(raw: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Payload bytes per day and source."""
    size = F.octet_length("payload")
    return (_recent(raw, as_of, days)
            .groupBy(bucket(F.col("occurred_at"), "day").alias("day"), "source")
            .agg(F.avg(size).alias("avg_bytes"), F.sum(size).alias("total_bytes"),
                 count_all().alias("event_count"))
            .withColumn("total_size", pretty_bytes(F.col("total_bytes"))))


def daily_growth(raw: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    return (_recent(raw, as_of, days).groupBy(bucket(F.col("occurred_at"), "day").alias("day"))
            .agg(count_all().alias("event_count"), F.sum(F.octet_length("payload")).alias("bytes")))


def source_total(raw: DataFrame, source: str) -> DataFrame:
    return raw.where(F.col("source") == source).agg(
        count_all().alias("total"),
        F.coalesce(F.sum(F.when(F.col("processed"), 1).otherwise(0)), F.lit(0)).alias("processed"),
        F.min("occurred_at").alias("earliest"), F.max("occurred_at").alias("latest"))


def peaks(results: DataFrame) -> DataFrame:
    """The hour of day and the weekday with most rows; ties go to the earlier one."""
    hours = results.groupBy(F.hour("occurred_at").alias("h")).agg(count_all().alias("n"))
    days = results.groupBy(F.weekday("occurred_at").alias("d"),
                           F.date_format("occurred_at", "EEEE").alias("name")).agg(count_all().alias("n"))
    hour = hours.agg(F.min_by("h", F.struct(-F.col("n"), F.col("h"))).alias("peak_hour"))
    day = days.agg(F.min_by("name", F.struct(-F.col("n"), F.col("d"))).alias("busiest_day"))
    return hour.withColumn("busiest_day", day.scalar())


def label_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement of two model versions on the same events."""
    both = a.select("event_id", F.col(LABEL).alias("label_a")).join(
        b.select("event_id", F.col(LABEL).alias("label_b")), "event_id")
    return both.groupBy("label_a", "label_b").agg(count_all().alias("events"))


def period_over_period(buckets: DataFrame, keys: list[str], time: str, value: str, size: str) -> DataFrame:
    """Each bucket next to the one exactly one period earlier (null where that one is missing)."""
    unit = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS"}[size]
    earlier = buckets.select(*keys, (F.col(time) + F.expr(unit)).alias(time), F.col(value).alias("previous"))
    return (buckets.join(earlier, [*keys, time], "left")
            .withColumn("change", F.col(value) - F.col("previous"))
            .withColumn("change_pct", F.try_divide(F.col("change") * 100.0, F.col("previous"))))


def anomalies(series: DataFrame, keys: list[str], time: str, value: str, width: int = 7,
              threshold: float = 2.0) -> DataFrame:
    """Z-score of each bucket against the ``width`` buckets before it."""
    past = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(time).rowsBetween(-width, -1)
    z = F.try_divide(F.col(value) - F.avg(value).over(past), F.stddev_samp(value).over(past))
    return (series.withColumn("z_score", F.when(F.count(value).over(past) == width, z))
            .withColumn("is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False))))


def threshold_alerts(buckets: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows of a bucket table that meet named conditions, one row per rule met."""
    hits = [F.when(F.expr(condition), F.lit(name)) for name, condition in rules]
    return buckets.withColumn("rule", F.explode(F.array_compact(F.array(*hits))))


def word_counts(df: DataFrame, words: str, top: int | None = None) -> DataFrame:
    """Word frequencies of cleaned texts, given as arrays of words."""
    # The outer form keeps the optimizer from testing the array below, which would clean each text twice.
    every = df.select(F.explode_outer(words).alias("word")).where(F.col("word").isNotNull())
    counts = every.groupBy("word").agg(count_all().alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), "word").limit(top)


def error_rate(letters: DataFrame, limit: int = 5) -> DataFrame:
    """Minutes with more dead letters than the limit."""
    return (letters.groupBy(bucket(F.col("failed_at"), "minute").alias("minute"))
            .agg(count_all().alias("errors")).where(F.col("errors") > limit))


def live_or_history(live: DataFrame, history: DataFrame, value: str = SCORE, keys: list[str] | None = None) -> DataFrame:
    """Average of the live rows, or of history where there is no live row."""
    keys = keys or []
    tagged = live.select(*keys, value, F.lit(True).alias("is_live")).unionByName(
        history.select(*keys, value, F.lit(False).alias("is_live")))
    now = F.avg(F.when(F.col("is_live"), F.col(value)))
    then = F.avg(F.when(~F.col("is_live"), F.col(value)))
    return tagged.groupBy(*keys).agg(F.coalesce(now, then).alias("blended_score"),
                                     F.count_if("is_live").alias("live_rows"))


def date_dimension(df: DataFrame, ts: str = "occurred_at") -> DataFrame:
    """One row per day between the first and the last date."""
    span = df.agg(F.to_date(F.min(ts)).alias("lo"), F.to_date(F.max(ts)).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.select("day", F.year("day").alias("year"), F.month("day").alias("month"),
                       F.weekofyear("day").alias("iso_week"), F.date_format("day", "EEEE").alias("weekday"))


def age_bins(df: DataFrame, as_of, ts: str = "occurred_at", bin_days: int = 7) -> DataFrame:
    """Rows per age bin."""
    age = seconds_between(as_column(as_of).cast("timestamp"), F.col(ts)) / 86_400
    return df.groupBy(F.floor(age / bin_days).cast("long").alias("age_bin")).agg(count_all().alias("rows"))
