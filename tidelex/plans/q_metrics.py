"""Registered queries: aggregates."""

from pyspark.sql import functions as F

from tidelex.operators import metrics as M
from tidelex.operators import sketches as K
from tidelex.plans import views as V
from tidelex.plans.registry import query

R = f"WITH {V.V_RESULTS} "
RAW = f"WITH {V.V_RAW} "
AS_OF = "2024-01-30 12:00:00"


def on_results(name, sql, fn):
    query(name, R + sql)(lambda s, d: fn(V.results(s, d)))


def on_raw(name, sql, fn):
    query(name, RAW + sql)(lambda s, d: fn(V.raw(s, d)))


for by, name in (("processed_at", "agg1_hourly_metric"), ("occurred_at", "agg2_hourly_metric_event_time")):
    on_results(name, f"""SELECT date_trunc('hour', {by}) AS time_bucket, source, source_id, sentiment_label AS label,
      count(*) AS n, round(sum(sentiment_score), 6) AS score_sum, round(sum(sentiment_score) / count(*), 6) AS avg_score
      FROM v_results GROUP BY 1, 2, 3, 4""", lambda df, by=by: M.with_average(M.hourly_metric(df, by)))

on_results("agg3_bucket_aggregate", """SELECT date_trunc('day', occurred_at) AS time_bucket, source,
  sentiment_label AS label, count(*) AS count, round(avg(sentiment_score), 6) AS avg_score, '' AS source_id
  FROM v_results GROUP BY 1, 2, 3""",
           lambda df: M.bucket_aggregate(df, "day"))
on_results("agg3_bucket_aggregate_filtered", """SELECT date_trunc('week', occurred_at) AS time_bucket, source,
  sentiment_label AS label, count(*) AS count, round(avg(sentiment_score), 6) AS avg_score, '' AS source_id
  FROM v_results WHERE occurred_at >= TIMESTAMP '2024-01-05 00:00:00' AND occurred_at <= TIMESTAMP '2024-01-25 00:00:00'
  AND source = 'view' GROUP BY 1, 2, 3""",
           lambda df: M.bucket_aggregate(df, "week", start="2024-01-05 00:00:00", end="2024-01-25 00:00:00", source="view"))
on_results("agg4_metric_range", """SELECT date_trunc('day', occurred_at) AS time_bucket, source, source_id,
  sentiment_label AS label, count(*) AS n, round(sum(sentiment_score), 6) AS score_sum,
  round(sum(sentiment_score) / count(*), 6) AS avg_score FROM v_results
  WHERE date_trunc('day', occurred_at) BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'
  GROUP BY 1, 2, 3, 4""", lambda df: M.metric_range(
    M.hourly_metric(df, "occurred_at"), "2024-01-10 07:00:00", "2024-01-12 01:00:00", "day"))
on_results("agg5_long_metrics_ratio", """, m AS (SELECT date_trunc('hour', occurred_at) AS time_bucket, source,
  source_id, sentiment_label AS label, count(*) AS n, sum(sentiment_score) AS s FROM v_results GROUP BY 1, 2, 3, 4),
  l AS (SELECT time_bucket, source, source_id, label, 'event_count' AS k, CAST(n AS DOUBLE) AS v FROM m
    UNION ALL SELECT time_bucket, source, source_id, label, 'score_sum', s FROM m)
  SELECT c.time_bucket, c.source, c.source_id, c.label, c.v AS event_count, round(t.v, 6) AS score_sum,
    round(t.v / c.v, 6) AS avg_score
  FROM l c JOIN l t USING (time_bucket, source, source_id, label) WHERE c.k = 'event_count' AND t.k = 'score_sum'""",
           lambda df: M.averages_from_long(M.to_long_metrics(M.hourly_metric(df, "occurred_at"))))
on_results("agg6_long_to_wide", """SELECT date_trunc('hour', occurred_at) AS time_bucket, source, source_id,
  sentiment_label AS label, count(*) AS n, round(sum(sentiment_score), 6) AS score_sum
  FROM v_results GROUP BY 1, 2, 3, 4""",
           lambda df: M.long_to_wide(M.to_long_metrics(M.hourly_metric(df, "occurred_at"))
                                     .withColumn("metric_timestamp", F.col("time_bucket"))
                                     .withColumn("time_bucket", F.lit(None).cast("timestamp"))))
on_results("agg7_overview", """SELECT count(*) AS total_events, round(avg(sentiment_score), 6) AS avg_sentiment,
  count(*) FILTER (sentiment_label = 'positive') AS positive_count,
  count(*) FILTER (sentiment_label = 'negative') AS negative_count,
  count(*) FILTER (sentiment_label = 'neutral') AS neutral_count,
  count(*) FILTER (sentiment_label IS NULL OR sentiment_label NOT IN ('positive', 'negative', 'neutral')) AS other_count,
  round(avg(CASE WHEN sentiment_label IN ('positive', 'negative', 'neutral') THEN 0 ELSE 1.0::DOUBLE END), 6) AS other_share,
  round(avg(CASE WHEN sentiment_label = 'positive' THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_share,
  round(avg(CASE WHEN sentiment_label = 'negative' THEN 1.0::DOUBLE ELSE 0 END), 6) AS negative_share,
  round(avg(CASE WHEN sentiment_label = 'neutral' THEN 1.0::DOUBLE ELSE 0 END), 6) AS neutral_share,
  count(DISTINCT source) AS sources, round(avg(confidence), 6) AS avg_confidence FROM v_results""", M.overview)

STATS = """round(avg(sentiment_score), 6) AS avg_score, count(*) AS events,
  round(stddev_samp(sentiment_score), 6) AS std_score, round(avg(confidence), 6) AS avg_confidence"""
on_results("agg8_hourly_series", f"""SELECT date_trunc('hour', occurred_at) AS hour, sentiment_label, {STATS}
  FROM v_results GROUP BY 1, 2""", M.hourly_series)
on_results("agg9_source_by_label", f"SELECT source, sentiment_label, {STATS} FROM v_results GROUP BY 1, 2", M.source_by_label)
on_results("agg10_label_map", """, c AS (SELECT source, sentiment_label, count(*) AS n FROM v_results GROUP BY 1, 2)
  SELECT s.*, l.labels FROM (SELECT source, count(*) AS events, round(avg(sentiment_score), 3) AS avg_score,
    round(stddev_samp(sentiment_score), 3) AS std_score FROM v_results GROUP BY 1) s
  JOIN (SELECT source, string_agg(sentiment_label || '=' || n, ',' ORDER BY sentiment_label) AS labels FROM c GROUP BY 1) l
  USING (source)""", lambda df: M.label_map_per_source(df).withColumn("labels", F.array_join(F.transform(
    F.sort_array(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")))
on_results("agg11_source_comparison", """, c AS (SELECT source, sentiment_label, row_number() OVER (
    PARTITION BY source ORDER BY count(*) DESC, sentiment_label) AS rn FROM v_results GROUP BY 1, 2)
  SELECT s.*, c.sentiment_label AS dominant_label FROM (SELECT source, count(*) AS events,
    round(avg(sentiment_score), 6) AS avg_score, round(stddev_samp(sentiment_score), 6) AS std_score,
    round(min(sentiment_score), 6) AS min_score, round(max(sentiment_score), 6) AS max_score
    FROM v_results GROUP BY 1) s JOIN c ON c.source = s.source AND c.rn = 1""", M.source_comparison)
on_results("agg12_label_summary", """SELECT sentiment_label, count(*) AS events, round(avg(sentiment_score), 3) AS avg_score,
  round(stddev_samp(sentiment_score), 3) AS std_score, round(min(sentiment_score), 3) AS min_score,
  round(max(sentiment_score), 3) AS max_score, count(DISTINCT source) AS sources FROM v_results GROUP BY 1""", M.label_summary)
MOMENTS = """count(sentiment_score) AS events, round(skewness(sentiment_score), 6) AS skewness,
  round(kurtosis(sentiment_score), 6) AS kurtosis, round(var_samp(sentiment_score), 6) AS variance,
  round(quantile_cont(sentiment_score, 0.75) - quantile_cont(sentiment_score, 0.25), 6) AS iqr"""
on_results("agg13_moments", f"SELECT {MOMENTS} FROM v_results", M.moments)
on_results("agg13_moments_by_source", f"SELECT source, {MOMENTS} FROM v_results GROUP BY 1",
           lambda df: M.moments(df, keys=["source"]))
on_results("agg14_spread", """SELECT source, round(stddev_samp(sentiment_score), 6) AS volatility,
  round(min(sentiment_score), 6) AS min_score, round(max(sentiment_score), 6) AS max_score,
  round(max(sentiment_score) - min(sentiment_score), 6) AS score_range FROM v_results GROUP BY 1""",
           lambda df: M.spread(df, "source"))
on_results("agg15_data_summary", """SELECT count(*) AS rows, count(DISTINCT CAST(occurred_at AS DATE)) AS days,
  count(DISTINCT source) AS sources, round(avg(sentiment_score), 6) AS avg_score FROM v_results""", M.data_summary)
on_results("agg16_label_counts", "SELECT sentiment_label, count(*) AS events FROM v_results GROUP BY 1",
           lambda df: M.count_by(df, "sentiment_label"))
on_results("agg17_mean_by_source", """SELECT source, round(avg(sentiment_score), 6) AS avg_score,
  CASE WHEN avg(sentiment_score) > 0 THEN 'positive' WHEN avg(sentiment_score) < 0 THEN 'negative' ELSE 'neutral' END AS sign
  FROM v_results GROUP BY 1""", M.mean_by_source)
on_results("agg18_rows_by_source", "SELECT source, count(*) AS events FROM v_results GROUP BY 1",
           lambda df: M.count_by(df, "source"))
AVAIL = """count(*) > 0 AS has_data, count(*) AS total_events, strftime(min(occurred_at), '%Y-%m-%d') AS first_day,
  strftime(max(occurred_at), '%Y-%m-%d') AS last_day, string_agg(DISTINCT source, ',' ORDER BY source) AS sources"""
on_results("agg19_availability_newest", f"""SELECT {AVAIL} FROM (SELECT * FROM v_results
  ORDER BY occurred_at DESC, id DESC LIMIT 10)""", M.availability)
on_results("agg19_availability_all", f"SELECT {AVAIL} FROM v_results", lambda df: M.availability(df, None))
on_raw("agg20_table_info", """SELECT source, count(*) AS rows, strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS earliest,
  strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS latest, (SELECT count(*) FROM v_raw) AS total_rows
  FROM v_raw GROUP BY 1""", M.table_info)
on_raw("agg21_source_states", """SELECT source, count(*) AS event_count, min(occurred_at) AS first_event,
  max(occurred_at) AS last_event, count(*) FILTER (processed) AS processed_count,
  count(*) FILTER (NOT processed) AS unprocessed_count FROM v_raw GROUP BY 1""", M.source_states)
LAG = """SELECT date_trunc('hour', occurred_at) AS hour, count(*) AS event_count, round(avg(lag), 6) AS avg_lag,
  round(max(lag), 6) AS max_lag, round(quantile_cont(lag, 0.95), 6) AS p95_lag
  FROM (SELECT *, (epoch_us(ingested_at) - epoch_us(occurred_at)) / 1e6 AS lag FROM v_raw) {where} GROUP BY 1"""
on_raw("agg22_ingest_lag", LAG.format(where=""), M.ingest_lag)
on_raw("agg22_ingest_lag_last_day", LAG.format(
    where=f"WHERE occurred_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY"), lambda df: M.ingest_lag(df, AS_OF))
on_raw("agg23_payload_sizes", """SELECT date_trunc('day', occurred_at) AS day, source,
  round(avg(octet_length(encode(payload))), 6) AS avg_bytes, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS total_bytes,
  count(*) AS event_count, CASE WHEN sum(octet_length(encode(payload))) < 10240
    THEN CAST(sum(octet_length(encode(payload))) AS VARCHAR) || ' bytes'
    ELSE CAST(CAST(round(sum(octet_length(encode(payload))) / 1024) AS BIGINT) AS VARCHAR) || ' kB' END AS total_size
  FROM v_raw GROUP BY 1, 2""", M.payload_sizes)
on_raw("agg24_daily_growth", f"""SELECT date_trunc('day', occurred_at) AS day, count(*) AS event_count,
  CAST(sum(octet_length(encode(payload))) AS BIGINT) AS bytes FROM v_raw
  WHERE occurred_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1""", lambda df: M.daily_growth(df, AS_OF))
on_raw("agg25_source_total", """SELECT count(*) AS total, CAST(sum(CASE WHEN processed THEN 1 ELSE 0 END) AS BIGINT) AS processed,
  min(occurred_at) AS earliest, max(occurred_at) AS latest FROM v_raw WHERE source = 'click'""",
       lambda df: M.source_total(df, "click"))
on_results("agg26_peaks", """SELECT (SELECT hour(occurred_at) FROM v_results GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour,
  (SELECT dayname(occurred_at) FROM v_results GROUP BY isodow(occurred_at), 1 ORDER BY count(*) DESC, isodow(occurred_at) LIMIT 1) AS busiest_day""",
           M.peaks)
on_results("agg27_extended_metric", """SELECT date_trunc('day', occurred_at) AS time_bucket, source, sentiment_label AS label,
  count(*) AS count, round(avg(sentiment_score), 6) AS avg_score, round(min(sentiment_score), 6) AS min_score,
  round(max(sentiment_score), 6) AS max_score, round(stddev_samp(sentiment_score), 6) AS std_score, '' AS source_id
  FROM v_results GROUP BY 1, 2, 3""",
           lambda df: M.bucket_aggregate(df, "day", extended=True))

PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
SKETCHED = """SELECT date_trunc('{size}', occurred_at) AS time_bucket, source, count(*) AS n, round(sum({v}), 6) AS value_sum,
  round(min({v}), 6) AS value_min, round(max({v}), 6) AS value_max, CASE WHEN count({v}) > 0 THEN true END AS within_rank_error
  FROM {table} GROUP BY 1, 2"""
for size in ("hour", "day", "week"):
    on_raw(f"agg22_lag_sketch_{size}", SKETCHED.format(size=size, v="lag", table="""(SELECT *,
      (epoch_us(ingested_at) - epoch_us(occurred_at)) / 1e6 AS lag FROM v_raw)"""),
           lambda df, size=size: K.audited(K.with_lag(df), "lag_seconds", size, PROBS))
for size in ("day", "week"):
    on_results(f"doc13_score_sketch_{size}", SKETCHED.format(size=size, v="sentiment_score", table="v_results"),
               lambda df, size=size: K.audited(df, M.SCORE, size, PROBS))
