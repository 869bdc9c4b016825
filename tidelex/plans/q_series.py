"""Registered queries: trends, heatmaps, windows, pages."""

from datetime import datetime

from pyspark.sql import functions as F

from tidelex.functions.ordering import with_occurrence
from tidelex.operators import paging as P
from tidelex.operators import series as S
from tidelex.plans import views as V
from tidelex.plans.q_metrics import on_results
from tidelex.plans.registry import query

TREND = """SELECT {bucket} AS time_bucket, sentiment_label, round(avg(sentiment_score), 6) AS avg_score,
  round(stddev_samp(sentiment_score), 6) AS std_score, count(*) AS events, round(min(sentiment_score), 6) AS min_score,
  round(max(sentiment_score), 6) AS max_score, round(avg(confidence), 6) AS avg_confidence {extra}
  FROM v_results GROUP BY 1, 2"""
for size in ("minute", "hour", "day", "week", "month"):
    on_results(f"tsr1_trend_{size}", TREND.format(bucket=f"date_trunc('{size}', occurred_at)", extra=""),
               lambda df, size=size: S.trend(df, size))
on_results("tsr1_trend_tuesday_week", TREND.format(
    bucket="date_trunc('week', occurred_at - INTERVAL 1 DAY) + INTERVAL 1 DAY", extra=""),
           lambda df: S.trend(df, "week", tuesday_week=True))
on_results("tsr2_band", TREND.format(bucket="date_trunc('day', occurred_at)", extra=""", 
  round(avg(sentiment_score) - coalesce(stddev_samp(sentiment_score), 0), 6) AS band_low,
  round(avg(sentiment_score) + coalesce(stddev_samp(sentiment_score), 0), 6) AS band_high"""),
           lambda df: S.with_band(S.trend(df, "day")))
on_results("tsr3_volume", "SELECT date_trunc('hour', occurred_at) AS time_bucket, count(*) AS events FROM v_results GROUP BY 1",
           lambda df: S.volume(df, "hour"))
on_results("tsr4_simple_trend", """SELECT date_trunc('hour', occurred_at) AS time_bucket, sentiment_label,
  round(avg(sentiment_score), 6) AS avg_score FROM v_results GROUP BY 1, 2""", lambda df: S.simple_trend(df, "minute"))
on_results("tsr5_source_timeline", """SELECT date_trunc('hour', occurred_at) AS time_bucket, source, count(*) AS events
  FROM v_results GROUP BY 1, 2""", lambda df: S.volume(df, "hour", "source"))

LABELS = ", ".join(f"count(*) FILTER (sentiment_label = '{lab}') AS {lab}" for lab in ("positive", "negative", "neutral")) + """,
  count(*) FILTER (sentiment_label IS NULL OR sentiment_label NOT IN ('positive', 'negative', 'neutral')) AS other"""
HEAT = {
    "pvt1_heatmap_hour": ("strftime(occurred_at, '%Y-%m-%d')", "CAST(hour(occurred_at) AS VARCHAR)", lambda df: S.heatmap(df, "hour")),
    "pvt1_heatmap_day": ("strftime(occurred_at, '%Y-W%U')", "dayname(occurred_at)", lambda df: S.heatmap(df, "day")),
    "pvt1_heatmap_week": ("strftime(occurred_at, '%Y')", "CAST(week(occurred_at) AS VARCHAR)", lambda df: S.heatmap(df, "week")),
    "pvt2_heatmap_hour": ("strftime(occurred_at, '%Y-%m-%d')", "CAST(hour(occurred_at) AS VARCHAR)", lambda df: S.compact_heatmap(df, "hour")),
    "pvt2_heatmap_day": ("CAST(week(occurred_at) AS VARCHAR)", "dayname(occurred_at)", lambda df: S.compact_heatmap(df, "day")),
    "pvt2_heatmap_week": ("CAST(month(occurred_at) AS VARCHAR)", "CAST(week(occurred_at) AS VARCHAR)", lambda df: S.compact_heatmap(df, "week")),
}
for name, (period, slot, fn) in HEAT.items():
    on_results(name, f"SELECT {period} AS period, {slot} AS slot, {LABELS} FROM v_results GROUP BY 1, 2", fn)
on_results("pvt3_source_label_counts", f"SELECT source, {LABELS} FROM v_results GROUP BY 1", lambda df: S.label_pivot(df, "source"))

HOURLY = ", h AS (SELECT date_trunc('hour', occurred_at) AS hour, avg(sentiment_score) AS v FROM v_results GROUP BY 1)"
MA = ", ".join(f"""CASE WHEN count(v) OVER w{w} = {w} THEN round(avg(v) OVER w{w}, 6) END AS ma_{w}""" for w in (3, 6, 12))
on_results("wnd1_moving_average", HOURLY + f""" SELECT hour, round(v, 6) AS avg_score, {MA} FROM h
  WINDOW w3 AS (ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),
    w6 AS (ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING),
    w12 AS (ORDER BY hour ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""", S.moving_average)
QS = ", ".join(f"CASE WHEN count(v) OVER w = 12 THEN round(quantile_cont(v, {p}) OVER w, 6) END AS q{round(p * 100)}"
               for p in (0.1, 0.25, 0.5, 0.75, 0.9))
on_results("wnd2_rolling_quantiles", HOURLY + f""" SELECT hour, round(v, 6) AS avg_score, {QS} FROM h
  WINDOW w AS (ORDER BY hour ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", S.rolling_quantiles)


@query("wnd4_occurrence_number", f"""WITH {V.V_KEYED}, n AS (SELECT *, row_number() OVER (
    PARTITION BY id ORDER BY ingested_at, source, source_id) AS occurrence FROM v_keyed)
  SELECT id, ingested_at, source, source_id, occurrence FROM n""")
def occurrence_number(spark, sf_dir):
    rows = V.keyed_rows(spark, sf_dir)
    return with_occurrence(rows, ["id"], ["ingested_at", "source", "source_id"])


PAGE = "id, occurred_at, source, source_id, round(sentiment_score, 6) AS sentiment_score, sentiment_label"
PAGE_COLS = ["id", "occurred_at", "source", "source_id", "sentiment_score", "sentiment_label"]
on_results("pag1_first_page", f"SELECT {PAGE} FROM v_results ORDER BY occurred_at DESC, id DESC LIMIT 100",
           lambda df: P.keyset_page(df).select(*PAGE_COLS))
CURSOR = (datetime(2024, 1, 20, 12), 5000)
on_results("pag1_next_page", f"""SELECT {PAGE} FROM v_results WHERE sentiment_label = 'positive' AND (occurred_at < TIMESTAMP '2024-01-20 12:00:00'
  OR (occurred_at = TIMESTAMP '2024-01-20 12:00:00' AND id < 5000)) ORDER BY occurred_at DESC, id DESC LIMIT 1000""",
           lambda df: P.keyset_page(df, 1000, P.encode_cursor(*CURSOR), label="positive").select(*PAGE_COLS))
on_results("pag2_cursor", """SELECT id, base64(encode('{"timestamp":"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') || '","id":' || id || '}')) AS cursor
  FROM v_results""", lambda df: df.select("id", P.cursor_column(F.col("occurred_at"), F.col("id")).alias("cursor")))
on_results("pag3_fetch_range", f"""SELECT {PAGE} FROM v_results WHERE occurred_at >= TIMESTAMP '2024-01-03 00:00:00'
  AND occurred_at <= TIMESTAMP '2024-01-28 00:00:00'""",
           lambda df: P.fetch_range(df.union(df), "2024-01-03 00:00:00", "2024-01-28 00:00:00").select(*PAGE_COLS))
on_results("pag4_recent_display", """SELECT strftime(occurred_at, '%Y-%m-%d %H:%M') AS time, source, source_id,
  upper(sentiment_label[1]) || sentiment_label[2:] AS sentiment, printf('%.3f', sentiment_score) AS score,
  CASE WHEN confidence IS NULL THEN 'N/A' ELSE printf('%.3f', confidence) END AS confidence, raw_text AS text_preview
  FROM v_results ORDER BY occurred_at DESC, id DESC LIMIT 50""", P.recent_for_display)
on_results("pag5_top_sources", """SELECT source, source_id, count(*) AS events FROM v_results GROUP BY 1, 2
  ORDER BY events DESC, source, source_id LIMIT 10""",
           lambda df: df.groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("events"))
           .orderBy(F.desc("events"), "source", "source_id").limit(10))
