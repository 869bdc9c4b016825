"""Exact percentiles, moments, row numbers, gaps and range joins, against plain Python."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelex.functions import ordering as O
from tidelex.functions.stats import exact_percentiles, sample_kurtosis, sample_skewness
from tidelex.operators import gaps as G
from tidelex.operators import series as S
from tidelex.operators import windows as W

T0 = datetime(2024, 1, 1)


def test_percentiles_equal_pandas_with_skew_and_signs(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([0.0, 1.5])) for _ in range(400)]
    rows += [("a", rng.gauss(0, 1e-3)) for _ in range(301)] + [("b", rng.uniform(-1e6, 1e6)) for _ in range(77)] + [("one", -2.0)]
    df = spark.createDataFrame(rows + [("a", None), (None, 1.0)], "k string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", probs).collect()}
    for key, part in pd.DataFrame(rows, columns=["k", "v"]).groupby("k"):
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(part.v, p), abs=1e-12, rel=1e-12)
    assert None not in got
    alone = exact_percentiles(df.where("k is not null"), [], "v", {"m": 0.5}).collect()[0].m
    assert alone == pytest.approx(np.median([v for _, v in rows]))


def test_sample_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 9, 4)], "v double")
    row = df.agg(sample_skewness(F.col("v")), sample_kurtosis(F.col("v"))).collect()[0]
    assert (round(row[0], 5), round(row[1], 5)) == (1.80662, 3.54914)
    few = df.limit(2).agg(sample_skewness(F.col("v")), sample_kurtosis(F.col("v"))).collect()[0]
    assert few[0] is None and few[1] is None


def test_row_index_and_occurrence(spark):
    df = spark.createDataFrame([(i % 3 if i > 200 else 7, i) for i in range(300)], "k int, i int").repartition(5)
    index = {r.i: r.row_index for r in O.with_row_index(df, [F.col("i")]).collect()}
    assert index == {i: i for i in range(300)}
    seen = {}
    for row in sorted(O.with_occurrence(df, ["k"], ["i"]).collect(), key=lambda r: r.i):
        seen[row.k] = seen.get(row.k, 0) + 1
        assert row.occurrence == seen[row.k]


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, None), (None, 1, "n")], "k int, o int, v string")
    got = {r.k: (r.o, r.v) for r in O.first_per_key(df, ["k"], [F.col("o")]).collect()}
    assert got == {1: (1, "a"), 2: (5, None), None: (1, "n")}


@pytest.mark.parametrize("keys,width", [(["k"], 600), ([], 600), (["k"], 5), ([], 3)])
def test_gaps_equal_lag(spark, keys, width):
    rng = random.Random(width)
    rows = [(rng.choice("ab"), T0 + timedelta(seconds=rng.randrange(200_000), microseconds=rng.choice([0, 1]))) for _ in range(300)]
    rows += [("a", T0 + timedelta(seconds=300_000)), ("a", T0 + timedelta(seconds=300_000 + width)), ("a", T0 + timedelta(seconds=300_000 + 2 * width, microseconds=1))]
    want = set()
    frame = pd.DataFrame(rows, columns=["k", "ts"]).sort_values("ts")
    for _, part in frame.groupby("k") if keys else [(None, frame)]:
        times = list(part.ts)
        want |= {(a.to_pydatetime(), b.to_pydatetime()) for a, b in zip(times, times[1:]) if (b - a) > timedelta(seconds=width)}
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = {(r.gap_start, r.gap_end) for r in O.time_gaps(df, keys, "ts", width).collect()}
    assert got == want


def test_exact_threshold_is_no_gap_but_is_stale(spark):
    df = spark.createDataFrame([("g", T0), ("g", T0 + timedelta(seconds=600))], "k string, occurred_at timestamp")
    assert G.group_gaps(df, "k").count() == 0
    assert G.staleness(df, str(T0 + timedelta(seconds=1200))).collect()[0].is_gap
    assert not G.staleness(df, str(T0 + timedelta(seconds=1199))).collect()[0].is_gap
    assert not G.staleness(df.limit(0), str(T0)).collect()[0].is_gap


def test_range_join_finds_each_pair_once(spark):
    rows = spark.createDataFrame([("g", T0 + timedelta(hours=h)) for h in range(0, 200, 5)], "k string, ts timestamp")
    ranges = spark.createDataFrame([("g", T0 + timedelta(hours=10), T0 + timedelta(hours=100)), ("h", T0, T0 + timedelta(hours=500))],
                                   "k string, lo timestamp, hi timestamp")
    for salts in (1, 5):
        got = sorted(r.ts for r in O.range_join(rows, ranges, ["k"], "ts", "lo", "hi", salts=salts).collect())
        assert got == [T0 + timedelta(hours=h) for h in range(10, 101, 5)]


def test_moving_windows_equal_pandas(spark):
    rng = random.Random(5)
    rows = [(T0 + timedelta(hours=h), rng.random()) for h in range(14)]
    df = spark.createDataFrame(rows, "occurred_at timestamp, sentiment_score double")
    got = S.moving_average(df).orderBy("hour").toPandas()
    values = pd.Series([v for _, v in rows])
    for w in (3, 6, 12):
        want = values.rolling(w, center=True).mean()
        pd.testing.assert_series_equal(got[f"ma_{w}"], want, check_names=False)
    q = S.rolling_quantiles(df).orderBy("hour").toPandas()
    pd.testing.assert_series_equal(q["q25"], values.rolling(12).quantile(0.25), check_names=False)


@pytest.mark.parametrize("hours,days", [(1, 1), (48, 2), (168, 7)])
def test_gap_days(spark, hours, days):
    assert spark.range(1).select(W.gap_days(F.lit(hours * 3600.0))).collect()[0][0] == days


@pytest.mark.parametrize("days,chunks", [(1, 1), (7, 7), (20, 6), (30, 10), (60, 8), (365, 20)])
def test_chunk_count(spark, days, chunks):
    end = str(T0 + timedelta(days=days))
    assert spark.range(1).select(W.chunk_count(F.lit(str(T0)), F.lit(end))).collect()[0][0] == chunks


def test_month_windows_clip_rules(spark):
    df = spark.createDataFrame([(2022, 2024)], "y0 int, y1 int")
    strict = W.month_windows(df, "y0", "y1", 5).orderBy("window_start").collect()
    loose = W.month_windows(df, "y0", "y1", 5, clip_on_reaching_end=False).orderBy("window_start").collect()
    assert len(strict) == len(loose) == 5
    assert strict[-1].window_end == datetime(2024, 1, 1) and loose[-1].window_end == datetime(2024, 2, 1)


def test_backfill_stops_after_three_empty_windows(spark):
    end = datetime(2024, 2, 1)
    rows = [("a", d) for d in (0, 1, 4, 8, 9)] + [("b", d) for d in (5,)] + [("c", d) for d in (0, 3)]
    df = spark.createDataFrame([(g, end - timedelta(days=d, hours=1)) for g, d in rows], "g string, ts timestamp")
    got = {r.g: (r.last_window, r.windows_with_rows, r.rows_collected)
           for r in W.backfill_extent(df, "g", "ts", str(end), 1).collect()}
    assert got == {"a": (7, 3, 3), "b": (2, 0, 0), "c": (6, 2, 2)}
    kept = W.backfill_rows(df, "g", "ts", str(end), 1)
    assert kept.groupBy("g").count().count() == 2 and kept.count() == 5


def test_gap_fill_takes_only_unseen_rows_inside_gaps(spark):
    known = spark.createDataFrame([("1", "g", T0), ("2", "g", T0 + timedelta(hours=5))], "id string, g string, occurred_at timestamp")
    archive = known.unionByName(spark.createDataFrame(
        [("0", "g", T0 - timedelta(hours=1)), ("3", "g", T0 + timedelta(hours=2)), ("3", "g", T0 + timedelta(hours=2)),
         ("4", "g", T0 + timedelta(hours=6)), ("5", "h", T0 + timedelta(hours=2))], known.schema))
    gaps = G.group_gaps(known, "g")
    assert [r.id for r in G.fill_from_archive(known, archive, gaps, "g").collect()] == ["3"]
    plan = G.fill_plan(gaps, "g").collect()
    assert [(r.fill_rank, r.window_days) for r in plan] == [(1, 1)]


def test_gaps_of_no_length(spark):
    """A threshold of 0 gives every pause; equal times are none."""
    df = spark.sql("SELECT 'k' AS k, timestamp_micros(t) AS ts FROM VALUES (5L), (5L), (6L), (1000000000L) AS v(t)")
    got = O.time_gaps(df, ["k"], "ts", 0).collect()
    assert sorted(r.gap_duration_seconds for r in got) == [1e-06, 999.999994]


def test_other_labels_are_counted(spark):
    from tidelex.operators import metrics as M
    from tidelex.operators import series as S
    df = spark.createDataFrame([("a", "positive", 1.0), ("a", "error", 0.0), ("a", None, 0.0), ("b", "mixed", 0.5)],
                               "source string, sentiment_label string, sentiment_score double").withColumn("confidence", F.lit(1.0))
    rows = {r.source: r.asDict() for r in S.label_pivot(df, "source").collect()}
    assert rows["a"] == {"source": "a", "positive": 1, "negative": 0, "neutral": 0, "other": 2} and rows["b"]["other"] == 1
    total = M.overview(df).first()
    assert total.other_count == 3 and abs(total.positive_share + total.other_share - 1) < 1e-12


def test_all_buckets_come_back(spark):
    """More buckets than any page holds."""
    from tidelex.operators import metrics as M
    df = spark.range(12_000).select(F.timestamp_seconds(F.col("id") * 3600).alias("occurred_at"), F.lit("s").alias("source"),
                                    F.lit("positive").alias("sentiment_label"), F.lit(0.5).alias("sentiment_score"))
    assert M.bucket_aggregate(df, "hour").count() == 12_000
    assert M.bucket_aggregate(df, "hour", limit=7).count() == 7


def test_percentiles_with_infinities(spark):
    values = [float("-inf"), -2.0, 0.0, 1.5, 2.5, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_percentiles(df, [], "v", {"low": 1 / 6, "mid": 0.5, "high": 4 / 6}).first()
    assert (got.low, got.mid, got.high) == (-2.0, 1.5, 2.5)
