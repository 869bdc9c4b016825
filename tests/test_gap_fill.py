"""The as-of interval join, the gap-fill job and deviations of large values."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidelex.functions.ordering import interval_join
from tidelex.operators import metrics as M
from tidelex.operators.search import window_search, window_sweep_with_fallback
from tidelex.session import scratch
from tidelex.sources.fill import fill_gaps
from tidelex.sources.sinks import append_events

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def cases(seed):
    rng = random.Random(seed)
    ranges = []
    for key in ("a", "b", "c", None):
        edge = rng.randrange(-50_000, 1000)
        for no in range(rng.randrange(1, 12)):
            end = edge + rng.choice([0, 1, 30, 5000, 90_000])
            ranges.append((key, edge, end, f"{key}{no}"))
            edge = end + rng.choice([0, 0, 1, 400, 60_000]) + (end == edge)
    times = [t for _, lo, hi, _ in ranges for t in (lo - 1, lo, hi, hi + 1)] + [rng.randrange(-60_000, 400_000) for _ in range(60)]
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), rng.choice([*times, None])) for i in range(500)]
    return rows, ranges


@pytest.mark.parametrize("seed,chunk", [(1, 21_600), (2, 10), (3, 10**7)])
def test_interval_join(spark, seed, chunk):
    rows, ranges = cases(seed)
    left = spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], "id long, key string, ts timestamp")
    right = spark.createDataFrame([(k, at(lo), at(hi), n) for k, lo, hi, n in ranges] + [("a", None, at(5), "x")],
                                  "key string, lo timestamp, hi timestamp, no string")
    got = interval_join(left, right, ["key"], "ts", "lo", "hi", chunk).select("id", "no").collect()
    want = [(i, n) for i, k, t in rows for key, lo, hi, n in ranges if None not in (k, t) and k == key and lo <= t <= hi]
    assert sorted(map(tuple, got)) == sorted(want)


def test_interval_join_spreads_a_hot_key(spark):
    """A range of a year stays one row, and the rows of one key are dealt out by time."""
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 900).alias("ts"), "id")
    ranges = spark.createDataFrame([("hot", at(0), at(400 * 86_400), 1)], "key string, lo timestamp, hi timestamp, no int")
    found = interval_join(rows, ranges, ["key"], "ts", "lo", "hi")
    assert found.count() == 20_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "_chunk" in plan and "sequence" not in plan.lower()


def test_no_text_is_shuffled(spark):
    posts = spark.createDataFrame([("p", "g", at(5), "a title", "body moon")], "id string, subreddit string, posted_at timestamp, title string, selftext string")
    windows = spark.createDataFrame([("g", 0, at(0), at(9 * 86_400))], "subreddit string, window_no int, window_start timestamp, window_end timestamp")
    for found in (window_search(posts, windows, ["subreddit"], ["moon"]),
                  window_sweep_with_fallback(posts.where("id = 'q'"), posts, windows, ["moon"])):
        assert found.count() == 1
        tree = found._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in tree.splitlines() if "Join" in line or "Window" in line or "Aggregate" in line]
        assert joins and not any("selftext" in line for line in joins)


def events(spark, ids, key="g"):
    return spark.createDataFrame([(i, key, f"s{i}", at(i * 100), f"text {'moon' if i % 3 == 0 else 'sun'} {i}") for i in ids],
                                 "id long, source string, source_id string, occurred_at timestamp, payload string")


def test_fill_appends_once(spark):
    """Both searches fill, rows outside the gaps and known rows stay out, the second run appends nothing."""
    path = scratch(spark, "fill")
    known = [*range(10), *range(40, 50), *range(80, 90)]
    append_events(events(spark, known), path)
    archive = events(spark, [i for i in range(120) if i % 2 == 0])
    wider = events(spark, range(120))
    first = fill_gaps(spark, path, archive, "source", ["MOON"], wider, min_gap=600).collect()
    inside = [i for i in [*range(10, 40), *range(50, 80)]]
    time_rows, term_rows = [i for i in inside if i % 2 == 0], [i for i in inside if i % 2 and i % 3 == 0]
    assert [(r.source, r.gaps, r.time_rows, r.term_rows, r.filled_gaps) for r in first] == [("g", 2, len(time_rows), len(term_rows), 2)]
    stored = sorted(r.id for r in spark.read.parquet(path).select("id").collect())
    assert stored == sorted([*known, *time_rows, *term_rows])
    again = fill_gaps(spark, path, archive, "source", ["moon"], wider, min_gap=150).collect()
    assert all(r.time_rows == r.term_rows == 0 for r in again)
    assert spark.read.parquet(path).count() == len(stored)


def test_fill_after_a_lost_run(spark):
    """Rows that a lost run had appended are known to the next one, which appends the others."""
    path = scratch(spark, "fill")
    append_events(events(spark, [0, 50]), path)
    append_events(events(spark, range(10, 20)), path)
    counts = fill_gaps(spark, path, events(spark, range(51)), "source", min_gap=600).collect()
    assert sum(r.time_rows for r in counts) == 51 - 12
    assert spark.read.parquet(path).count() == 51


def test_fill_without_gaps_or_archive(spark):
    path = scratch(spark, "fill")
    append_events(events(spark, range(10)), path)
    assert fill_gaps(spark, path, events(spark, range(10)), "source", min_gap=600).collect() == []
    counts = fill_gaps(spark, path, events(spark, []), "source", min_gap=50).collect()
    assert [(r.gaps, r.time_rows, r.filled_gaps) for r in counts] == [(9, 0, 0)]


def test_deviation_of_large_values(spark):
    """Values 1e8 and 1e8 + 1 in turn: the deviation is not lost in the square of the mean."""
    df = spark.range(1000).select(F.lit("s").alias("source"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("sentiment_label"),
                                  (1e8 + F.col("id") % 2).alias("sentiment_score"))
    want = df.agg(F.stddev_samp("sentiment_score")).first()[0]
    assert M.source_comparison(df).first().std_score == pytest.approx(want, rel=1e-6)
    assert M.label_map_per_source(df, digits=6).first().std_score == pytest.approx(want, rel=1e-5)
    none = spark.createDataFrame([("s", "a", None), ("t", "a", 1.0)], "source string, sentiment_label string, sentiment_score double")
    assert {r.source: r.std_score for r in M.source_comparison(none).collect()} == {"s": None, "t": None}
