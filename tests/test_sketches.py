"""Quantile sketches that roll up, against exact ranks on skewed values."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelex.operators import sketches as K

PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    made = []
    for i in range(60_000):
        # A third in one hour of one source; a heavy tail with many equal values.
        hot = i % 3 == 0
        value = 2.0 if rng.random() < 0.3 else math.exp(rng.gauss(0, 3))
        made.append((start if hot else start + timedelta(minutes=rng.randrange(14 * 1440)), "a" if hot or i % 2 else "b", value))
    made += [(start, "nulls", None), (start, "nulls", float("nan")), (start, "one", -7.5), (None, "a", 1.0), (start, None, 3.0)]
    return spark.createDataFrame(made, "occurred_at timestamp, source string, v double").repartition(6).cache()


@pytest.mark.parametrize("size", ["hour", "day", "week"])
def test_rolled_up_ranks_keep_the_bound(rows, size):
    found = K.sketch_percentiles(K.rolled(rows, "v", size), PROBS).cache()
    worst = K.rank_errors(rows, found, "occurred_at", ["source"], "v", size, PROBS).agg(
        *[F.max(f"{p}_error") for p in PROBS]).first()
    assert max(worst) <= K.RANK_ERROR
    direct = rows.groupBy(F.date_trunc(size, "occurred_at").alias("t"), "source").agg(F.count("*").alias("c"), F.max("v").alias("m")).collect()
    assert {(r.time_bucket, r.source): r.n for r in found.collect()} == {(r.t, r.source): r.c for r in direct}


def test_few_values_are_exact_and_none_are_null(rows):
    found = {r.source: r for r in K.sketch_percentiles(K.rolled(rows, "v", "day"), PROBS).where("time_bucket = '2024-01-01'").collect()}
    assert (found["one"].p50, found["one"].p99, found["one"].value_mean) == (-7.5, -7.5, -7.5)
    assert (found["nulls"].n, found["nulls"].n_values, found["nulls"].p50, found["nulls"].value_mean) == (2, 0, None, None)
    assert found[None].p95 == 3.0


def test_an_audit_sees_a_wrong_percentile(rows):
    wrong = K.sketch_percentiles(K.rolled(rows, "v", "week"), PROBS).withColumn("p50", F.col("p99"))
    errors = K.rank_errors(rows, wrong, "occurred_at", ["source"], "v", "week", PROBS).where("source = 'a' AND time_bucket IS NOT NULL")
    assert errors.agg(F.min("p50_error")).first()[0] > 0.4


def test_batches_add_up_and_rows_are_read_once(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    halves = [K.sketch_metric(stored.where(F.xxhash64("v") % 2 == i), "occurred_at", ["source"], "v") for i in (0, 1)]
    both = K.sketch_percentiles(K.roll_up_sketches(*halves, size="week"), PROBS)
    assert K.rank_errors(rows, both, "occurred_at", ["source"], "v", "week", PROBS).agg(F.max("p95_error")).first()[0] <= K.RANK_ERROR
    plan = K.sketch_percentiles(K.rolled(stored, "v", "week"), PROBS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_a_sketch_does_not_grow_with_its_rows(spark):
    def size(n):
        made = spark.range(n, numPartitions=4).select(F.lit("2024-01-01").cast("timestamp").alias("t"), F.rand(1).alias("v"))
        return K.sketch_metric(made, "t", [], "v").select(F.length("sketch")).first()[0]
    assert size(400_000) < 2 * size(20_000) < 80_000


def test_no_rows(rows):
    assert K.sketch_percentiles(K.rolled(rows.limit(0), "v", "week"), PROBS).count() == 0
