"""Streams run on files, twice on one checkpoint."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidelex.operators.results import route_events
from tidelex.streaming import jobs as J

T0 = datetime(2024, 1, 1)


def events(spark, n, start=0):
    return spark.range(start, start + n).select(
        "id", F.lit("s").alias("source"), F.concat(F.lit("k"), "id").alias("source_id"),
        (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("occurred_at"),
        F.when(F.col("id") % 4 == 0, F.lit("{}")).otherwise(F.lit('{"text": "the good of the day is in it"}')).alias("payload"))


def test_analysis_counts_each_event_once(spark, tmp_path):
    land, out, check = (str(tmp_path / n) for n in ("land", "out", "check"))
    schema = events(spark, 1).schema
    for start in (0, 40):
        events(spark, 40, start).coalesce(1).write.mode("append").parquet(land)
        for _ in range(2):
            J.analyze(spark.readStream.schema(schema).parquet(land), out, check).awaitTermination()
    assert spark.read.parquet(f"{out}/results").count() == 60
    assert spark.read.parquet(f"{out}/dead_letters").count() == 20
    assert J.merged_metrics(spark, out).agg(F.sum("n")).collect()[0][0] == 60
    batch = route_events(events(spark, 80)).where("route = 'result'").agg(F.sum("confidence")).collect()[0][0]
    assert abs(J.merged_metrics(spark, out).agg(F.sum("score_sum")).collect()[0][0] - batch) < 1e-9


def test_windowed_metrics_equal_batch(spark, tmp_path):
    land, out, check = (str(tmp_path / n) for n in ("land", "out", "check"))
    rows = events(spark, 300).withColumn("score", F.col("id").cast("double"))
    for lo in (0, 100, 200):
        rows.where(F.col("id").between(lo, lo + 99)).coalesce(1).write.mode("append").parquet(land)
        J.hourly_metrics(spark.readStream.schema(rows.schema).parquet(land), ["source"], "score", out, check).awaitTermination()
    got = {r.time_bucket: (r.n, r.score_sum) for r in J.total_per_window(spark, out, ["source"]).collect()}
    want = {r.t: (r.n, r.s) for r in rows.groupBy(F.date_trunc("hour", "occurred_at").alias("t")).agg(
        F.count("*").alias("n"), F.sum("score").alias("s")).collect()}
    assert got == want


def test_idle_alarm_lists_quiet_groups(spark, tmp_path):
    land, out, check = (str(tmp_path / n) for n in ("land", "out", "check"))
    rows = spark.createDataFrame([("quiet", T0), ("edge", T0 + timedelta(seconds=400)), ("busy", T0 + timedelta(seconds=1000))],
                                 "g string, occurred_at timestamp")
    rows.write.parquet(land)
    J.idle_sources(spark.readStream.schema(rows.schema).parquet(land), "g", out, check).awaitTermination()
    assert {r.g: r.idle_seconds for r in spark.read.parquet(f"{out}/alarms").collect()} == {"quiet": 1000.0, "edge": 600.0}
