"""Dated tables with manifests: folds, rebuilds, retention, crashes between write and record."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelex.operators import retention as RT
from tidelex.operators import state as ST
from tidelex.sources import dated
from tidelex.sources import sinks as SK
from tidelex.streaming import fold as FO
from tidelex.streaming import jobs as J

T0 = datetime(2024, 1, 1)


def part(spark, batch, hours, n=1, root=None):
    df = spark.createDataFrame([(T0 + timedelta(hours=h), "s", n, float(h)) for h in hours], "time_bucket timestamp, source string, n long, score_sum double")
    df.write.mode("overwrite").parquet(f"{root}/batch_id={batch}")


def sums(df):
    return sorted((r.time_bucket, r.source, r.n, r.score_sum) for r in df.collect())


def everything(spark, parts):
    return sums(spark.read.parquet(parts).groupBy("time_bucket", "source").agg(F.sum("n").alias("n"), F.sum("score_sum").alias("score_sum")))


def test_fold_adds_batches_once(spark, tmp_path):
    parts, table = str(tmp_path / "parts"), str(tmp_path / "table")
    part(spark, 0, range(0, 60), root=parts)
    part(spark, 1, range(20, 30), root=parts)
    assert FO.fold(spark, parts, table)["batches"] == 2
    assert FO.fold(spark, parts, table) == {"version": 1, "batches": 0, "days": []}
    part(spark, 2, [25, 26], root=parts)
    assert sums(FO.folded(spark, parts, table)) == everything(spark, parts)
    assert FO.fold(spark, parts, table) == {"version": 2, "batches": 1, "days": ["2024-01-02"]}
    assert sums(FO.folded(spark, parts, table)) == everything(spark, parts)
    held = dated.manifest(spark, table)
    assert held.days == {"2024-01-01": 1, "2024-01-02": 2, "2024-01-03": 1} and held.note["through"] == 2
    opened = dated.read(spark, table).inputFiles()
    assert len({f.rsplit("/", 1)[0] for f in opened}) == 3


def test_crash_between_write_and_record(spark, tmp_path, monkeypatch):
    """Rows of a fold without a manifest are not read, and the next fold writes over them."""
    parts, table = str(tmp_path / "parts"), str(tmp_path / "table")
    part(spark, 0, range(30), root=parts)
    FO.fold(spark, parts, table)
    part(spark, 1, range(30), root=parts)
    with monkeypatch.context() as m:
        m.setattr(dated, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            FO.fold(spark, parts, table)
    assert dated.manifest(spark, table).version == 1
    assert sums(FO.folded(spark, parts, table)) == everything(spark, parts)
    assert FO.fold(spark, parts, table)["batches"] == 1
    assert sums(FO.folded(spark, parts, table)) == everything(spark, parts)


def test_unfinished_batch_waits(spark, tmp_path):
    parts, table = str(tmp_path / "parts"), str(tmp_path / "table")
    for b in (0, 1, 2):
        part(spark, b, range(3), root=parts)
    (tmp_path / "parts" / "batch_id=1" / "_SUCCESS").unlink()
    assert FO.fold(spark, parts, table)["batches"] == 1
    part(spark, 1, range(3), root=parts)
    assert FO.fold(spark, parts, table)["batches"] == 2
    assert sums(FO.folded(spark, parts, table)) == everything(spark, parts)


def test_rebuild_touches_changed_days_only(spark, tmp_path):
    parts, table = str(tmp_path / "parts"), str(tmp_path / "table")
    part(spark, 0, range(72), root=parts)
    FO.fold(spark, parts, table)
    changed = spark.createDataFrame([(T0 + timedelta(hours=30),)], "occurred_at timestamp")
    metric = spark.read.parquet(f"{parts}/batch_id=0").withColumn("score_sum", F.lit(-1.0))
    assert FO.rebuild(metric, table, changed) == ["2024-01-02"]
    got = sums(FO.folded(spark, parts, table))
    assert len(got) == 72 and sum(r[3] == -1.0 for r in got) == 24
    assert FO.rebuild(metric, table, changed.limit(0)) == [] and dated.manifest(spark, table).version == 2


def test_folded_batches_are_dropped_one_fold_later(spark, tmp_path):
    parts, table = str(tmp_path / "parts"), str(tmp_path / "table")
    for b in range(4):
        part(spark, b, range(10), root=parts)
        FO.fold(spark, parts, table)
    want = sums(FO.folded(spark, parts, table))
    assert FO.drop_folded(spark, parts, table) > 0
    assert dated.finished(spark, parts, "batch_id") == [3]
    assert sums(FO.folded(spark, parts, table)) == want
    part(spark, 4, range(10), root=parts)
    assert FO.fold(spark, parts, table)["batches"] == 1
    assert {r[2] for r in sums(FO.folded(spark, parts, table))} == {5}


def hot(spark, table, days=5):
    rows = spark.range(100).select("id", F.lit("s").alias("source"), (F.lit(T0) + F.make_dt_interval((F.col("id") % days).cast("int"))).alias("occurred_at"),
                                   F.concat(F.lit("payload "), "id").alias("payload")).withColumn("occurred_date", F.to_date("occurred_at"))
    dated.replace_days(rows, table, dated.days_of(rows, "occurred_date"))


def test_compaction_swaps_old_days(spark, tmp_path):
    table = str(tmp_path / "t")
    hot(spark, table)
    want = sorted(map(tuple, dated.read(spark, table).select("id", "payload").collect()))
    assert RT.compact_table(table, spark, "2024-01-05", 2) == ["2024-01-01", "2024-01-02"]
    assert RT.compact_table(table, spark, "2024-01-05", 2) == []
    assert sorted(map(tuple, dated.read(spark, table).select("id", "payload").collect())) == want
    assert len([f for f in dated.read(spark, table, days=["2024-01-01"]).inputFiles()]) == 1


def test_payloads_move_to_the_cold_table(spark, tmp_path, monkeypatch):
    table, cold = str(tmp_path / "hot"), str(tmp_path / "cold")
    hot(spark, table)
    want = sorted(map(tuple, dated.read(spark, table).select("id", "payload").collect()))
    write, calls = dated.replace_days, []

    def lost(*args, **more):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return write(*args, **more)
    with monkeypatch.context() as m:
        m.setattr(dated, "replace_days", lost)
        with pytest.raises(RuntimeError):
            RT.archive_payloads(table, cold, spark, "2024-01-05", 2)
    assert dated.read(spark, table).where("payload IS NULL").count() == 0
    assert RT.archive_payloads(table, cold, spark, "2024-01-05", 2) == ["2024-01-01", "2024-01-02"]
    assert RT.archive_payloads(table, cold, spark, "2024-01-05", 2) == []
    assert dated.read(spark, table).where("payload IS NULL").count() == dated.read(spark, cold).count() == 40
    assert sorted(map(tuple, RT.restored(spark, table, cold).select("id", "payload").collect())) == want


def test_reports_see_claims(spark, tmp_path):
    events = spark.createDataFrame([(i, T0 + timedelta(minutes=i), None if i % 4 else i % 8 == 0, None) for i in range(40)],
                                   "id long, occurred_at timestamp, processed boolean, processed_at timestamp")
    ledger, before = str(tmp_path / "ledger"), ST.backlog(events, "2024-01-02").first().backlog
    at = F.lit("2024-01-01 23:30:00")
    taken = J.claim(spark, events, ledger, 6, at).count() + J.claim(spark, events, ledger, 5, at).count()
    seen = ST.with_claims(events, J.claims(spark, ledger))
    report = ST.backlog(seen, "2024-01-02").first()
    assert (taken, report.backlog, report.processed_last_hour) == (11, before - 11, 11)
    assert seen.count() == 40 and seen.columns == events.columns


def test_alert_history(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alerts = spark.createDataFrame([("d1", "low"), ("d1", "low"), ("d2", "low")], "day string, rule string")
    assert SK.record_alerts(alerts, path, ["day", "rule"], "2024-01-03") == 2
    assert SK.record_alerts(alerts, path, ["day", "rule"], "2024-01-04") == 0
    more = alerts.unionByName(spark.createDataFrame([("d2", "busy")], "day string, rule string"))
    assert SK.record_alerts(more, path, ["day", "rule"], "2024-01-05") == 1
    assert {(r.day, r.rule, r.raised_at.day) for r in spark.read.parquet(path).collect()} == {("d1", "low", 3), ("d2", "low", 3), ("d2", "busy", 5)}


def test_stream_repeats_are_remembered(spark, tmp_path):
    """Three runs on one checkpoint: repeats inside the time do not reach the sink, rows of any age do."""
    land, check, table = (str(tmp_path / n) for n in ("land", "check", "table"))
    rows = spark.range(60).select("id", F.lit("s").alias("source"), F.concat(F.lit("k"), "id").alias("source_id"),
                                  (F.lit(T0) + F.make_dt_interval((60 - F.col("id")).cast("int"))).alias("occurred_at"))
    reached = []

    def sink(df, _):
        reached.append(df.count())
        SK.append_events(df, table)
    for ids in ("id >= 30", "id >= 20", "id < 60"):
        rows.where(ids).unionByName(rows.where(ids)).coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(rows.schema).parquet(land)
        J.start(J.without_repeats(stream, ["source", "source_id", "occurred_at"]), check, sink).awaitTermination()
    assert sum(reached) == 60 and spark.read.parquet(table).count() == 60
