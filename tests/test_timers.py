"""Idle alarms by timers, against the alarms that read all stored times."""

from datetime import datetime, timedelta

from tidelex.streaming import jobs as J
from tidelex.streaming import timers as TM

T0 = datetime(2024, 1, 1)


class Land:
    def __init__(self, spark, folder, **more):
        self.spark, self.more, self.n = spark, more, 0
        self.land, self.out, self.check = (str(folder / n) for n in ("land", "out", "check"))

    def add(self, *rows):
        df = self.spark.createDataFrame([(g, T0 + timedelta(seconds=s)) for g, s in rows], "g string, occurred_at timestamp")
        df.coalesce(1).write.mode("append").parquet(self.land)

    def run(self):
        """One run over what has landed; keys in the state after it."""
        events = self.spark.readStream.schema("g string, occurred_at timestamp").parquet(self.land)
        query = TM.watch(TM.idle_alarms(events, "g", **self.more), self.out, self.check)
        query.awaitTermination()
        return self.alarms()

    def alarms(self):
        return sorted((r.g, (r.gap_start - T0).total_seconds(), r.idle_seconds) for r in self.spark.read.parquet(self.out).collect())


def test_alarms_of_three_batches_a_repeat_and_silence(spark, tmp_path):
    """The same stops as ``raise_idle_alarms`` finds, each once."""
    land = Land(spark, tmp_path)
    other = str(tmp_path / "plain")
    batches = [[("quiet", 0), ("edge", 400), ("busy", 1000)], [("busy", 2000), ("quiet", 1500)], [("edge", 2050), ("busy", 2100), ("quiet", 1400)]]
    schema = "g string, occurred_at timestamp"
    for rows in batches:
        land.add(*rows)
        land.run()
        J.idle_sources(spark.readStream.schema(schema).parquet(land.land), "g", other, str(tmp_path / "plain_check")).awaitTermination()
    plain = sorted((r.g, (r.gap_start - T0).total_seconds(), r.idle_seconds) for r in spark.read.parquet(f"{other}/alarms").collect())
    assert land.alarms() == plain == [("edge", 400.0, 600.0), ("quiet", 0.0, 1000.0), ("quiet", 1500.0, 600.0)]
    assert land.run() == plain
    # The clock alone goes on: every group alarms for its last stop, once.
    land.add((None, 9000))
    want = plain + [("busy", 2100.0, 6900.0), ("edge", 2050.0, 6950.0)]
    assert land.run() == sorted(want)
    land.add((None, 9900))
    assert land.run() == sorted(want)


def test_state_is_forgotten(spark, tmp_path):
    """Groups that went for good leave no state, and one that comes back alarms again."""
    land = Land(spark, tmp_path, forget_seconds=5000)
    land.add(*[(f"g{i}", i) for i in range(30)], (None, 2000))
    assert len(land.run()) == 30
    for at in (9000, 9001, 9002):
        land.add(("g1", at) if at == 9001 else (None, at))
        assert len(land.run()) == 30
    land.add((None, 9700))
    assert [a for a in land.run() if a[1] > 100] == [("g1", 9001.0, 699.0)]
    before = spark.conf.get(TM.PROVIDER)
    spark.conf.set(TM.PROVIDER, TM.ROCKS)
    held = spark.read.format("statestore").option("path", land.check).option("stateVarName", "newest").load().collect()
    spark.conf.set(TM.PROVIDER, before)
    assert [r.key[0] for r in held] == ["g1"]


def test_disorder_within_the_limit_counts(spark, tmp_path):
    land = Land(spark, tmp_path, late="10 minutes")
    land.add(("a", 0), ("b", 1100))
    assert land.run() == []
    land.add(("a", 700), ("b", 1900))
    assert land.run() == [("a", 700.0, 600.0)] or land.run() == [("a", 700.0, 600.0)]
