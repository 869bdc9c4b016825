"""Key filters of the event table."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelex.sources import keyfilter as K
from tidelex.sources import sinks as SK

KEY = ["source", "source_id", "occurred_at"]


def batch(spark, ids, day=0, payload="p"):
    at = datetime(2024, 1, 1, 5) + timedelta(days=day)
    return spark.createDataFrame([(i, "s", f"k{i}", at, payload) for i in ids],
                                 "id long, source string, source_id string, occurred_at timestamp, payload string")


def spoil(table, day):
    """Make a date's rows unreadable."""
    for file in Path(table, f"occurred_date=2024-01-{day + 1:02d}").glob("*.parquet"):
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(b"not parquet")


def test_new_keys_read_no_history(spark, tmp_path):
    """Rows of both dates cannot be read; new keys are appended, a known key needs its own date only."""
    table = str(tmp_path / "t")
    SK.append_events(batch(spark, range(200)), table)
    SK.append_events(batch(spark, range(200), 1), table)
    spoil(table, 0)
    assert SK.append_events(batch(spark, range(200, 300)).unionByName(batch(spark, range(200, 220), 1)), table) == (120, 0)
    assert SK.append_events(batch(spark, range(190, 230), 1), table) == (10, 30)
    with pytest.raises(Exception, match="(?i)parquet"):
        SK.append_events(batch(spark, [5]), table)


@pytest.mark.parametrize("bits", [64, 4096])
def test_wrong_hits_are_settled(spark, tmp_path, monkeypatch, bits):
    """With a full filter every key is a suspect, and the result is the same."""
    monkeypatch.setattr(K, "BITS", bits)
    monkeypatch.setattr(K.add, "__defaults__", (bits,))
    table = str(tmp_path / "t")
    assert SK.append_events(batch(spark, range(300)), table) == (300, 0)
    assert SK.append_events(batch(spark, range(250, 400)), table) == (100, 50)
    assert K.bits_of(spark, table) == bits
    ids = sorted(r.id for r in spark.read.parquet(table).select("id").collect())
    assert ids == list(range(400))


def test_filter_knows_every_key(spark, tmp_path):
    table = str(tmp_path / "t")
    SK.append_events(batch(spark, range(1000)), table)
    day = datetime(2024, 1, 1).date()
    stored = spark.read.parquet(table).select("occurred_date", *KEY)
    assert K.maybe_stored(stored, table, KEY, [day]).count() == 1000
    others = SK.with_date(batch(spark, range(1000, 3000))).select("occurred_date", *KEY)
    assert K.maybe_stored(others, table, KEY, [day]).count() < 20


def test_lost_between_filter_and_rows(spark, tmp_path):
    """The filter holds keys whose rows were never written; they are appended by the next run."""
    table = str(tmp_path / "t")
    SK.append_events(batch(spark, range(10)), table)
    K.add(SK.with_date(batch(spark, range(10, 20))), table, KEY)
    assert SK.append_events(batch(spark, range(20)), table) == (10, 10)
    assert spark.read.parquet(table).count() == 20


def test_dates_written_without_a_filter(spark, tmp_path):
    """They are compared whole once and have a filter from then on."""
    table = str(tmp_path / "t")
    SK.with_date(batch(spark, range(50))).write.partitionBy("occurred_date").parquet(table)
    assert SK.append_events(batch(spark, range(40, 60)), table) == (10, 10)
    spoil(table, 0)
    assert SK.append_events(batch(spark, range(60, 70)), table) == (10, 0)


def test_one_row_per_key_whatever_the_order(spark, tmp_path):
    rows = batch(spark, range(30), payload="a").unionByName(batch(spark, range(30), payload="b")).unionByName(batch(spark, range(30), payload="a"))
    kept = []
    for i, n in enumerate((1, 7)):
        table = str(tmp_path / f"t{i}")
        assert SK.append_events(rows.repartition(n, F.rand(i)), table) == (30, 60)
        kept.append(sorted((r.id, r.payload) for r in spark.read.parquet(table).select("id", "payload").collect()))
    assert kept[0] == kept[1]


def test_input_is_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = batch(spark, range(100))
    assert SK.append_events(df.mapInArrow(count, df.schema), str(tmp_path / "t")) == (100, 0)
    assert seen.value == 100


def test_empty_batch(spark, tmp_path):
    table = str(tmp_path / "t")
    assert SK.append_events(batch(spark, []), table) == (0, 0)
    assert not SK.table_exists(spark, table)


def many_days(spark, days, per_day=2):
    at = F.expr("timestamp'2024-01-01 05:00:00'") + F.make_dt_interval(F.expr(f"cast(id div {per_day} as int)"))
    return spark.range(days * per_day).select("id", F.lit("s").alias("source"), F.concat(F.lit("k"), "id").alias("source_id"),
                                              at.alias("occurred_at"), F.lit("p").alias("payload"))


def test_days_of_a_month_share_filter_files(spark, tmp_path):
    """120 small days have filter files for four months and the tasks that wrote them, and hold every key."""
    table = str(tmp_path / "t")
    rows = many_days(spark, 120)
    assert SK.append_events(rows.where("id % 2 = 0"), table) == (120, 0)
    assert len(list(Path(table, "_key_filter").rglob("*.parquet"))) <= 4 + 4
    assert len(K.stored_dates(spark, table)) == 120
    assert SK.append_events(rows, table) == (120, 120)
    assert SK.append_events(rows, table) == (0, 240)
    assert spark.read.parquet(table).select("id").distinct().count() == 240


def test_many_small_days_are_written_by_all_tasks(spark):
    rows = SK.with_date(many_days(spark, 120)).localCheckpoint()
    assert SK.in_ranges(rows, ["occurred_date", "occurred_at"], 120).rdd.getNumPartitions() == 4
    assert SK.in_ranges(rows, ["occurred_date", "occurred_at"], 1).rdd.getNumPartitions() == 1
