"""One key holds a third of the rows; results stay whole and no task gets the key's rows."""

from pyspark.sql import functions as F

from tidelex.functions import ordering as O
from tidelex.operators import gaps as G
from tidelex.operators import reconcile as RC
from tidelex.sources import sinks as SK

N = 30_000


def hot(spark):
    return spark.range(N).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        F.timestamp_seconds(F.col("id") * 7).alias("ts"))


def test_row_numbers_are_balanced_and_whole(spark):
    df = hot(spark)
    ranged = df.repartitionByRange(4, "k", "id").withColumn("p", F.spark_partition_id())
    assert max(r["count"] for r in ranged.groupBy("p").count().collect()) < N * 0.4
    numbered = O.with_occurrence(df, ["k"], ["id"])
    top = numbered.where("k = 'hot'").agg(F.max("occurrence"), F.count("*")).collect()[0]
    assert tuple(top) == (N // 3, N // 3)


def test_gaps_of_a_hot_key(spark):
    gaps = G.group_gaps(hot(spark), "k", "ts", min_gap=60)
    assert gaps.where("k = 'hot'").count() == 0
    assert gaps.where("k <> 'hot'").count() > 0
    bins = O.time_gaps(hot(spark), ["k"], "ts", 3600)._jdf.queryExecution().optimizedPlan().toString()
    window, aggregate = bins.index("Window"), bins.index("Aggregate")
    assert window < aggregate, "rows must be aggregated below the window"


def test_copies_are_reduced_before_they_are_compared(spark, tmp_path):
    copies = hot(spark).select(F.lit("s").alias("source"), F.col("k").alias("source_id"),
                               F.lit("2024-01-01").cast("timestamp").alias("occurred_at"), F.lit("{}").alias("payload"))
    table = str(tmp_path / "t")
    keys = copies.select("source_id").distinct().count()
    assert SK.append_events(copies, table) == (keys, N - keys)
    assert SK.append_events(copies, table) == (0, N)
    ids = RC.presence(copies.withColumnRenamed("source_id", "id"), copies, prefix="")
    row = RC.difference(ids).collect()[0]
    assert (row.total_a, row.total_b, row.in_both) == (N, N, keys)


def test_numbering_checkpoints_keys_and_order_only(spark, monkeypatch):
    held = []
    kept = O.materialize
    monkeypatch.setattr(O, "materialize", lambda df: held.append(df) or kept(df))
    wide = hot(spark).withColumn("payload", F.concat(F.lit("x"), F.col("id"))).withColumn("none", F.lit(None).cast("string"))
    numbered = O.numbered(wide, ["none", "k"], ["ts", "id"], "no", 4)
    by_key = {}
    for r in sorted(numbered.collect(), key=lambda r: r.id):
        by_key[r.k] = by_key.get(r.k, 0) + 1
        assert r.no == by_key[r.k] and r.payload == f"x{r.id}" and r.none is None
    assert sum(by_key.values()) == N and numbered.columns == [*wide.columns, "no"]
    assert [f.name for f in held[0].schema["_at"].dataType.fields] == ["none", "k", "ts", "id"]
    assert set(held[0].columns) == {"_at", "_rows", "_part"}
    sizes = [r["count"] for r in held[0].groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < N * 0.4


def test_tied_and_repeated_rows_get_a_number_each(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), (None, 1, "q"), (None, 1, "q")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = O.numbered(df, ["k"], ["o"], "no").collect()
    assert sorted(r.no for r in got if r.k == "a") == [1, 2, 3, 4] and sorted(r.no for r in got if r.k is None) == [1, 2]
    assert [r.no for r in got if r.v == "z"] == [1]
    assert sorted(r.no for r in O.numbered(df, [], ["k", "o"], "no").collect()) == [1, 2, 3, 4, 5, 6]
    assert O.numbered(df.limit(0), ["k"], ["o"], "no").count() == 0
