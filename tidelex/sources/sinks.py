"""Writers: idempotent append, sorted file mirror, fan-out, exports, push batches.

Tables are plain Parquet, so each has one writer at a time.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelex.functions.ordering import first_per_key, numbered
from tidelex.operators.mapping import COLUMN_TYPES, PUSH_COLUMNS, csv_to_envelope, push_row, split_bad
from tidelex.schemas import EVENT_KEY, SUBMISSION_COLUMNS
from tidelex.session import CODEC, Copies, materialize
from tidelex.sources import keyfilter
from tidelex.sources.keyfilter import DATE
from tidelex.sources.readers import read_submissions

log = logging.getLogger(__name__)
PUSH_SIZE = 100
#: Dates for each range from which on all ranges are written by tasks of their own.
DATES_OF_RANGE = 4
#: Rows of a range at most, so that a task sorts its rows in memory however few partitions are set.
ROWS_OF_RANGE = 50_000
#: Row numbers or ids that are sent to all tasks at most. More are joined by a shuffle of whole rows.
FEW = 500_000


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def with_date(df: DataFrame, ts: str = "occurred_at") -> DataFrame:
    return df.withColumn("occurred_date", F.to_date(ts))


def _one_per_key(batch: DataFrame, key: list[str]) -> DataFrame:
    """(key, date, _row) of one row per key: that with the smallest hash of its other columns.

    Only keys and two numbers are grouped; the rows themselves stay where they are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in batch.schema.fields}
    rest = [c for c in batch.columns if c not in [*key, "_row", DATE] and not any(k in kinds[c] for k in ("variant", "map<"))]
    return (batch.select(*key, DATE, "_row", F.xxhash64(*rest or [F.lit(0)]).alias("_rest")).groupBy(*key)
            .agg(F.min_by("_row", "_rest").alias("_row"), F.min_by(DATE, "_rest").alias(DATE)))


def in_ranges(rows: DataFrame, order: list[str], dates: int, count: int = 0) -> DataFrame:
    """Rows in ranges of ``order`` to be written by date. Ranges are cut by rows, so a hot date is written by several tasks.

    The time of many small dates goes into making files, not into their bytes: then Spark must not join ranges
    that are small in bytes, which would leave most cores idle. Of ``count`` rows a range gets ``ROWS_OF_RANGE`` or so at most.
    """
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-count // ROWS_OF_RANGE)
    fixed = max(most, needed) if dates >= DATES_OF_RANGE * most or needed > most else None
    return rows.repartitionByRange(*([fixed] if fixed else []), *order)


def among(rows: DataFrame, key: Column, ids: DataFrame, count: int, out: bool = False) -> DataFrame:
    """Rows whose key is one of ``count`` ids (or none of them, with ``out``); null is an id like others.

    Up to ``FEW`` ids are sent to the rows, which are not shuffled then.
    """
    if not count:
        return rows if out else rows.where(F.lit(False))
    told = ids.select(F.col(ids.columns[0]).alias("_among"))
    told = F.broadcast(told) if count <= FEW else told
    keyed = rows.withColumn("_among_key", key)
    return keyed.join(told, F.col("_among_key").eqNullSafe(F.col("_among")), "left_anti" if out else "left_semi").drop("_among_key")


def _picked(batch: DataFrame, picked: DataFrame, attempted: int, chosen: int, kept: Copies) -> DataFrame:
    """The rows of a batch whose number is picked. Whole rows are shuffled only if both those picked and the others are many."""
    if chosen == attempted:
        return batch.drop("_row")
    if attempted - chosen <= min(FEW, chosen):
        others = batch.select("_row").join(picked.select("_row"), "_row", "left_anti")
        return among(batch, F.col("_row"), others, attempted - chosen, out=True).drop("_row")
    rows = among(batch, F.col("_row"), picked.select("_row"), chosen).drop("_row")
    return rows if chosen <= FEW else kept.add(rows, "picked")


def append_events(df: DataFrame, path: str, key: list[str] = EVENT_KEY) -> tuple[int, int]:
    """Insert-or-ignore on the event key. Returns (inserted, skipped).

    The input is read once and written out before it is counted. Keys alone
    decide what is new: those that the key filter of their date does not hold are,
    and only dates where it holds one are read, key columns only. The filter gets
    the new keys before the table gets their rows, so a run that is lost in between
    can be repeated. All writers of a table must use this function.
    """
    spark = df.sparkSession
    with Copies(spark) as kept:
        batch = kept.add(with_date(df).withColumn("_row", F.monotonically_increasing_id()), "batch")
        attempted = batch.count()
        if not attempted:
            return 0, 0
        fresh = kept.add(_one_per_key(batch, key), "keys")
        if table_exists(spark, path):
            stored = keyfilter.stored_keys(fresh, path, key)
            if stored is not None:
                fresh = kept.add(fresh.join(stored, key, "left_anti"), "new-keys")
        inserted, dates = fresh.agg(F.count(F.lit(1)), F.count_distinct(DATE)).first()
        if inserted:
            keyfilter.add(fresh.where(F.col(DATE).isNotNull()), path, key)
            order = [DATE, "source", "occurred_at"]
            rows = _picked(batch, fresh, attempted, inserted, kept)
            (in_ranges(rows, order, dates, inserted).sortWithinPartitions(*order).write.mode("append")
             .option("compression", CODEC).partitionBy(DATE).parquet(path))
    return inserted, attempted - inserted


def as_text() -> T.StructType:
    """The submission columns, all as text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in SUBMISSION_COLUMNS])


def import_csv(spark: SparkSession, csv_path: str, table: str, quarantine: str, source: str,
               schema=None) -> tuple[int, int, int]:
    """File rows into the event table, bad rows into quarantine. Returns (inserted, skipped, bad)."""
    # Numbers are read as text, so that one that cannot be read is quarantined and not turned into null.
    good, bad = split_bad(read_submissions(spark, csv_path, schema or as_text()))
    for name, kind in COLUMN_TYPES.items():
        good = good.withColumn(name, F.col(name).try_cast(kind))
    bad = materialize(bad)
    rejected = bad.count()
    if rejected:
        bad.write.mode("append").parquet(quarantine)
    inserted, skipped = append_events(csv_to_envelope(good.select(*SUBMISSION_COLUMNS), source), table)
    return inserted, skipped, rejected


def mirrored_rows(existing: DataFrame | None, new: DataFrame, kept: Copies) -> DataFrame:
    """Stored and new submissions, each id once (stored rows win), in time order.

    Ids alone tell which of them come more than once; the rows of the others are put in order as they are.
    """
    rows = new.withColumn("_age", F.lit(1))
    if existing is not None:
        rows = existing.withColumn("_age", F.lit(0)).unionByName(rows)
    counted = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    count, repeats = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count_if(F.col("_n") > 1)).first()
    if repeats:
        first = lambda df: first_per_key(df, ["id"], [F.col("_age"), F.col("created_utc")])
        if repeats <= FEW:
            ids = kept.add(counted.where("_n > 1").select("id"), "repeated-ids")
            rows = among(rows, F.col("id"), ids, repeats, out=True).unionByName(first(among(rows, F.col("id"), ids, repeats)))
        else:
            rows = kept.add(first(rows), "each-once")
    return in_ranges(rows.drop("_age"), ["created_utc", "id"], 0, count).sortWithinPartitions("created_utc", "id")


def latest_version(spark: SparkSession, root: str) -> int:
    """Highest finished version below ``root``, 0 if there is none."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return 0
    done = [0]
    for status in fs.listStatus(base):
        name = status.getPath().getName()
        if name.startswith("version-") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            done.append(int(name.split("-")[1]))
    return max(done)


def read_mirror(spark: SparkSession, root: str) -> DataFrame | None:
    version = latest_version(spark, root)
    return read_submissions(spark, f"{root}/version-{version}") if version else None


def append_csv(new: DataFrame, root: str) -> int:
    """Merge submissions into the sorted file mirror by writing its next version, as gzip files.

    Readers keep the finished version they opened; an unfinished one is ignored.
    """
    spark = new.sparkSession
    with Copies(spark) as kept:
        merged = mirrored_rows(read_mirror(spark, root), kept.add(new.select(*SUBMISSION_COLUMNS), "submissions"), kept)
        version = latest_version(spark, root) + 1
        (merged.withColumn("created_utc", F.col("created_utc").cast("long")).write.mode("overwrite").options(header="true", escape='"', quote='"')
         .options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).csv(f"{root}/version-{version}"))
    return version


def fan_out(batch: DataFrame, sinks: list[Callable[[DataFrame], object]]) -> object:
    """Give one stored batch to every sink. A failing sink does not stop the others; the first answer is returned."""
    stored = materialize(batch)
    answers, errors = [], []
    for sink in sinks:
        try:
            answers.append(sink(stored))
        except Exception as err:  # noqa: BLE001
            log.exception("sink failed")
            errors.append(err)
    if not answers and errors:
        raise errors[0]
    return answers[0] if answers else None


def write_partitioned(df: DataFrame, path: str, ts: str = "occurred_at") -> None:
    """Columnar sink, one folder per day."""
    with_date(df, ts).write.mode("append").partitionBy("occurred_date").parquet(path)


def missing_days(df: DataFrame, ts: str = "occurred_at") -> DataFrame:
    """Days between the first and last date that have no rows."""
    days = df.select(F.to_date(ts).alias("day")).where(F.col("day").isNotNull()).distinct()
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    spine = span.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return spine.join(days, "day", "left_anti")


def day_partitions(df: DataFrame, ts: str = "occurred_at") -> DataFrame:
    """Rows and bounds of each daily partition."""
    day = F.to_date(ts)
    return df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "next_day", F.date_add("day", 1))


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def export_rows(results: DataFrame, with_text: bool = True, digits: int = 3,
                date_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Export columns with the chosen text, date and number style."""
    if not 1 <= digits <= 6:
        raise ValueError("digits must be between 1 and 6")
    cols = ["id", F.date_format("occurred_at", date_format).alias("occurred_at"), "source", "source_id",
            F.round("sentiment_score", digits).alias("sentiment_score"), "sentiment_label",
            F.round("confidence", digits).alias("confidence")]
    return results.select(*cols, *(["raw_text"] if with_text else []))


def export(results: DataFrame, path: str, fmt: str = "csv", **style) -> None:
    rows = export_rows(results, **style)
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        writer.options(header="true", escape='"', quote='"').csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError("fmt must be csv or json")


def export_summary(results: DataFrame, digits: int = 3) -> DataFrame:
    """What stands beside an export: for every label and for all rows, count, share, mean score and time span."""
    per = results.groupBy("sentiment_label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("sentiment_score").alias("_sum"), F.count("sentiment_score").alias("_n"),
        F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
    both = per.withColumn("label", F.coalesce("sentiment_label", F.lit("none"))).unionByName(
        per.withColumn("sentiment_label", F.lit(None).cast("string")).withColumn("label", F.lit("all")))
    parts = both.groupBy("label").agg(F.sum("rows").alias("rows"), F.round(F.try_divide(F.sum("_sum"), F.sum("_n")), digits).alias("avg_score"),
                                      F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    total = per.agg(F.sum("rows").alias("rows"))
    return parts.withColumn("share", F.round(F.try_divide(F.col("rows"), total.scalar()), digits))


def export_with_summary(results: DataFrame, path: str, fmt: str = "csv", **style) -> None:
    """Rows below ``path``/rows and the summary, as JSON lines, below ``path``/summary."""
    export(results, f"{path}/rows", fmt, **style)
    export_summary(results, style.get("digits", 3)).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def record_alerts(alerts: DataFrame, path: str, keys: list[str], at: str) -> int:
    """Add alerts to the history, each once, with the time it was first raised. Returns how many are new."""
    spark = alerts.sparkSession
    new = alerts.dropDuplicates(keys)
    if table_exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    new = materialize(new.withColumn("raised_at", F.lit(at).cast("timestamp")))
    raised = new.count()
    if raised:
        new.write.mode("append").parquet(path)
    return raised


def push_batches(results: DataFrame, size: int = PUSH_SIZE) -> DataFrame:
    """Push rows in groups of ``size``, in time order, as ``{"rows": [...]}``.

    Batches are cut by a distributed row number, so a batch never holds more
    than ``size`` rows and only the last one holds fewer.
    """
    placed = numbered(results.select("id", *PUSH_COLUMNS), [], ["occurred_at", "id"], "_no").withColumn("_no", F.col("_no") - 1)
    rows = push_row(placed.drop("id")).columns
    pushed = placed.select("_no", F.struct(*[
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if c in ("occurred_at", "processed_at")
        else F.col(c) for c in rows]).alias("row"))
    groups = pushed.groupBy(F.floor(F.col("_no") / size).cast("long").alias("batch_no")).agg(
        F.count(F.lit(1)).alias("rows_in_batch"),
        F.sort_array(F.collect_list(F.struct("_no", "row"))).alias("_rows"))
    return groups.select("batch_no", "rows_in_batch", F.to_json(F.struct(
        F.transform("_rows", lambda r: r["row"]).alias("rows"))).alias("body"))
