"""Two-store reconciliation as a job: a file mirror (a) and an event table (b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.operators.mapping import strip_key_prefix
from tidelex.operators.reconcile import (
    difference, fields_held, fields_lacking, fillable_ids, merge_conflicts, missing_in_a, missing_in_b, presence, report)
from tidelex.session import CODEC, Copies, materialize
from tidelex.sources import sinks
from tidelex.sources.keyfilter import DATE
from tidelex.sources.sinks import among, append_csv, append_events, in_ranges, read_mirror

#: Parts of a table that are written again one after the other, from so many rows on.
SLICES, ROWS_OF_SLICE = 4, 5_000


def _slices(events: DataFrame, dates: DataFrame) -> list[tuple]:
    """(first date, last date, rows, dates) of up to ``SLICES`` runs of dates with about as many rows each.

    The driver gets a number for each date.
    """
    counts = sorted((r[0], r[1]) for r in events.join(F.broadcast(dates), DATE).groupBy(DATE).count().collect())
    total, before, runs = sum(n for _, n in counts), 0, {}
    slices = max(1, min(SLICES, total // ROWS_OF_SLICE))
    for day, n in counts:
        lo, _, rows, days = runs.get(before * slices // total, (day, day, 0, 0))
        runs[before * slices // total] = (lo, day, rows + n, days + 1)
        before += n
    return list(runs.values())


def write_back(merged: DataFrame, table: str, prefix: str = "", events: DataFrame | None = None) -> int:
    """Replace payloads in the event table; only the dates that hold a changed row are written again.

    ``merged`` has id, source, occurred_at and payload, each event once. ``events`` are the table's rows where
    they lie elsewhere too; by default they are read and stored first, for they cannot be read while they are replaced.
    Dates are replaced in a few slices, so that shuffled and new files of a slice only lie beside the table. A run that is
    lost in between leaves slices to be done, and a second one does them.
    """
    spark = merged.sparkSession
    key = ["_id", "source", "occurred_at"]
    with Copies(spark) as kept:
        changes = kept.add(merged.select(F.col("id").alias("_id"), "source", "occurred_at", F.col("payload").alias("_new")), "changes")
        count = changes.count()
        if not count:
            return 0
        dates = kept.add(changes.select(F.to_date("occurred_at").alias(DATE)).where(F.col(DATE).isNotNull()).distinct(), "dates")
        if events is None:
            events = kept.add(spark.read.parquet(table).join(F.broadcast(dates), DATE, "left_semi"), "touched")
        for lo, hi, rows, days in _slices(events, dates):
            of_slice = F.col(DATE).between(F.lit(lo), F.lit(hi))
            touched = (events.where(of_slice).join(F.broadcast(dates.where(of_slice)), DATE, "left_semi")
                       .withColumn("_id", strip_key_prefix(F.col("source_id"), prefix)))
            new = changes.where(F.to_date("occurred_at").between(F.lit(lo), F.lit(hi)) & F.col("_new").isNotNull())
            if count <= sinks.FEW:
                # Only rows that get another payload meet it; the others stay where they are.
                keys = F.broadcast(new.select(*key))
                changed = touched.drop("payload").join(new.withColumnRenamed("_new", "payload"), key)
                done = touched.join(keys, key, "left_anti").unionByName(changed)
            else:
                done = kept.add(touched.join(new, key, "left").withColumn("payload", F.coalesce("_new", "payload")).drop("_new"), "changed")
            (in_ranges(done.select(*events.columns), [DATE, "source", "occurred_at"], days, rows).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").option("compression", CODEC).partitionBy(DATE).parquet(table))
            kept.drop(done)
    return count


def reconcile(spark: SparkSession, mirror: str, table: str, source: str, prefix: str = "", dry_run: bool = False) -> DataFrame:
    """Bring both stores to the same content and report what was done, in one row.

    The differences are found and written out before anything changes: posts that
    b lacks are appended to it, events that a lacks make its next version, and empty
    fields of b are filled from a. A second run finds nothing to do. The event table, which may have a small file
    for each day, is read once; every step takes it from a copy. Ids and a few bits of a row tell which rows a step
    needs, so that of whole rows only these move, and copies go when the last step that needs them is done.
    """
    a, b = read_mirror(spark, mirror), spark.read.parquet(table)
    if dry_run:
        return report(materialize(presence(a, b, prefix=prefix)))
    with Copies(spark) as kept:
        b = kept.add(b, "events-copy")
        held, lacking = kept.add(fields_held(a), "fields-a"), kept.add(fields_lacking(b, prefix), "fields-b")
        ids = materialize(presence(held, lacking, key_b="id"))
        fill = kept.add(fillable_ids(held, lacking), "ids-to-fill")
        kept.drop(held, lacking)
        told, fills = difference(ids).first(), fill.count()
        only_a, only_b = ids.where("rows_b = 0").select("id"), ids.where("rows_a = 0").select("id")
        id_a, id_b = F.col("id"), strip_key_prefix(F.col("source_id"), prefix)
        a = kept.add(among(a, id_a, only_a.union(fill), told.a_only + fills), "rows-of-a")
        to_b = kept.add(missing_in_b(among(a, id_a, only_a, told.a_only), b, source, prefix), "to-b")
        to_a = kept.add(missing_in_a(a, among(b, id_b, only_b, told.b_only), prefix), "to-a")
        merged = kept.add(merge_conflicts(among(a, id_a, fill, fills), among(b, id_b, fill, fills), prefix).where("filled <> ''"), "merged")
        kept.drop(a)
        resolved = write_back(merged, table, prefix, b)
        kept.drop(b, merged)
        inserted, _ = append_events(to_b, table)
        kept.drop(to_b)
        exported = to_a.count()
        if exported:
            append_csv(to_a, mirror)
    return report(ids, inserted, exported, resolved)
