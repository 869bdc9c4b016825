"""Filling collection gaps of an event table from an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.functions.ordering import interval_join
from tidelex.operators.gaps import GAP_SECONDS, fill_plan, group_gaps
from tidelex.operators.search import first_matched_term
from tidelex.schemas import EVENT_KEY
from tidelex.session import materialize
from tidelex.sources.sinks import append_events


def _inside(rows: DataFrame, plan: DataFrame, known: DataFrame, group: str, ts: str, key: list[str]) -> DataFrame:
    """Keys of rows inside a gap that the table lacks, each once, with the gap they fill."""
    narrow = rows.select(*dict.fromkeys([*key, group, ts]))
    found = interval_join(narrow, plan.select(group, "gap_start", "gap_end"), [group], ts, "gap_start", "gap_end")
    new = found.join(known.select(*key), key, "left_anti")
    # A key may lie at the end of two gaps; the first one counts.
    return materialize(new.groupBy(*key).agg(F.min(F.struct("gap_start", group)).alias("_gap"))
                       .select(*key, F.col(f"_gap.`{group}`").alias("_group"), F.col("_gap.gap_start").alias("gap_start")))


def _append(rows: DataFrame, keys: DataFrame, table: str, key: list[str]) -> int:
    """Whole rows of the keys found. Only now are other columns read."""
    kept = rows.join(keys.select(*key), key, "left_semi").select(*rows.columns)
    return append_events(kept, table, key)[0] if keys.limit(1).count() else 0


def fill_gaps(spark: SparkSession, table: str, archive: DataFrame, group: str, terms: list[str] | None = None,
              wider: DataFrame | None = None, text: Column | None = None, min_gap: float = GAP_SECONDS,
              ts: str = "occurred_at", key: list[str] = EVENT_KEY) -> DataFrame:
    """Fill the gaps of each group and append what was found. Returns one row per group with a gap:
    group, gaps, gap_seconds, time_rows, term_rows, filled_gaps.

    First all archive rows inside the gaps are appended, then rows of ``wider``
    (by default the archive) that hold one of ``terms`` in ``text`` (by default the
    payload) and were not known by then. The plan and the keys found are written out
    before a row is appended; a second run finds nothing. A run that is lost
    half-way is repeated: rows it had appended are known by then.

    Only keys, groups and times are joined with the gaps; whole rows are read for
    the keys found. Rows without a key or a time are never appended.
    """
    known = spark.read.parquet(table)
    plan = materialize(fill_plan(group_gaps(known.select(group, ts), group, ts, min_gap), group))
    by_time = _inside(archive, plan, known, group, ts, key)
    # Term hits leave out what the first search found; the table itself is read as it was before.
    by_term = None
    if terms:
        wider = archive if wider is None else wider
        hit = wider.where(first_matched_term(F.lower(F.col("payload") if text is None else text), terms).isNotNull())
        seen = known.select(*key).unionByName(by_time.select(*key))
        by_term = _inside(hit, plan, seen, group, ts, key)
    _append(archive, by_time, table, key)
    if by_term is not None:
        _append(wider, by_term, table, key)
    counted = by_time.select("_group", "gap_start", F.lit(1).alias("_time"), F.lit(0).alias("_term"))
    if by_term is not None:
        counted = counted.unionByName(by_term.select("_group", "gap_start", F.lit(0).alias("_time"), F.lit(1).alias("_term")))
    per = counted.groupBy("_group", "gap_start").agg(F.sum("_time").alias("_time"), F.sum("_term").alias("_term"))
    return (plan.withColumnRenamed(group, "_group").join(per, ["_group", "gap_start"], "left")
            .groupBy(F.col("_group").alias(group)).agg(
                F.count(F.lit(1)).alias("gaps"), F.sum("gap_duration_seconds").alias("gap_seconds"),
                F.coalesce(F.sum("_time"), F.lit(0)).alias("time_rows"), F.coalesce(F.sum("_term"), F.lit(0)).alias("term_rows"),
                F.count("_time").alias("filled_gaps")))
