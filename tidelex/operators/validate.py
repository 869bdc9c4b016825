"""Checks after a reconciliation. Each runs over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.timefn import micros
from tidelex.operators.mapping import strip_key_prefix
from tidelex.operators.reconcile import presence

# Keys every payload must have.
REQUIRED_KEYS = ["id", "created_utc", "subreddit", "title", "author"]


def _one(name: str, df: DataFrame, checked, failed) -> DataFrame:
    return df.select(F.lit(name).alias("check"), checked.cast("long").alias("checked"),
                     failed.cast("long").alias("failed"))


def unique_ids(df: DataFrame, key: str = "id", name: str = "unique_ids") -> DataFrame:
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(key).alias("ids"))
    return _one(name, one, F.col("rows"), F.col("rows") - F.col("ids"))


def time_agreement(a: DataFrame, b: DataFrame, prefix: str = "", tolerance: float = 1.0) -> DataFrame:
    """Common ids whose times differ by more than the tolerance in seconds."""
    left = a.groupBy("id").agg(F.min("created_utc").alias("t_a"))
    right = b.groupBy(strip_key_prefix(F.col("source_id"), prefix).alias("id")).agg(
        (F.min(micros(F.col("occurred_at"))) / 1_000_000.0).alias("t_b"))
    both = left.join(right, "id")
    one = both.agg(F.count(F.lit(1)).alias("n"),
                   F.count_if(F.abs(F.col("t_a") - F.col("t_b")) > tolerance).alias("bad"))
    return _one("time_agreement", one, F.col("n"), F.col("bad"))


def completeness(a: DataFrame, b: DataFrame, prefix: str = "") -> DataFrame:
    """Ids of A missing in B."""
    ids = presence(a, b, prefix=prefix).where(F.col("rows_a") > 0)
    one = ids.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rows_b") == 0).alias("bad"))
    return _one("completeness", one, F.col("n"), F.col("bad"))


def _lacks(required: list[str]) -> Column:
    """Does the payload lack a key?"""
    keys = F.json_object_keys("payload")
    return F.size(F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(keys, F.array()))) > 0


def payload_keys(b: DataFrame, required: list[str] = REQUIRED_KEYS) -> DataFrame:
    """Payloads that lack a required key."""
    one = b.agg(F.count(F.lit(1)).alias("n"), F.count_if(_lacks(required)).alias("bad"))
    return _one("payload_keys", one, F.col("n"), F.col("bad"))


def both_way_sync(a: DataFrame, b: DataFrame, prefix: str = "") -> DataFrame:
    """Ids present in one store only."""
    one = presence(a, b, prefix=prefix).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("rows_a") == 0) | (F.col("rows_b") == 0)).alias("bad"))
    return _one("both_way_sync", one, F.col("n"), F.col("bad"))


def all_checks(a: DataFrame, b: DataFrame, prefix: str = "", tolerance: float = 1.0) -> DataFrame:
    """Every check with its share of good rows, and whether it passed.

    Each store is read once: its rows become (id, side) with a time and a flag, one
    aggregate by id holds both sides, and one more counts for all checks. Ids
    that are null are never the same.
    """
    no = F.lit(0)
    left = a.select(F.col("id").cast("string").alias("id"), F.lit(1).alias("_a"), no.alias("_b"), F.col("created_utc").cast("double").alias("_ta"),
                    F.lit(None).cast("double").alias("_tb"), no.alias("_bad"))
    right = b.select(strip_key_prefix(F.col("source_id"), prefix).alias("id"), no.alias("_a"), F.lit(1).alias("_b"), F.lit(None).cast("double").alias("_ta"),
                     (micros(F.col("occurred_at")) / 1_000_000.0).alias("_tb"), _lacks(REQUIRED_KEYS).cast("int").alias("_bad"))
    per = left.unionByName(right).groupBy("id", F.when(F.col("id").isNull(), F.col("_a")).alias("_side")).agg(
        *[F.sum(c).alias(c) for c in ("_a", "_b", "_bad")], F.min("_ta").alias("_ta"), F.min("_tb").alias("_tb"))
    in_a, in_b = F.col("_a") > 0, F.col("_b") > 0
    total = lambda c: F.coalesce(F.sum(c), no)
    one = per.agg(total("_a").alias("rows_a"), total("_b").alias("rows_b"), total("_bad").alias("bad"), F.count(F.when(in_a, F.col("id"))).alias("ids_a"),
                  F.count_if(in_a).alias("a"), F.count_if(in_a & ~in_b).alias("a_only"), F.count_if(in_b & ~in_a).alias("b_only"),
                  F.count_if(in_a & in_b).alias("both"), F.count_if(F.abs(F.col("_ta") - F.col("_tb")) > tolerance).alias("apart"), F.count(F.lit(1)).alias("n"))
    c = F.col
    found = {"unique_ids": (c("rows_a"), c("rows_a") - c("ids_a")), "time_agreement": (c("both"), c("apart")), "completeness": (c("a"), c("a_only")),
             "payload_keys": (c("rows_b"), c("bad")), "both_way_sync": (c("n"), c("a_only") + c("b_only"))}
    out = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), x.cast("long").alias("checked"), y.cast("long").alias("failed"))
                                         for name, (x, y) in found.items()])).alias("c")).select("c.*")
    return out.withColumns({
        "good_pct": F.coalesce(F.try_divide((F.col("checked") - F.col("failed")) * 100.0, F.col("checked")), F.lit(100.0)),
        "passed": F.col("failed") == 0})


def overall(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("all_passed"), F.count_if(~F.col("passed")).alias("failed_checks"))
