"""Two-store reconciliation: difference, copies in both directions, conflict merge, report.

Store A holds submission rows, store B raw events with a JSON payload. Ids are
reduced to one row per store before any join, so repeated ids cannot multiply
and a hot id costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.jsonfn import text_of, variant
from tidelex.functions.ordering import first_per_key
from tidelex.operators.mapping import csv_to_envelope, envelope_to_submission, strip_key_prefix
from tidelex.schemas import SUBMISSION_COLUMNS

# The fields a merge may fill in.
MERGE_FIELDS = ["title", "selftext", "author", "score", "upvote_ratio", "num_comments", "url", "flair_text"]


def presence(a: DataFrame, b: DataFrame, key_a: str = "id", key_b: str = "source_id", prefix: str = "") -> DataFrame:
    """One row per id with the number of rows in each store (0 where absent)."""
    ids_a = a.groupBy(F.col(key_a).alias("id")).agg(F.count(F.lit(1)).alias("rows_a"))
    ids_b = b.groupBy(strip_key_prefix(F.col(key_b), prefix).alias("id")).agg(
        F.count(F.lit(1)).alias("rows_b"))
    return ids_a.join(ids_b, "id", "full_outer").select(
        "id", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"))


def difference(ids: DataFrame) -> DataFrame:
    """Row totals and the number of ids in A only, in B only and in both."""
    in_a, in_b = F.col("rows_a") > 0, F.col("rows_b") > 0
    return ids.agg(
        F.coalesce(F.sum("rows_a"), F.lit(0)).alias("total_a"),
        F.coalesce(F.sum("rows_b"), F.lit(0)).alias("total_b"),
        F.count_if(in_a & ~in_b).alias("a_only"), F.count_if(in_b & ~in_a).alias("b_only"),
        F.count_if(in_a & in_b).alias("in_both"))


def missing_in_b(a: DataFrame, b: DataFrame, source: str, prefix: str = "") -> DataFrame:
    """Envelopes for the submissions that B lacks, each id once."""
    known = b.select(strip_key_prefix(F.col("source_id"), prefix).alias("id")).distinct()
    fresh = a.join(known, "id", "left_anti")
    return csv_to_envelope(first_per_key(fresh, ["id"], [F.col("created_utc")]), source)


def missing_in_a(a: DataFrame, b: DataFrame, prefix: str = "") -> DataFrame:
    """Submission rows for the events that A lacks, each id once."""
    keyed = b.withColumn("_id", strip_key_prefix(F.col("source_id"), prefix))
    fresh = keyed.join(a.select(F.col("id").alias("_id")).distinct(), "_id", "left_anti")
    once = first_per_key(fresh, ["_id"], [F.col("occurred_at"), F.col("payload")])
    return envelope_to_submission(once, prefix).select(*SUBMISSION_COLUMNS)


def _paired(a: DataFrame, b: DataFrame, prefix: str) -> DataFrame:
    """Both versions of each common id: A's columns as ``a``, B's row as ``b``."""
    one_a = first_per_key(a.select(*SUBMISSION_COLUMNS, *[c for c in ("ingested_at",) if c in a.columns]),
                          ["id"], [F.col("created_utc")])
    keyed = b.withColumn("id", strip_key_prefix(F.col("source_id"), prefix))
    one_b = first_per_key(keyed, ["id"], [F.col("occurred_at"), F.col("payload")])
    left = one_a.select("id", F.struct(*[c for c in one_a.columns if c != "id"]).alias("a"))
    right = one_b.select("id", F.struct(*[c for c in one_b.columns if c != "id"]).alias("b"))
    return left.join(right, "id").withColumn("v", variant(F.col("b.payload")))


def _empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("")) == ""


def _bits(told) -> Column:
    """One bit for each merge field for which ``told`` of its name is true."""
    bits = F.lit(0)
    for i, name in enumerate(MERGE_FIELDS):
        bits = bits + F.when(told(name), F.lit(1 << i)).otherwise(F.lit(0))
    return bits


def fields_held(a: DataFrame) -> DataFrame:
    """(id, held) of every row of A: the merge fields that have a value, as bits."""
    return a.select("id", _bits(lambda name: ~_empty(F.col(name))).alias("held"))


def fields_lacking(b: DataFrame, prefix: str = "") -> DataFrame:
    """(id, lacking) of every row of B: the merge fields that are empty, as bits."""
    told = b.select(strip_key_prefix(F.col("source_id"), prefix).alias("id"), variant(F.col("payload")).alias("_v"))
    return told.select("id", _bits(lambda name: _empty(text_of(F.col("_v"), name))).alias("lacking"))


def fillable_ids(held: DataFrame, lacking: DataFrame) -> DataFrame:
    """Ids of which some row of A has a value that some row of B lacks: ``merge_conflicts`` fills fields of no others."""
    of_a = held.groupBy("id").agg(F.bit_or("held").alias("held"))
    of_b = lacking.groupBy("id").agg(F.bit_or("lacking").alias("lacking"))
    return of_a.join(of_b, "id").where(F.col("held").bitwiseAND(F.col("lacking")) != 0).select("id")


def merge_conflicts(a: DataFrame, b: DataFrame, prefix: str = "", newest_wins: bool = False) -> DataFrame:
    """B's payload with its empty fields filled from A.

    A field is taken from A when A has a value and B has none; 0 is a value.
    With ``newest_wins`` the version ingested later also replaces a value that
    differs. Keys of the payload that are not merged stay as they are.
    Output: id, source, occurred_at, payload, filled (names of changed fields).
    """
    pairs = _paired(a, b, prefix)
    newer_a = F.lit(False)
    if newest_wins:
        newer_a = F.coalesce(F.col("a.ingested_at") > F.col("b.ingested_at"), F.lit(False))
    changes = []
    for name in MERGE_FIELDS:
        mine, theirs = F.col(f"a.{name}"), text_of(F.col("v"), name)
        take = ~_empty(mine) & (_empty(theirs) | (newer_a & ~mine.cast("string").eqNullSafe(theirs)))
        changes.append(F.when(take, F.struct(F.lit(name).alias("key"), mine.cast("variant").alias("value"))))
    pairs = pairs.withColumn("_changes", F.map_from_entries(F.array_compact(F.array(*changes))))
    base = F.from_json("b.payload", "map<string, variant>")
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key("_changes", k))
    return pairs.select(
        "id", F.col("b.source").alias("source"), F.col("b.occurred_at").alias("occurred_at"),
        F.to_json(F.map_concat(kept, F.col("_changes"))).alias("payload"),
        F.array_join(F.sort_array(F.map_keys("_changes")), ",").alias("filled"))


def report(ids: DataFrame, inserted_b: int | Column = 0, exported_a: int | Column = 0,
           resolved: int | Column = 0) -> DataFrame:
    """Statistics of one run, in one row. Coverage is computed from what was copied."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    stats = difference(ids).withColumns({
        "inserted_b": lit(inserted_b), "exported_a": lit(exported_a), "resolved": lit(resolved)})
    unique = F.col("total_a") + F.col("total_b") - F.col("in_both")
    all_ids = F.col("a_only") + F.col("b_only") + F.col("in_both")
    synced = F.col("in_both") + F.least("inserted_b", "a_only") + F.least("exported_a", "b_only")
    return stats.withColumns({
        "unique_records": unique,
        "coverage_pct": F.coalesce(F.try_divide(synced * 100.0, all_ids), F.lit(100.0)),
        "resolution_pct": F.col("resolved") / F.greatest(F.col("in_both"), F.lit(1)) * 100.0,
        "a_to_b": F.col("inserted_b") > 0, "b_to_a": F.col("exported_a") > 0,
        "merged": F.col("resolved") > 0})


def field_agreement(a: DataFrame, b: DataFrame, prefix: str = "") -> DataFrame:
    """Share of common ids whose field is equal in both stores, per field."""
    pairs = _paired(a, b, prefix)
    shares = [F.avg(F.col(f"a.{n}").cast("string").eqNullSafe(text_of(F.col("v"), n)).cast("int")).alias(n)
              for n in MERGE_FIELDS]
    one = pairs.agg(*shares)
    named = ", ".join(f"'{c}', `{c}`" for c in one.columns)
    return one.selectExpr(f"stack({len(one.columns)}, {named}) as (field, equal_share)")
