"""Key integrity checks of the raw event table.

All of them start from one count per key value, reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.functions.timefn import bucket

LIST_PIECE = 1000


def _per(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _totals(per: DataFrame, key: str) -> DataFrame:
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
                   F.count(key).alias("unique_ids"))


def id_uniqueness(events: DataFrame, key: str = "id") -> DataFrame:
    out = _totals(_per(events, key), key)
    return out.withColumn("duplicate_count", F.col("total_records") - F.col("unique_ids")).withColumn(
        "status", F.when(F.col("total_records") == F.col("unique_ids"), F.lit("PASS"))
        .otherwise(F.lit("FAIL")))


def duplicate_ids(events: DataFrame, key: str = "id") -> DataFrame:
    """Ids held by several rows: count, first and last ingest, sources in order."""
    per = events.groupBy(key, "source").agg(
        F.count(F.lit(1)).alias("n"), F.min("ingested_at").alias("lo"), F.max("ingested_at").alias("hi"))
    return per.groupBy(key).agg(
        F.sum("n").alias("occurrence_count"), F.min("lo").alias("first_ingested"),
        F.max("hi").alias("last_ingested"),
        F.array_join(F.sort_array(F.collect_list("source")), ", ").alias("sources")
    ).where(F.col("occurrence_count") > 1)


def source_uniqueness(events: DataFrame, key: str = "id") -> DataFrame:
    out = _per(events, "source", key).groupBy("source").agg(
        F.sum("n").alias("total_records"), F.count(key).alias("unique_ids"))
    pct = F.round(F.col("unique_ids").cast("decimal(20,0)") * 100 / F.col("total_records"), 2)
    return out.withColumns({"duplicate_count": F.col("total_records") - F.col("unique_ids"),
                            "uniqueness_percentage": pct.cast("double")})


def source_id_uniqueness(events: DataFrame, source: str) -> DataFrame:
    return id_uniqueness(events.where(F.col("source") == source), "source_id")


def duplicate_source_ids(events: DataFrame, source: str, piece: int = LIST_PIECE) -> DataFrame:
    """Repeated source ids with the list of row ids.

    A list of any length stays whole: it is given in numbered pieces of about
    ``piece`` ids, assigned by a hash of the id, so a hot source id is spread
    whatever its ids have in common.
    An id held by several rows is written once, with its count.
    """
    rows = events.where(F.col("source") == source)
    ids = rows.groupBy("source_id", "id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ingested_at").alias("lo"), F.max("ingested_at").alias("hi"))
    per = ids.groupBy("source_id").agg(
        F.sum("n").alias("occurrence_count"), F.min("lo").alias("first_ingested"),
        F.max("hi").alias("last_ingested"), F.count(F.lit(1)).alias("_ids")
    ).where(F.col("occurrence_count") > 1)
    entry = F.struct("id", F.concat(F.col("id").cast("string"), F.when(
        F.col("n") > 1, F.concat(F.lit(" x"), F.col("n").cast("string"))).otherwise(F.lit(""))).alias("text"))
    listed = ids.join(per, "source_id").withColumn("piece", F.pmod(
        F.conv(F.left(F.md5(F.col("id").cast("string")), F.lit(7)), 16, 10).cast("long"), F.ceil(F.col("_ids") / piece)))
    return listed.groupBy("source_id", "piece", "occurrence_count", "first_ingested", "last_ingested").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]), ", ").alias("row_ids"))


def duplicate_times(events: DataFrame, key: str = "id") -> DataFrame:
    """Hours in which second and later rows of an id were ingested.

    The first row of an id lies in its earliest hour, so counts per (id, hour)
    give the answer without numbering the rows of an id.
    """
    per = events.groupBy(key, bucket(F.col("ingested_at"), "hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"))
    first = per.groupBy(key).agg(F.min("hour").alias("first_hour"), F.sum("n").alias("total")).where(
        F.col("total") > 1)
    later = per.join(first, key).withColumn(
        "extra", F.col("n") - (F.col("hour") == F.col("first_hour")).cast("int")).where(F.col("extra") > 0)
    return later.groupBy(F.col("hour").alias("ingestion_hour")).agg(
        F.sum("extra").alias("duplicate_records_created"), F.count(F.lit(1)).alias("unique_duplicate_ids"))


def summary(events: DataFrame, source: str) -> DataFrame:
    """Totals, uniqueness of ids and of one source's ids, and a three-way status."""
    ids = _totals(_per(events, "id"), "id").select(
        "total_records", F.col("unique_ids").alias("unique_primary_keys"))
    one = events.where(F.col("source") == source)
    of_source = _totals(_per(one, "source_id"), "source_id").select(
        F.struct(F.col("total_records").alias("t"), F.col("unique_ids").alias("u"))).scalar()
    span = events.agg(F.struct(F.min("ingested_at").alias("lo"), F.max("ingested_at").alias("hi"))).scalar()
    out = ids.withColumns({"_s": of_source, "_t": span}).select(
        "total_records", "unique_primary_keys",
        (F.col("total_records") - F.col("unique_primary_keys")).alias("primary_key_duplicates"),
        F.col("_s.t").alias("source_records"), F.col("_s.u").alias("unique_source_ids"),
        (F.col("_s.t") - F.col("_s.u")).alias("source_id_duplicates"),
        F.col("_t.lo").alias("earliest_record"), F.col("_t.hi").alias("latest_record"))
    pct = lambda part, whole: F.round(F.try_divide(
        F.col(part).cast("decimal(20,0)") * 100, F.col(whole).cast("decimal(20,0)")), 2).cast("double")
    good_ids = F.col("total_records") == F.col("unique_primary_keys")
    good_source = F.col("source_records") == F.col("unique_source_ids")
    return out.withColumns({
        "primary_key_pct": pct("unique_primary_keys", "total_records"),
        "source_id_pct": pct("unique_source_ids", "source_records"),
        "overall_status": F.when(good_ids & good_source, F.lit("EXCELLENT")).when(
            good_ids, F.lit("GOOD")).otherwise(F.lit("ISSUES"))})


def advice(events: DataFrame, source: str) -> DataFrame:
    """The first advice that applies: repeated ids, repeated source ids, or nothing to do."""
    text = F.when(F.col("primary_key_duplicates") > 0, F.lit("PRIMARY KEY DUPLICATES DETECTED")).when(
        F.col("source_id_duplicates") > 0, F.lit("SOURCE_ID DUPLICATES DETECTED")).otherwise(
        F.lit("NO DUPLICATES FOUND"))
    return summary(events, source).select(text.alias("recommendation"))
