"""Row mapping and repair between submissions, envelopes and push rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.jsonfn import has_key, text_of, variant
from tidelex.functions.timefn import as_column, micros
from tidelex.schemas import SUBMISSION_COLUMNS

# The placeholder for a missing author and the archive defaults.
DELETED_AUTHOR = "[deleted]"
ARCHIVE_DEFAULTS = {
    "id": "", "created_utc": 0.0, "subreddit": "", "title": "", "selftext": "", "author": "",
    "score": 0, "upvote_ratio": 0.0, "num_comments": 0, "url": "", "flair_text": "", "over_18": False,
}
COLUMN_TYPES = {
    "id": "string", "created_utc": "double", "subreddit": "string", "title": "string",
    "selftext": "string", "author": "string", "score": "int", "upvote_ratio": "double",
    "num_comments": "int", "url": "string", "flair_text": "string", "over_18": "boolean",
}


def normalize_submission(df: DataFrame) -> DataFrame:
    """Live record to the 12 columns: author placeholder, lower-cased group, empty flair to null."""
    return df.select(
        "id", F.col("created_utc").try_cast("double").alias("created_utc"),
        F.lower("subreddit").alias("subreddit"), "title", "selftext",
        F.coalesce("author", F.lit(DELETED_AUTHOR)).alias("author"),
        F.col("score").try_cast("int").alias("score"),
        F.col("upvote_ratio").try_cast("double").alias("upvote_ratio"),
        F.col("num_comments").try_cast("int").alias("num_comments"), "url",
        F.nullif(F.col("flair_text"), F.lit("")).alias("flair_text"),
        F.col("over_18").try_cast("boolean").alias("over_18"))


def normalize_archive(df: DataFrame) -> DataFrame:
    """Archive record to the 12 columns, with a default for each missing value.

    A value that cannot be read is null, not the default; ``split_bad`` finds such rows with their reason.
    """
    if "link_flair_text" in df.columns:
        df = df.withColumnRenamed("link_flair_text", "flair_text")
    out = []
    for name in SUBMISSION_COLUMNS:
        default = F.lit(ARCHIVE_DEFAULTS[name])
        told = F.col(name) if name in df.columns else F.lit(None).cast("string")
        out.append(F.when(told.isNull(), default.cast(COLUMN_TYPES[name])).otherwise(told.try_cast(COLUMN_TYPES[name])).alias(name))
    return df.select(*out)


def to_envelope(df: DataFrame, source: str, ingested_at=None) -> DataFrame:
    """Submission to raw event: the whole record becomes the payload. ``ingested_at`` is now by default."""
    arrived = F.current_timestamp() if ingested_at is None else as_column(ingested_at).cast("timestamp")
    return df.select(
        F.xxhash64(F.lit(source), F.col("id"), F.col("created_utc")).alias("id"),
        F.lit(source).alias("source"),
        F.col("id").alias("source_id"),
        F.timestamp_seconds("created_utc").alias("occurred_at"),
        F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                  {"ignoreNullFields": "false"}).alias("payload"),
        arrived.alias("ingested_at"), F.lit(False).alias("processed"),
        F.lit(None).cast("timestamp").alias("processed_at"))


def csv_to_envelope(df: DataFrame, source: str, ingested_at=None) -> DataFrame:
    """File row to raw event: empty text for a null body, null ratio and flair kept as null."""
    body = df.withColumn("selftext", F.coalesce("selftext", F.lit(""))).withColumn(
        "created_utc", F.col("created_utc").cast("long"))
    return to_envelope(body.select(*SUBMISSION_COLUMNS), source, ingested_at)


def envelope_to_submission(df: DataFrame, key_prefix: str = "") -> DataFrame:
    """Raw event to the 12 columns. Defaults stand for absent keys; a present null stays null."""
    fallback = {
        "id": strip_key_prefix(F.col("source_id"), key_prefix),
        "created_utc": F.unix_timestamp(F.col("occurred_at").cast("timestamp")).cast("double"),
        "subreddit": F.lit(""), "title": F.lit(""), "selftext": F.lit(""), "author": F.lit(""),
        "score": F.lit(0), "upvote_ratio": F.lit(0.0), "num_comments": F.lit(0),
        "url": F.lit(""), "flair_text": F.lit(""), "over_18": F.lit(False),
    }
    parsed = df.withColumn("_v", variant(F.col("payload")))
    out = []
    for name in SUBMISSION_COLUMNS:
        found = text_of(F.col("_v"), name).try_cast(COLUMN_TYPES[name])
        out.append(F.when(has_key(F.col("_v"), name), found)
                   .otherwise(fallback[name].cast(COLUMN_TYPES[name])).alias(name))
    return parsed.select(*out)


def strip_key_prefix(col: Column, prefix: str) -> Column:
    """Drop ``prefix`` where the key starts with it."""
    if not prefix:
        return col
    return F.when(col.startswith(prefix), F.substring(col, len(prefix) + 1, 2**31 - 1)).otherwise(col)


def repair_time(col: Column) -> Column:
    """Epoch seconds from a number or a date text; null when neither can be read."""
    text = F.trim(col.cast("string"))
    dated = micros(F.try_to_timestamp(text)) / F.lit(1_000_000.0)
    return F.coalesce(text.try_cast("double"), dated)


def split_bad(df: DataFrame, time_col: str = "created_utc",
              required: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Good rows with repaired times, and the rejected rows with a ``_reason``: an unreadable time, a missing
    required value, or a value that its column's type cannot hold."""
    reason = F.when(repair_time(F.col(time_col)).isNull(), F.lit(f"bad {time_col}"))
    for name, kind in COLUMN_TYPES.items():
        if name in df.columns and name != time_col and kind != "string":
            unread = F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()
            reason = F.when(unread, F.lit(f"bad {name}")).otherwise(reason)
    for name in required:
        blank = F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""
        reason = F.when(blank, F.lit(f"missing {name}")).otherwise(reason)
    marked = df.withColumn("_reason", reason)
    good = marked.where(F.col("_reason").isNull()).drop("_reason").withColumn(
        time_col, repair_time(F.col(time_col)))
    return good, marked.where(F.col("_reason").isNotNull())


ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
PUSH_COLUMNS = ["event_id", "occurred_at", "processed_at", "source", "source_id",
                "sentiment_score", "sentiment_label", "confidence", "model_version"]


def push_row(df: DataFrame) -> DataFrame:
    """Result to the nine columns of a push row, times as ISO text."""
    iso = {"occurred_at", "processed_at"}
    return df.select(*[F.date_format(c, ISO_FORMAT).alias(c) if c in iso else F.col(c)
                       for c in PUSH_COLUMNS])
