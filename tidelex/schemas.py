"""Fixed table schemas. Unknown keys of a record travel inside ``payload``."""

from pyspark.sql import types as T

SUBMISSION = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("created_utc", T.DoubleType(), False),
    T.StructField("subreddit", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("selftext", T.StringType(), True),
    T.StructField("author", T.StringType(), True),
    T.StructField("score", T.IntegerType(), False),
    T.StructField("upvote_ratio", T.DoubleType(), True),
    T.StructField("num_comments", T.IntegerType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("flair_text", T.StringType(), True),
    T.StructField("over_18", T.BooleanType(), False),
])
SUBMISSION_COLUMNS = SUBMISSION.fieldNames()

RAW_EVENT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("occurred_at", T.TimestampType(), False),
    T.StructField("payload", T.StringType(), False),
    T.StructField("ingested_at", T.TimestampType(), True),
    T.StructField("processed", T.BooleanType(), True),
    T.StructField("processed_at", T.TimestampType(), True),
])
EVENT_KEY = ["source", "source_id", "occurred_at"]

RESULT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("event_id", T.LongType(), False),
    T.StructField("occurred_at", T.TimestampType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("sentiment_score", T.DoubleType(), False),
    T.StructField("sentiment_label", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), True),
    T.StructField("sentiment_scores_json", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("processed_at", T.TimestampType(), False),
    T.StructField("model_version", T.StringType(), False),
    T.StructField("raw_text", T.StringType(), True),
])
RESULT_KEY = ["event_id", "occurred_at", "processed_at"]

METRIC = T.StructType([
    T.StructField("time_bucket", T.TimestampType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("n", T.LongType(), False),
    T.StructField("score_sum", T.DoubleType(), False),
])
METRIC_KEY = ["time_bucket", "source", "source_id", "label"]

DEAD_LETTER = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("occurred_at", T.TimestampType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("event_payload", T.StringType(), True),
    T.StructField("processing_component", T.StringType(), False),
    T.StructField("error_msg", T.StringType(), False),
    T.StructField("failed_at", T.TimestampType(), False),
])
