"""The driver's tables seen as results, raw events, posts and stores.

Each view exists as a DataFrame and, for the reference SQL, as the text of a
common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.functions.timefn import micros
from tidelex.operators.mapping import to_envelope
from tidelex.schemas import SUBMISSION_COLUMNS

FIRST_POST = 1704067200
POST_STEP = 1800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_of(table(spark, sf_dir, "events"))


def results_of(events: DataFrame) -> DataFrame:
    score = (F.col("value") - 50) / (F.col("value") + 50)
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("id"), "event_id", ts.alias("occurred_at"),
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_id"),
        score.alias("sentiment_score"),
        F.when(score > 0.05, F.lit("positive")).when(score < -0.05, F.lit("negative"))
        .otherwise(F.lit("neutral")).alias("sentiment_label"),
        F.when(F.col("event_type") != "error", F.abs(score)).alias("confidence"),
        (ts + F.expr("INTERVAL 1 HOUR")).alias("processed_at"),
        F.lit("lexicon-1").alias("model_version"),
        F.concat_ws(" ", "event_type", "props").alias("raw_text"))


V_RESULTS = """v_results AS (
  SELECT event_id AS id, event_id, ts AS occurred_at, event_type AS source,
    CAST(user_id AS VARCHAR) AS source_id, (value - 50) / (value + 50) AS sentiment_score,
    CASE WHEN (value - 50) / (value + 50) > 0.05 THEN 'positive'
         WHEN (value - 50) / (value + 50) < -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
    CASE WHEN event_type <> 'error' THEN abs((value - 50) / (value + 50)) END AS confidence,
    ts + INTERVAL 1 HOUR AS processed_at, 'lexicon-1' AS model_version,
    event_type || ' ' || props AS raw_text
  FROM events)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events. The lag of ingest and of processing grows with ``value``; errors have no flag."""
    ts = micros(F.col("ts"))
    ingested = ts + F.round(F.col("value") * 1000).cast("long") * 1000
    flag = F.when(F.col("event_type") != "error", F.col("value") >= 50)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("occurred_at"),
        F.col("props").alias("payload"), F.timestamp_micros(ingested).alias("ingested_at"),
        flag.alias("processed"),
        F.when(flag, F.timestamp_micros(ingested + F.round(F.col("value") * 60).cast("long") * 1_000_000))
        .alias("processed_at"))


V_RAW = """v_raw AS (
  SELECT *, CASE WHEN processed THEN make_timestamp(epoch_us(ingested_at) + CAST(round(value * 60) AS BIGINT) * 1000000) END AS processed_at
  FROM (SELECT event_id AS id, event_type AS source, CAST(user_id AS VARCHAR) AS source_id, ts AS occurred_at,
      props AS payload, make_timestamp(epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) * 1000) AS ingested_at,
      CASE WHEN event_type <> 'error' THEN value >= 50 END AS processed, value
    FROM events))"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as submissions, half an hour apart, with their time as ``posted_at``."""
    return posts_of(table(spark, sf_dir, "documents"))


def posts_of(documents: DataFrame) -> DataFrame:
    epoch = F.lit(FIRST_POST) + F.col("doc_id") * POST_STEP
    return documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        epoch.cast("double").alias("created_utc"), F.col("source").alias("subreddit"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("selftext"),
        F.when(F.col("lang") != "es", F.concat(F.lit("u_"), F.col("lang"))).alias("author"),
        F.col("n_chars").cast("int").alias("score"),
        F.round(F.col("n_chars") / (F.col("n_chars") + 1000), 4).alias("upvote_ratio"),
        F.length("text").cast("int").alias("num_comments"),
        F.concat(F.lit("https://posts.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("lang") == "de", F.lit("")).otherwise(F.col("lang")).alias("flair_text"),
        F.lit(False).alias("over_18"), F.timestamp_seconds(epoch).alias("posted_at"),
        "doc_id", "lang")


V_POSTS = f"""v_posts AS (
  SELECT 'd' || doc_id AS id, CAST({FIRST_POST} + doc_id * {POST_STEP} AS DOUBLE) AS created_utc, source AS subreddit,
    split_part(text, chr(10), 1) AS title, text AS selftext,
    CASE WHEN lang <> 'es' THEN 'u_' || lang END AS author, CAST(n_chars AS BIGINT) AS score,
    round(n_chars / (n_chars + 1000), 4) AS upvote_ratio, length(text) AS num_comments,
    'https://posts.example/' || doc_id AS url, CASE WHEN lang = 'de' THEN '' ELSE lang END AS flair_text,
    false AS over_18, make_timestamp(CAST({FIRST_POST} + doc_id * {POST_STEP} AS BIGINT) * 1000000) AS posted_at,
    doc_id, lang
  FROM documents)"""


def doc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw events. Spanish records carry their text under a key that is not read."""
    return doc_events_of(table(spark, sf_dir, "documents"))


def doc_events_of(documents: DataFrame) -> DataFrame:
    return posts_of(documents).select(
        F.col("doc_id").alias("id"), F.col("subreddit").alias("source"), F.col("id").alias("source_id"),
        F.col("posted_at").alias("occurred_at"),
        F.when(F.col("lang") == "es", F.to_json(F.struct(F.col("selftext").alias("caption"))))
        .otherwise(F.to_json(F.struct("title", "selftext", "score"))).alias("payload"),
        F.lit(None).cast("string").alias("content"))


V_DOC_EVENTS = V_POSTS + """, v_doc_events AS (
  SELECT doc_id AS id, subreddit AS source, id AS source_id, posted_at AS occurred_at,
    CASE WHEN lang = 'es' THEN '' ELSE trim(title, {ws}) || ' ' || trim(selftext, {ws}) END AS text
  FROM v_posts)""".format(ws="' ' || chr(9) || chr(10) || chr(13)")


def left_out(key: str, parts: int, part: int):
    """Rows of one of ``parts`` hash parts of a text key: those that a store or a source lacks."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long") % parts == part


def left_out_sql(key: str, parts: int, part: int) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 7))::BIGINT % {parts} = {part})"


def store_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File store: all posts but one hash part in ten."""
    return posts(spark, sf_dir).where(~left_out("id", 10, 3)).select(*SUBMISSION_COLUMNS)


def store_b(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    """Event store: all posts but another part in ten; toxic bodies are blank, authors of low quality are unknown."""
    labelled = posts(spark, sf_dir).where(~left_out("id", 10, 7)).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kept = labelled.withColumns({
        "selftext": F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.col("selftext")),
        "author": F.when(F.coalesce(F.col("quality"), F.lit(1)) == 1, F.col("author")),
        "score": F.when(F.col("quality") == 0, F.lit(0)).otherwise(F.col("score"))})
    events = to_envelope(kept.select(*SUBMISSION_COLUMNS), "posts")
    return events.withColumn("source_id", F.concat(F.lit(prefix), F.col("source_id")))


V_STORES = V_POSTS + f""", store_a AS (SELECT * FROM v_posts WHERE NOT {left_out_sql('id', 10, 3)}),
store_b AS (SELECT p.* REPLACE (
    CASE WHEN l.toxic = 1 THEN '' ELSE p.selftext END AS selftext,
    CASE WHEN coalesce(l.quality, 1) = 1 THEN p.author END AS author,
    CASE WHEN l.quality = 0 THEN 0 ELSE p.score END AS score)
  FROM v_posts p LEFT JOIN labels l USING (doc_id) WHERE NOT {left_out_sql('p.id', 10, 7)})"""


def keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw events with repeated ids: order as id, part as source id."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("source"),
        F.col("l_partkey").cast("string").alias("source_id"),
        F.col("l_shipdate").cast("timestamp").alias("ingested_at"))


V_KEYED = """v_keyed AS (
  SELECT l_orderkey AS id, l_returnflag AS source, CAST(l_partkey AS VARCHAR) AS source_id, l_shipdate AS ingested_at
  FROM lineitem)"""
