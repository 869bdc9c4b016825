"""Scans of submission files, event tables and landing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelex.operators.mapping import strip_key_prefix
from tidelex.schemas import RAW_EVENT, SUBMISSION

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def read_submissions(spark: SparkSession, path: str, schema: T.StructType = SUBMISSION) -> DataFrame:
    """Typed 12-column file scan. Bodies may hold line breaks, so a file is not split: keep files small."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def read_events(spark: SparkSession, path: str, source: str | None = None, key_prefix: str = "") -> DataFrame:
    """Event table scan, optionally of one source, with the key prefix taken off."""
    df = spark.read.parquet(path)
    if source is not None:
        df = df.where(F.col("source") == source)
    return df.withColumn("source_id", strip_key_prefix(F.col("source_id"), key_prefix))


def event_scan(df: DataFrame, source: str, key_prefix: str = "") -> DataFrame:
    """The six columns of one source's events."""
    return df.where(F.col("source") == source).select(
        "id", "source", strip_key_prefix(F.col("source_id"), key_prefix).alias("source_id"),
        "occurred_at", "payload", "ingested_at")


def known_keys(df: DataFrame, key: str = "source_id") -> DataFrame:
    """Distinct keys, for use in an anti-join."""
    return df.select(F.col(key).alias("id")).where(F.col("id").isNotNull()).distinct()


def known_keys_of_all(*stores: DataFrame) -> DataFrame:
    """Keys over all stores. Each store is reduced before the union."""
    keys = stores[0]
    for store in stores[1:]:
        keys = keys.union(store)
    return keys.distinct()


def csv_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a submission file store."""
    return known_keys(read_submissions(spark, path), "id")


def event_stream(spark: SparkSession, path: str, schema: T.StructType = RAW_EVENT,
                 max_files: int | None = None, pattern: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Event table or landing folder as a stream of new files."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType = RAW_EVENT) -> DataFrame:
    """Events from a Kafka topic with JSON values (needs the Kafka package on the class path)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).load())
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")
