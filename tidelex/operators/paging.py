"""Keyset pages, cursors and display rows."""

from __future__ import annotations

import base64
import binascii
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.ordering import first_per_key
from tidelex.operators.filters import result_filters
from tidelex.operators.text import preview

# Page bounds.
MAX_PAGE = 10_000
DEFAULT_PAGE = 100
RECENT_ROWS = 50


def encode_cursor(timestamp: datetime, row_id: int) -> str:
    body = json.dumps({"timestamp": timestamp.isoformat(), "id": row_id})
    return base64.b64encode(body.encode()).decode()


def decode_cursor(cursor: str) -> tuple[datetime, int]:
    """Time and id of a cursor; ``ValueError`` when it cannot be read."""
    try:
        body = json.loads(base64.b64decode(cursor, validate=True))
        return datetime.fromisoformat(body["timestamp"]), int(body["id"])
    except (binascii.Error, ValueError, KeyError, TypeError) as err:
        raise ValueError(f"bad cursor: {cursor!r}") from err


def cursor_column(ts: Column, row_id: Column) -> Column:
    body = F.to_json(F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                              row_id.alias("id")))
    return F.base64(body.cast("binary"))


def keyset_page(results: DataFrame, limit: int = DEFAULT_PAGE, cursor: str | None = None, **filters) -> DataFrame:
    """The page after the cursor, newest first."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    rows = result_filters(results, **filters)
    if cursor is not None:
        when, row_id = decode_cursor(cursor)
        at = F.lit(when.isoformat(sep=" ")).cast("timestamp")
        ts = F.col("occurred_at").cast("timestamp")
        # The first test repeats what the second implies, so that the scan can skip files.
        rows = rows.where(ts <= at).where((ts < at) | ((ts == at) & (F.col("id") < row_id)))
    return rows.orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit)


def fetch_range(results: DataFrame, start=None, end=None, limit: int | None = None, **filters) -> DataFrame:
    """All rows of a range, each id once, newest first."""
    rows = first_per_key(result_filters(results, start=start, end=end, **filters), ["id"],
                         [F.col("occurred_at"), F.col("processed_at")])
    ordered = rows.orderBy(F.desc("occurred_at"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def recent_for_display(results: DataFrame, limit: int = RECENT_ROWS) -> DataFrame:
    """The newest rows, formatted for a table."""
    three = lambda c: F.format_string("%.3f", F.col(c))
    newest = results.orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit)
    return newest.select(
        F.date_format("occurred_at", "yyyy-MM-dd HH:mm").alias("time"), "source", "source_id",
        F.initcap("sentiment_label").alias("sentiment"), three("sentiment_score").alias("score"),
        F.when(F.col("confidence").isNull(), F.lit("N/A")).otherwise(three("confidence")).alias("confidence"),
        preview(F.col("raw_text")).alias("text_preview"))
