"""Routing of analysed events: results, dead letters and language skips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.timefn import as_column
from tidelex.operators.scoring import LABELS, Scorer, classify, classify_with_model
from tidelex.operators.text import TARGET_LANGUAGE, event_text, is_blank, preprocess

# Stage names and the message of the blank-text check.
STAGE_INPUT = "preprocessing_input_validation"
STAGE_SAVE = "save_sentiment_result"
STAGE_EVENT = "process_single_event"
BLANK_MESSAGE = "Extracted text content is empty or None after checking content and payload."

RESULT_ROUTE, DEAD_LETTER_ROUTE, SKIP_ROUTE = "result", "dead_letter", "skipped_language"


def route_events(events: DataFrame, target: str = TARGET_LANGUAGE,
                 make_scorer: Callable[[], Scorer] | None = None, detect: Callable[[Column], Column] | None = None,
                 lemmatize: Callable[[Column], Column] | None = None) -> DataFrame:
    """Extract, check, clean, gate by language and score; one output row per event.

    Added columns: original_text, cleaned_text, language columns, label,
    confidence, p_*, model_version, score_error, route, stage, error_msg.
    """
    staged = events if "content" in events.columns else events.withColumn("content", F.lit(None).cast("string"))
    staged = staged.withColumn("original_text", event_text(F.col("content"), F.col("payload")))
    staged = preprocess(staged, "original_text", target, words_as="_cleaned_words", detect=detect, lemmatize=lemmatize)
    if make_scorer is None:
        scored = classify(staged, "cleaned_text", words="_cleaned_words").withColumn("score_error", F.lit(None).cast("string"))
    else:
        scored = classify_with_model(staged.drop("_cleaned_words"), "cleaned_text", make_scorer)
    blank = is_blank(F.col("original_text"))
    broken = F.col("occurred_at").isNull() | F.col("source_id").isNull()
    foreign = ~F.col("is_target_language")
    return scored.drop("_cleaned_words").withColumns({
        "route": F.when(blank | (broken & ~foreign), F.lit(DEAD_LETTER_ROUTE))
        .when(foreign, F.lit(SKIP_ROUTE)).otherwise(F.lit(RESULT_ROUTE)),
        "stage": F.when(blank, F.lit(STAGE_INPUT)).when(broken & ~foreign, F.lit(STAGE_SAVE)),
        "error_msg": F.when(blank, F.lit(BLANK_MESSAGE)).when(
            broken & ~foreign, F.lit("Failed to save sentiment result to database")),
    })


def result_rows(routed: DataFrame, processed_at) -> DataFrame:
    """Result table rows. ``sentiment_score`` is the winning probability."""
    hits = routed.where(F.col("route") == RESULT_ROUTE)
    scores = F.create_map(*[part for lab in LABELS for part in (F.lit(lab), F.col(f"p_{lab}"))])
    return hits.select(
        F.xxhash64("id", "occurred_at").alias("id"),
        F.col("id").alias("event_id"), "occurred_at",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("source_id", F.lit("unknown")).alias("source_id"),
        F.col("confidence").alias("sentiment_score"),
        F.col("label").alias("sentiment_label"), "confidence",
        scores.alias("sentiment_scores_json"),
        as_column(processed_at).cast("timestamp").alias("processed_at"),
        F.coalesce("model_version", F.lit("unknown")).alias("model_version"),
        F.col("original_text").alias("raw_text"),
        (F.col("p_positive") - F.col("p_negative")).alias("signed_score"))


def dead_letters(routed: DataFrame, failed_at) -> DataFrame:
    """Quarantine rows with the whole event as JSON."""
    failed_time = as_column(failed_at).cast("timestamp")
    event_id = F.col("id").cast("string")
    if "event_id" in routed.columns:
        event_id = F.coalesce(F.col("event_id"), event_id)
    whole = [c for c in ("id", "source", "source_id", "occurred_at", "payload", "content",
                         "ingested_at", "processed") if c in routed.columns]
    return routed.where(F.col("route") == DEAD_LETTER_ROUTE).select(
        event_id.alias("event_id"),
        F.coalesce(F.col("occurred_at").cast("timestamp"), failed_time).alias("occurred_at"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("source_id", F.lit("unknown")).alias("source_id"),
        F.to_json(F.struct(*whole)).alias("event_payload"),
        F.coalesce("stage", F.lit(STAGE_EVENT)).alias("processing_component"),
        F.coalesce("error_msg", F.lit("")).alias("error_msg"),
        failed_time.alias("failed_at"))


def skipped_rows(routed: DataFrame) -> DataFrame:
    """Events of other languages, recorded so that none goes missing."""
    return routed.where(F.col("route") == SKIP_ROUTE).select(
        "id", "occurred_at", "source", "source_id", "detected_language_code",
        "detected_language_confidence", "cleaned_text")


def with_attempts(letters: DataFrame) -> DataFrame:
    return letters if "attempts" in letters.columns else letters.withColumn("attempts", F.lit(1))


def replayable(letters: DataFrame, event_schema: str, max_attempts: int | None = None) -> DataFrame:
    """Dead letters back to events, with the number of attempts so far; ``exhausted`` has those past the limit."""
    out = with_attempts(letters)
    if max_attempts is not None:
        out = out.where(F.col("attempts") < max_attempts)
    parsed = out.withColumn("_event", F.from_json("event_payload", event_schema))
    return parsed.select("_event.*", (F.col("attempts") + 1).alias("attempts"))


def exhausted(letters: DataFrame, max_attempts: int) -> DataFrame:
    """Dead letters that have had all their attempts."""
    return with_attempts(letters).where(F.col("attempts") >= max_attempts)
