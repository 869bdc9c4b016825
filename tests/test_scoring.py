"""Scoring, routing and quality."""

import pandas as pd
from pyspark.sql import functions as F

from tidelex.operators import results as RE
from tidelex.operators import scoring as SC
from tidelex.operators.state import batch_outcome


def test_classify_signs_and_blank(spark):
    df = spark.createDataFrame([(1, "great excellent win"), (2, "terrible awful"), (3, " "), (4, "plain words")], "i int, t string")
    rows = {r.i: r for r in SC.classify(df, "t").collect()}
    assert [rows[i].label for i in (1, 2, 3, 4)] == ["positive", "negative", "neutral", "neutral"]
    assert rows[3].confidence == 1.0
    assert abs(rows[1].p_positive + rows[1].p_negative + rows[1].p_neutral - 1) < 1e-9


def test_compound_boundary_and_word_edges(spark):
    df = spark.createDataFrame([(1, "good"), (2, "goodness forest"), (3, "bad"), (4, "")], "i int, t string")
    rows = {r.i: r for r in SC.with_compound(df, "t").collect()}
    assert rows[1].compound_label == "positive" and rows[3].compound_label == "negative"
    assert rows[2].compound == 0 and rows[4].compound_label == "neutral"


def fragile():
    labels = list(SC.LABELS)

    class Fragile:
        version = "fragile-1"

        def score(self, texts):
            if texts.str.contains("boom").any():
                raise RuntimeError("cannot score")
            return pd.DataFrame([[0.7, 0.2, 0.1]] * len(texts), columns=labels)

    return Fragile


def test_model_errors_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "boom"), (3, None), (4, "ok")], "i int, t string").coalesce(1)
    rows = {r.i: r for r in SC.classify_with_model(df, "t", fragile()).collect()}
    assert rows[1].label == rows[4].label == "positive" and rows[1].score_error is None
    assert (rows[2].label, rows[2].confidence, rows[2].score_error) == ("neutral", 0.0, "cannot score")
    assert (rows[3].label, rows[3].confidence) == ("neutral", 1.0)
    bulk = {r.i: r for r in SC.bulk_analyze(df, "t", fragile()).collect()}
    assert (bulk[2].label, bulk[2].confidence, bulk[2].p_error) == ("error", 0.0, 1.0)


def test_every_event_has_one_route(spark):
    df = spark.createDataFrame([
        (1, "s", "a", '{"text": "the good of the day is in it"}'), (2, "s", "b", '{"text": ""}'),
        (3, "s", "c", '{"text": "der die und das ist nicht"}'), (4, "s", None, '{"text": "the best of all and to it"}')],
        "id long, source string, source_id string, payload string").withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp"))
    routed = RE.route_events(df).persist()
    assert {r.id: r.route for r in routed.collect()} == {1: "result", 2: "dead_letter", 3: "skipped_language", 4: "dead_letter"}
    letters = {r.event_id: r for r in RE.dead_letters(routed, "2024-01-02").collect()}
    assert letters["2"].processing_component == RE.STAGE_INPUT and letters["4"].processing_component == RE.STAGE_SAVE
    assert letters["4"].source_id == "unknown"
    row = RE.result_rows(routed, "2024-01-02").collect()[0]
    assert row.sentiment_score == row.confidence and set(row.sentiment_scores_json) == set(SC.LABELS)
    assert batch_outcome(routed).collect()[0].asDict() == {"attempted": 4, "succeeded": 2, "failed": 2}


def test_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "p string, y string")
    rows = {r.label: r for r in SC.confusion(df, "p", "y").collect()}
    assert (rows["b"].precision, round(rows["b"].recall, 6)) == (1.0, round(2 / 3, 6))
    assert rows["c"].recall is None and rows["c"].precision == 0.0


def test_a_failing_batch_is_tried_in_halves():
    """One text that cannot be scored costs a few more calls, not one for every other text."""
    calls = []

    class Counting(SC.BreakingScorer):
        def score(self, texts):
            calls.append(len(texts))
            return super().score(texts)

    texts = [f"good number {i}" for i in range(500)] + [SC.BROKEN]
    got = SC._scored(Counting(), texts, None, 1 << 20)
    assert [t for t in texts if got[t][3]] == [SC.BROKEN] and all(abs(sum(got[t][:3]) - 1) < 1e-9 for t in texts[:-1])
    assert len(calls) < 25
