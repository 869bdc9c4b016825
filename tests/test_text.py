"""Cleaning, content resolution, language and preview."""

import json

import pytest
from pyspark.sql import functions as F

from tidelex.operators import text as TX


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


CASES = [
    ("Read https://news.site/a?b=1 before noon", "Read before noon", "read noon"),
    ("Mail desk@paper.org or call", "Mail or call", "mail call"),
    ("Rates fell; bonds, too. Gold rose!", "Rates fell; bonds, too. Gold rose!", "rates gold"),
    ("via @trader: Oil is cheap", "via Oil is cheap", "via oil cheap"),
    ("Wide     open      markets", "Wide open markets", "wide open markets"),
    ("\nLine\nafter\tline", "Line after line", "line line"),
    ("a b c\x1cd", "a b c d", "b c d"),
    ("#tag word #Ünï", "word", "word"),
    ("www.site.org x", "x", "x"),
]


def test_basic_clean_and_token_filter(spark):
    got = column(spark, [c[0] for c in CASES], TX.basic_clean)
    assert got == [c[1] for c in CASES]
    assert column(spark, got, TX.filter_tokens) == [c[2] for c in CASES]


def test_emoji_gets_its_name(spark):
    assert column(spark, ["hi \U0001F600!", "sun☀", "plain"], TX.emoji_to_name) == [
        "hi  :grinning_face: !", "sun :black_sun_with_rays: ", "plain"]


def test_clean_matches_python_on_mixed_text(spark):
    import re
    texts = ["x@y z@ @w #q http://a b\tc  d\n\n e", "@@ ## httphttp www", "é@é ñ #é_1 x", "a@b\n@c\td@ e"]

    def plain(t):
        t = re.sub(r"http\S+|www\S+|https\S+", "", t)
        for pattern in (r"\S*@\S*\s?", r"@\w+", r"#\w+"):
            t = re.sub(pattern, "", t)
        return re.sub(r"\s+", " ", t).strip()

    assert column(spark, texts, TX.basic_clean) == [plain(t) for t in texts]


def test_language(spark):
    texts = ["the cat is on the mat and it was good", "der hund und die katze", "xyzzy", "le chat est sur la table", ""]
    got = column(spark, texts, lambda t: TX.language(TX.tokens_of(t))["code"])
    assert got == ["en", "de", "unknown", "fr", "unknown"]


def test_preprocess_routes_languages(spark):
    df = spark.createDataFrame([(1, "Le Prix de l'or monte sur les marchés"), (2, "  "), (3, None), (4, "The best of the best")],
                               "i int, t string")
    rows = {r.i: r for r in TX.preprocess(df, "t").collect()}
    assert rows[1].cleaned_text == "le prix de l'or monte sur les marchés" and not rows[1].is_target_language
    for i in (2, 3):
        assert (rows[i].cleaned_text, rows[i].detected_language_code, rows[i].detected_language_confidence,
                rows[i].is_target_language) == ("", "unknown", None, True)
    assert rows[4].cleaned_text == "best of best" and rows[4].is_target_language


PAYLOADS = [
    (None, {"title": " A ", "selftext": "b", "n": 1}, "A b"),
    (None, {"text": 5, "body": "x"}, "x"),
    ("", {"message": "m"}, "m"),
    ('{"text": "inner"}', {"text": "p"}, "inner"),
    ('{"other": 1}', {"text": "p"}, "p"),
    ('{"other": 1}', {"title": "p"}, ""),
    ("[1, 2]", {"text": "p"}, "[1, 2]"),
    ("{broken", {"text": "p"}, "{broken"),
    (None, {"title": None}, ""),
    ("  ", {}, ""),
]


def test_event_text(spark):
    df = spark.createDataFrame([(i, c, json.dumps(p)) for i, (c, p, _) in enumerate(PAYLOADS)], "i int, c string, p string")
    got = [r.o for r in df.select("i", TX.event_text(F.col("c"), F.col("p")).alias("o")).orderBy("i").collect()]
    assert got == [want for _, _, want in PAYLOADS]


@pytest.mark.parametrize("text,want", [("x" * 101, "x" * 100 + "..."), ("x" * 100, "x" * 100), ("", "N/A"), (None, "N/A")])
def test_preview(spark, text, want):
    assert column(spark, [text], TX.preview) == [want]


def test_length_pieces_hold_the_whole_text(spark):
    text = "abc" * 4000
    pieces = column(spark, [text], TX.length_pieces)[0]
    assert [len(p) for p in pieces] == [5000, 5000, 2000] and "".join(pieces) == text


def test_detector_plugin(spark):
    import pandas as pd

    class Fixed:
        def detect(self, texts):
            return pd.DataFrame({"code": ["xx" if t else "unknown" for t in texts], "confidence": [0.5] * len(texts)})

    got = column(spark, ["a", None], lambda t: TX.language_by_model(t, Fixed)["code"])
    assert got == ["xx", "unknown"]


def test_short_texts_are_scored(spark):
    """A text without a function word has no known language, and is not left out for that."""
    from tidelex.operators.results import route_events
    texts = ["Great profit, bullish!", "TSLA crash scam", "NVDA earnings beat estimates"]
    events = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string").selectExpr(
        "id", "content", "'s' AS source", "'k' AS source_id", "timestamp_seconds(id) AS occurred_at", "'{}' AS payload")
    rows = route_events(events).orderBy("id").collect()
    assert [r.route for r in rows] == ["result"] * 3 and {r.detected_language_code for r in rows} == {"unknown"}
    assert [r.label for r in rows][:2] == ["positive", "negative"]


def test_plug_in_detector_and_lemmatizer(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "alpha Betas"), (2, "x gammas")], "i int, t string")
    out = TX.preprocess(df, "t", detect=lambda t: F.struct(F.when(t.contains("x"), F.lit("xx")).otherwise(F.lit("en")).alias("code"),
                                                          F.lit(1.0).alias("confidence")),
                        lemmatize=lambda t: F.regexp_replace(t, "s ?$", ""))
    assert [r.cleaned_text for r in out.orderBy("i").collect()] == ["alpha beta", "x gammas"]
