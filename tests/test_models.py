"""Language profiles, lemma rules and scores of long texts."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelex.operators import langid as LI
from tidelex.operators import scoring as SC
from tidelex.operators import text as TX

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")
def test_profiles_beat_the_word_lists(spark):
    """Held-out accuracy over whole texts and over five words, more right and fewer unknown than by function words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL AND length(trim(text)) > 0")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    profiles = LI.fit_profiles(docs.where(~held))
    assert profiles.codes == ["de", "en", "es", "fr"]
    rest = docs.where(held)
    for texts, least in ((F.col("text"), 0.97), (F.array_join(F.slice(F.split("text", r"\s+"), 3, 5), " "), 0.8)):
        rows = rest.select("lang", texts.alias("t")).withColumn("p", LI.language_by_profile(profiles)(F.col("t"))).withColumn(
            "w", TX.language(TX.tokens_of(F.col("t")))).select("lang", F.col("p.code").alias("p"), F.col("w.code").alias("w")).toPandas()
        right, words = (rows.p == rows.lang).mean(), (rows.w == rows.lang).mean()
        assert right >= least and right >= words, (right, words)
        assert (rows.p == "unknown").mean() <= (rows.w == "unknown").mean()


def test_profiles_edge_cases(spark):
    docs = spark.createDataFrame([("the cat sat on the mat " * 20, "en"), ("der Hund und die Katze " * 20, "de"), (None, "en"), ("x", None)], "text string, lang string")
    profiles = LI.fit_profiles(docs)
    odd = ["", " ", "123 456", None, "the cat", "die Katze " * 100_000, "\ud800".encode("utf-8", "replace").decode()]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", LI.language_by_profile(profiles)(F.col("t")).alias("l")).collect()
    codes = {r.i: r.l.code for r in got}
    assert [codes[i] for i in range(4)] == ["unknown"] * 4 and codes[4] == "en" and codes[5] == "de"
    assert all(r.l.confidence is None or 0 <= r.l.confidence <= 1 for r in got)
    assert LI.fit_profiles(docs.limit(0)).of("the cat") == ("unknown", None)


def test_profiles_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(f"{w} text {i}", code) for i in range(50) for w, code in (("eins zwei", "de"), ("one two", "en"))], "text string, lang string")
    one, many = LI.fit_profiles(docs.coalesce(1)), LI.fit_profiles(docs.repartition(7))
    assert np.array_equal(one.shares, many.shares)


def test_lemma_rules(spark):
    pairs = {"running": "run", "stopped": "stop", "trading": "trad", "prices": "price", "companies": "company", "losses": "loss", "was": "be",
             "loss": "loss", "bus": "bus", "analysis": "analysis", "buying": "buy", "watches": "watch", "taxes": "tax", "increased": "increas",
             "rated": "rate", "tried": "try", "children": "child", "as": "as", "s": "s", "ing": "ing", "sing": "sing", "news": "news", "größe": "größe"}
    df = spark.createDataFrame([(w,) for w in pairs], "w string").select("w", TX.lemma(F.col("w")).alias("l"))
    assert {r.w: r.l for r in df.collect()} == pairs
    text = spark.createDataFrame([("The companies were buying shares, and Stocks fell",)], "t string")
    assert text.select(TX.rule_lemmas(F.col("t"))).first()[0] == "company buy stock fall"
    plain = TX.preprocess(text, "t", lemmatize=TX.rule_lemmas).first()
    assert plain.cleaned_text == "company buy stock fall" and plain.is_target_language


def counting():
    class Counting(SC.KeywordScorer):
        version = "counting"

        def score(self, texts: pd.Series) -> pd.DataFrame:
            if (texts.str.len() > 60).any() or texts.str.contains("boom").any():
                raise ValueError("boom")
            return super().score(texts)

    return Counting


def test_pieces_are_joined_by_length(spark):
    """A text of any length has one score: the mean of its pieces, each by its length."""
    texts = ["good " * 50, "good " * 30 + "terrible " * 30, "x" * 1000, "", None, "short", "fine boom " * 20]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)] * 2, "i int, t string, wide string").repartition(2)
    rows = SC.classify_with_model(df, "t", counting(), cap=60).collect()
    assert len(rows) == 14 and rows[0].asDict().keys() >= {"i", "t", "wide", "label", "confidence", "p_positive", "model_version", "score_error"}
    plain = SC.KeywordScorer()
    for r in rows:
        if r.i == 6:
            assert (r.label, r.confidence, r.score_error) == ("neutral", 0.0, "boom")
        elif not (r.t or "").strip():
            assert (r.label, r.confidence) == ("neutral", 1.0)
        else:
            parts = [p for p in SC.pieces_of(r.t, 60) if p.strip()]
            assert "".join(SC.pieces_of(r.t, 60)) == r.t and max(map(len, parts)) <= 60
            want = np.average(plain.score(pd.Series(parts)).to_numpy(), axis=0, weights=[len(p) for p in parts])
            assert np.allclose([r.p_positive, r.p_negative, r.p_neutral], want) and r.score_error is None


def test_only_texts_go_through_arrow(spark):
    df = spark.createDataFrame([(1, "good", "payload")], "i int, t string, wide string")
    plan = SC.classify_with_model(df, "t", SC.KeywordScorer)._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "ArrowEvalPython" in x)
    assert "wide" not in line.split("]")[0] and plan.count("ArrowEvalPython") == 1 and "MapInPandas" not in plan


def test_models_get_a_bounded_number_of_characters(spark):
    """A batch of many long texts reaches a model in runs of about a million characters, and every text comes back."""
    class Small(TX.WordFilter):
        def lemmatize(self, texts):
            if texts.str.len().sum() > (1 << 20) + 3000:
                raise MemoryError("too many characters at once")
            return super().lemmatize(texts)

    df = spark.range(0, 4000, 1, 1).select("id", F.concat(F.repeat(F.lit("word "), 500), F.lit("w"), F.lit("x")).alias("t"))
    got = df.select("id", TX.lemmas_by_model(F.col("t"), Small).alias("l")).groupBy("l").agg(F.count("*").alias("n")).collect()
    assert [(len(r.l), r.n) for r in got] == [(2502, 4000)]


def test_slices_hold_every_text():
    texts = pd.Series(["a" * n for n in (0, 5, 3, 90, 1, 1, 1, 40)] + [None])
    parts = list(TX.text_slices(texts, 10))
    assert [x for p in parts for x in p] == list(texts.fillna("")) and all(p.str.len().sum() < 10 + p.str.len().max() for p in parts)
    assert list(TX.text_slices(pd.Series([], dtype=object))) == []
