"""Sentiment scoring: a native default and a plug-in interface for models."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.binding import let
from tidelex.functions.wordlists import LEXICON
from tidelex.operators.text import among, is_blank, letter_runs, plain_blanks, preprocess, text_slices

# Workers get this module's functions and classes by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABELS = ("positive", "negative", "neutral")
MODEL_VERSION = "lexicon-1"
# Label boundary and damping of the compound score.
BOUNDARY = 0.05
COMPOUND_DAMPING = 15.0


def with_weights(df: DataFrame, text: str, lexicon: dict[str, float] = LEXICON,
                 words: str | None = None) -> DataFrame:
    """Add _pos and _neg (summed weights of lexicon words) and _words (number of tokens).

    ``words`` names an array of lower-cased words to use in place of the text.
    """
    weights = F.str_to_map(F.lit("|".join(f"{w}={v}" for w, v in lexicon.items())), F.lit("[|]"), F.lit("="))
    if words is None:
        runs = letter_runs(F.col(text))
        count = F.size(F.filter(F.split(plain_blanks(F.col(text)), r"\s+"), lambda t: t != ""))
    else:
        runs = F.col(words)
        count = F.coalesce(F.size(words), F.lit(0))
    found = F.transform(among(runs, sorted(lexicon)), lambda w: F.try_element_at(weights, w).cast("double"))

    def total(values: Column, sign: int) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.greatest(v * sign, F.lit(0.0)))

    sums = let(found, lambda values: F.struct(total(values, 1).alias("pos"), total(values, -1).alias("neg")))
    return df.withColumns({"_words": count, "_sums": sums}).withColumns({
        "_pos": F.coalesce("_sums.pos", F.lit(0.0)), "_neg": F.coalesce("_sums.neg", F.lit(0.0))}).drop("_sums")


def with_compound(df: DataFrame, text: str, lexicon: dict[str, float] = LEXICON,
                  boundary: float = BOUNDARY) -> DataFrame:
    """Compound score in -1..1, shares of positive, negative and other words, and the label."""
    df = with_weights(df, text, lexicon)
    total = F.col("_pos") - F.col("_neg")
    df = df.withColumn("compound", total / F.sqrt(total * total + COMPOUND_DAMPING))
    mass = F.col("_pos") + F.col("_neg") + F.col("_words")
    for name, part in (("pos_share", F.col("_pos")), ("neg_share", F.col("_neg")),
                       ("neu_share", F.col("_words"))):
        df = df.withColumn(name, F.when(mass > 0, part / mass).otherwise(F.lit(0.0)))
    label = (F.when(F.col("compound") >= boundary, F.lit("positive"))
             .when(F.col("compound") <= -boundary, F.lit("negative")).otherwise(F.lit("neutral")))
    return df.withColumn("compound_label", label).drop("_pos", "_neg", "_words")


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    shifted = let(logits, lambda values: let(F.array_max(values), lambda top: F.transform(
        values, lambda v: F.exp(v - top))))
    return let(shifted, lambda exps: let(
        F.aggregate(exps, F.lit(0.0), lambda acc, e: acc + e), lambda mass: F.transform(exps, lambda e: e / mass)))


def with_softmax(df: DataFrame, logits: Column, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Add one probability per label, and the first largest one as label and confidence."""
    names = F.array(*[F.lit(lab) for lab in labels])
    df = df.withColumn("_p", softmax(logits)).withColumn("confidence", F.array_max("_p"))
    df = df.withColumn("label", F.element_at(names, F.array_position(F.col("_p"), F.col("confidence")).cast("int")))
    return df.withColumns({f"p_{lab}": F.col("_p")[i] for i, lab in enumerate(labels)}).drop("_p")


def classify(df: DataFrame, text: str, lexicon: dict[str, float] = LEXICON,
             words: str | None = None) -> DataFrame:
    """Default classifier: label, confidence, one probability per label, model_version.

    The logits are the positive and the negative weight per square root of the
    word count, with 1 for neutral; blank text is neutral with confidence 1.
    """
    blank = is_blank(F.col(text))
    df = with_weights(df, text, lexicon, words)
    scale = F.sqrt(F.greatest(F.col("_words"), F.lit(1)).cast("double"))
    # A blank text gets logits that leave all the mass on the neutral label.
    logit = lambda weight: F.when(blank, F.lit(-1e4)).otherwise(F.col(weight) * 4 / scale)
    df = with_softmax(df, F.array(logit("_pos"), logit("_neg"), F.lit(1.0)))
    return df.withColumn("model_version", F.lit(MODEL_VERSION)).drop("_pos", "_neg", "_words")


class Scorer(Protocol):
    """A model: one row of probabilities per text, columns named after ``LABELS``."""

    version: str

    def score(self, texts: pd.Series) -> pd.DataFrame: ...


class KeywordScorer:
    """Small sample model: counts lexicon words of each sign."""

    version = "keyword-1"

    def __init__(self, lexicon: dict[str, float] | None = None):
        self.lexicon = lexicon or LEXICON

    def score(self, texts: pd.Series) -> pd.DataFrame:
        texts = texts.reset_index(drop=True)
        weights = texts.str.lower().str.split().explode().map(self.lexicon).fillna(0.0)
        sums = [part.groupby(level=0).sum().to_numpy() for part in (weights.clip(lower=0), -weights.clip(upper=0))]
        logits = np.stack([*sums, np.ones(len(texts))], axis=1)
        exps = np.exp(logits - logits.max(axis=1, keepdims=True))
        return pd.DataFrame(exps / exps.sum(axis=1, keepdims=True), columns=list(LABELS))


#: A text that the sample model below cannot score.
BROKEN = "broken item"


class BreakingScorer(KeywordScorer):
    """Sample model with a defect: fails on every batch that holds a certain text."""

    def score(self, texts: pd.Series) -> pd.DataFrame:
        if (texts == BROKEN).any():
            raise ValueError("this text cannot be scored")
        return super().score(texts)


SCORED = "p_positive double, p_negative double, p_neutral double, error string, version string"


def pieces_of(text: str, cap: int | None) -> list[str]:
    """A text in pieces of at most ``cap`` characters, cut at the last blank of a piece where there is one."""
    out = []
    while cap and len(text) > cap:
        at = text.rfind(" ", 1, cap + 1)
        at = at if at > 0 else cap
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


def _scored(scorer: Scorer, texts: list[str], cap: int | None, filled: int) -> dict[str, tuple]:
    """Probabilities or the error of each text. Pieces go to the model in batches of about ``filled`` characters,
    shorter ones first; those of a text count by their length. A failing batch is tried in halves, down to single pieces."""
    parts = sorted(((t, p) for t in texts for p in pieces_of(t, cap) if p.strip()), key=lambda x: (len(x[1]), x[1]))
    held: dict[str, list] = {t: [np.zeros(len(LABELS)), 0, None] for t in texts}

    def add(batch: list[tuple[str, str]], probs: np.ndarray) -> None:
        for (text, piece), p in zip(batch, probs, strict=True):
            held[text][0] += len(piece) * p
            held[text][1] += len(piece)

    def score(batch: list[tuple[str, str]]) -> np.ndarray:
        return scorer.score(pd.Series([p for _, p in batch]))[list(LABELS)].to_numpy()

    lo = 0
    while lo < len(parts):
        hi, size = lo, 0
        while hi < len(parts) and (hi == lo or size + len(parts[hi][1]) <= filled):
            size += len(parts[hi][1])
            hi += 1
        waiting = [parts[lo:hi]]
        while waiting:
            batch = waiting.pop()
            try:
                add(batch, score(batch))
            except Exception as err:  # noqa: BLE001 - any model error becomes a retry of both halves, down to single pieces
                if len(batch) == 1:
                    held[batch[0][0]][2] = str(err)
                else:
                    half = len(batch) // 2
                    waiting += [batch[half:], batch[:half]]
        lo = hi
    return {t: (*(p / max(n, 1)), error) for t, (p, n, error) in held.items()}


def model_scores(text: Column, make_scorer: Callable[[], Scorer], cap: int | None = None, filled: int = 1 << 20) -> Column:
    """Struct of probabilities, error and model version for a text column; only texts go through Arrow.

    Equal texts of a slice of a batch are scored once. A text longer than ``cap`` characters is
    scored in pieces, whose probabilities are joined by their lengths into one
    score. Blank text is not sent to the model.
    """
    @F.pandas_udf(SCORED)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for texts in (part for batch in batches for part in text_slices(batch, 4 * filled)):
            found = _scored(scorer, [t for t in texts.unique() if t.strip()], cap, filled)
            rows = [found.get(t, (*(float(x == "neutral") for x in LABELS), None)) for t in texts]
            out = pd.DataFrame(rows, columns=[*(f"p_{x}" for x in LABELS), "error"])
            out["version"] = scorer.version
            yield out[["p_positive", "p_negative", "p_neutral", "error", "version"]]
    return score(text)


def classify_with_model(df: DataFrame, text: str, make_scorer: Callable[[], Scorer], cap: int | None = None) -> DataFrame:
    """Score with a plug-in model, in Arrow batches, one model per task; every text has one score, whatever its length.

    Blank text is neutral with confidence 1. A text of which a piece fails is
    neutral with confidence 0 and its error is kept. Other columns stay in the JVM.
    """
    scored = df.withColumn("_model", model_scores(F.col(text), make_scorer, cap))
    failed = F.col("_model.error").isNotNull()
    probs = {lab: F.when(failed, 0.0).otherwise(F.col(f"_model.p_{lab}")) for lab in LABELS}
    best = F.greatest(*probs.values())
    label = F.lit(LABELS[-1])
    for lab in reversed(LABELS):
        label = F.when(probs[lab] == best, lab).otherwise(label)
    return scored.withColumns({
        "label": F.when(failed, F.lit("neutral")).otherwise(label), "confidence": F.when(failed, 0.0).otherwise(best),
        **{f"p_{lab}": probs[lab] for lab in ("positive", "negative", "neutral")},
        "model_version": F.col("_model.version"), "score_error": F.col("_model.error")}).drop("_model")


def bulk_analyze(df: DataFrame, text: str, make_scorer: Callable[[], Scorer] = KeywordScorer) -> DataFrame:
    """One output per input; a failed item has label ``error`` and confidence 0."""
    scored = classify_with_model(df, text, make_scorer)
    failed = F.col("score_error").isNotNull()
    return (scored.withColumn("label", F.when(failed, F.lit("error")).otherwise(F.col("label")))
            .withColumn("p_error", F.when(failed, F.lit(1.0)).otherwise(F.lit(0.0)))
            .drop("score_error"))


def analyze_text(df: DataFrame, text: str) -> DataFrame:
    """Clean and classify each text. A foreign language does not stop the scoring."""
    cleaned = preprocess(df, text).withColumn(
        "scored_text", F.coalesce(F.nullif(F.col("cleaned_text"), F.lit("")), F.col(text)))
    return classify(cleaned, "scored_text")


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Precision, recall and F1 per label, from one count per (actual, predicted) pair."""
    pairs = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).groupBy(
        F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.lit("actual").alias("side"), "n",
                 (F.col("actual") == F.col("predicted")).alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit("predicted").alias("side"), "n",
                 (F.col("actual") == F.col("predicted")).alias("hit")))).alias("s")).select("s.*")
    counts = sides.groupBy("label").agg(
        F.coalesce(F.sum(F.when((F.col("side") == "actual") & F.col("hit"), F.col("n"))), F.lit(0)).alias("true_positive"),
        F.coalesce(F.sum(F.when(F.col("side") == "predicted", F.col("n"))), F.lit(0)).alias("predicted_n"),
        F.coalesce(F.sum(F.when(F.col("side") == "actual", F.col("n"))), F.lit(0)).alias("actual_n"))
    return (counts.withColumn("precision", F.try_divide("true_positive", "predicted_n"))
            .withColumn("recall", F.try_divide("true_positive", "actual_n"))
            .withColumn("f1", F.try_divide(2 * F.col("true_positive"),
                                           F.col("predicted_n") + F.col("actual_n"))))
