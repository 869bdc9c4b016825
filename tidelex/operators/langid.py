"""Language of a text from the frequencies of its character triples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.operators.text import UNKNOWN_LANGUAGE, language_by_model

BITS = 15
#: Least probability of the best language; below it the language is unknown.
LEAST = 0.6
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def triples(text: str, bits: int = BITS) -> np.ndarray:
    """Buckets of all three neighbouring characters of a text in lower case; ends and runs of white space are one blank."""
    run = f" {' '.join(text.lower().split())} "
    points = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) < 3:
        return np.empty(0, dtype=np.int64)
    mixed = ((points[:-2] * _A) ^ points[1:-1]) * _B ^ points[2:]
    mixed = (mixed ^ (mixed >> np.uint32(15))) * _A
    return (mixed >> np.uint32(32 - bits)).astype(np.int64)


class Profiles:
    """Log shares of the buckets in each language."""

    def __init__(self, counts: dict[str, np.ndarray], bits: int = BITS, least: float = LEAST):
        self.codes, self.bits, self.least = sorted(counts), bits, least
        table = np.array([counts[c] for c in self.codes], dtype=np.float64)
        self.shares = np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * table.shape[1])).T if len(table) else np.empty((0, 0))

    def of(self, text: str) -> tuple[str, float | None]:
        """Code and probability. The triples of a text are not independent: their evidence counts a third."""
        found = triples(text, self.bits)
        if not len(found) or not self.codes or not any(c.isalpha() for c in text):
            return UNKNOWN_LANGUAGE, None
        score = sum(self.shares[found[i:i + 65_536]].sum(axis=0) for i in range(0, len(found), 65_536)) / 3
        odds = np.exp(score - score.max())
        best = int(odds.argmax())
        sure = float(odds[best] / odds.sum())
        return (self.codes[best] if sure >= self.least else UNKNOWN_LANGUAGE), sure

    def detect(self, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([self.of(t) for t in texts], columns=["code", "confidence"], index=texts.index).astype({"confidence": "float64"})


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, least: float = LEAST) -> Profiles:
    """Count the triples of whole texts by language: each task adds up its own, and the driver receives one row of
    ``2 ** bits`` numbers per language and task group. Rows without a text or a language do not count."""
    def counted(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for code, value in zip(batch["code"], batch["value"], strict=True):
                own = held.setdefault(code, np.zeros(1 << bits, np.int64))
                own += np.bincount(triples(value, bits), minlength=1 << bits)
        rows = [(code, int(b), int(own[b])) for code, own in held.items() for b in np.flatnonzero(own)]
        yield pd.DataFrame(rows, columns=["code", "bucket", "n"])

    there = docs.select(F.col(lang).alias("code"), F.col(text).alias("value")).where("code IS NOT NULL AND value IS NOT NULL")
    sums = there.mapInPandas(counted, "code string, bucket int, n long").groupBy("code", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():
        counts.setdefault(row.code, np.zeros(1 << bits))[row.bucket] = row.n
    return Profiles(counts, bits, least)


def language_by_profile(profiles: Profiles):
    """A ``detect`` for ``preprocess`` and ``route_events``: struct (code, confidence) of a text column."""
    def detect(text: Column) -> Column:
        return language_by_model(text, lambda: profiles)
    return detect

