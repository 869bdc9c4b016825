"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Spark. The trees are fitted to a
bounded sample of labelled rows; a fitted model is a few flat arrays, and all rows
of a batch walk down a tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import SPACED, chunks, hash_spans, id_and_text, words_of
from tidelex.llm.quality import per_text, repeated, statistics

#: Labelled rows that a model is fitted to, at most; chosen by a hash of the id.
SAMPLE_ROWS = 40_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 4, 0.15, 64, 10, 1.0
POSITIVE = 0.3
FEATURES = ("words", "chars", "word_length", "symbols", "upper", "digits", "marks", "exclamations", "bars", "dup_lines",
            "repeat_words", "distinct_words", "wide", "space", "lines", "longest_word", "capitals", "sentence_ends")


def _flags(*codes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(codes)] = True
    return out


_UPPER, _DIGIT, _WIDE = _flags(*range(65, 91)), _flags(*range(48, 58)), _flags(*range(128, 256))
_MARK = ~(_UPPER | _flags(*range(97, 123)) | _DIGIT | _WIDE) & SPACED
_STOP = _flags(*b".!?")


def features(chunk) -> np.ndarray:
    """Statistics of every text of a chunk (rows by FEATURES); an empty text has only zeros."""
    buf, off = chunk.buf, chunk.off
    words = words_of(buf, off)
    hashed = hash_spans(buf, words.start, words.end)
    base = statistics(chunk, words, hashed)
    owner = np.repeat(np.arange(len(chunk)), words.counts)
    again, _ = repeated(owner, hashed)
    n, size = np.maximum(words.counts, 1), np.maximum(np.diff(off), 1)
    longest = np.zeros(len(chunk))
    np.maximum.at(longest, owner, (words.end - words.start).astype(float))
    lines = per_text(buf == 10, off)
    out = np.stack([
        np.log1p(words.counts), np.log1p(np.diff(off)), base["word_chars"] / n, base["n_symbols"] / n,
        per_text(_UPPER[buf], off) / size, per_text(_DIGIT[buf], off) / size, per_text(_MARK[buf], off) / size,
        per_text(buf == 33, off) / n, per_text(buf == 124, off) / n, base["n_dup_lines"] / np.maximum(lines + 1, 1) * (words.counts > 0),
        base["n_repeat_words"] / n, (words.counts - per_text(again, words.per)) / n, per_text(_WIDE[buf], off) / size,
        per_text(~SPACED[buf], off) / size, lines / n, np.log1p(longest), per_text(_UPPER[buf[words.start]], words.per) / n,
        per_text(_STOP[buf[words.end - 1]], words.per) / n], axis=1)
    return out.astype(np.float32)


@dataclass
class Trees:
    """Trees as flat arrays: a node sends a row left if its feature is at most the limit; a leaf points at itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosted trees for labels 0 and 1 by the logistic loss; without rows the score is one half."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "limit", "left", "right", "value")}
    roots: list[int] = []

    def node(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("limit", 0.0), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        width = bins
        flat = binned + np.arange(x.shape[1]) * width
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            slope, curve = p - y, p * (1 - p)

            def grow(rows: np.ndarray, level: int, slope=slope, curve=curve) -> int:
                g, h = slope[rows].sum(), curve[rows].sum()
                at = node(-rate * g / (h + RIDGE))
                if level == depth or len(rows) < 2 * LEAST_ROWS:
                    return at
                cells = flat[rows].reshape(-1)
                size = width * x.shape[1]
                gs, hs, ns = (np.bincount(cells, weights=None if w is None else np.repeat(w[rows], x.shape[1]), minlength=size)
                              .reshape(-1, width).cumsum(axis=1) for w in (slope, curve, None))
                gain = gs**2 / (hs + RIDGE) + (g - gs)**2 / (h - hs + RIDGE) - g**2 / (h + RIDGE)
                gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = 0
                f, b = divmod(int(gain.argmax()), width)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    return at
                low = binned[rows, f] <= b
                nodes["feature"][at], nodes["limit"][at] = f, float(edges[f][b])
                nodes["left"][at], nodes["right"][at] = grow(rows[low], level + 1), grow(rows[~low], level + 1)
                return at

            roots.append(grow(np.arange(len(y)), 0))
            made = Trees(0.0, np.array(roots[-1:]), *(np.array(nodes[k]) for k in ("feature", "limit", "left", "right", "value")), depth)
            margin += made.margin(x)
    return Trees(base, np.array(roots, dtype=np.int64), np.array(nodes["feature"], dtype=np.int64), np.array(nodes["limit"], dtype=np.float64),
                 np.array(nodes["left"], dtype=np.int64), np.array(nodes["right"], dtype=np.int64), np.array(nodes["value"], dtype=np.float64), depth)


def described(batches):
    for chunk in chunks(batches):
        values = features(chunk)
        flat = pa.array(values.reshape(-1))
        yield pa.RecordBatch.from_arrays(
            [chunk.rows.column("doc_id"), chunk.rows.column("label"), chunk.rows.column("text_key"),
             pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)],
            ["doc_id", "label", "text_key", "x"])


def graded(batches, model: Trees, positive: float):
    for chunk in chunks(batches):
        score = model.score(features(chunk).astype(np.float64))
        yield pa.RecordBatch.from_arrays([chunk.rows.column("doc_id"), pa.array(score), pa.array((score >= positive).astype(np.int32))],
                                         ["doc_id", "score", "predicted"])


def held_out(doc_id):
    """Rows whose labels are never learnt from: the CRC-32 of the id's digits is divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit trees to at most ``sample_rows`` labelled documents outside the held-out rows.

    The sample is bounded, so its ids can be broadcast and its statistics (18
    numbers a row) fit on the driver. It is chosen and ordered by hashes of id and
    text, so the model does not depend on how the rows are dealt out. Of
    contradicting labels of an id the smallest counts; an id with several texts is
    one row for each, equal rows count once. Rows without an id or label are left
    out.
    """
    known = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("label"))
             .where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("label").alias("label")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = (id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
             .select("doc_id", "label", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), "text")
             .mapInArrow(described, "doc_id long, label double, text_key string, x array<float>"))
    rows = (found.dropDuplicates(["doc_id", "text_key"]).orderBy(F.xxhash64("doc_id"), "doc_id", "text_key")
            .limit(sample_rows).select("label", "x").collect())
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows]))


def quality_scores(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", positive: float = POSITIVE) -> DataFrame:
    """Score (0 to 1, higher: label 1 likelier) of every whole text, and predicted (score >= ``positive``).

    Returns doc_id, held_out, score, predicted. Defined cases: a null or empty
    text is scored by its statistics, all zero; a row without an id is scored and
    not held out; other columns are ignored; no rows give no rows; with labels of
    one kind, or none, every score is their (smoothed) share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return (id_and_text(docs, id_col, text_col).mapInArrow(lambda b: graded(b, shared.value, positive), "doc_id long, score double, predicted int")
            .select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted"))
