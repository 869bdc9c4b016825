"""Importance resampling of documents towards a target text.

Features are runs of one to three words, hashed into buckets. Newlines cut texts
into lines: the features inside a line are counted once for each distinct line
and multiplied by its occurrences; runs that reach over a newline are counted in
their documents and added. A bucket's gain compares its share of the target with
that of the documents; a document's weight is the sum of its gains, and
documents are drawn without replacement by weight plus Gumbel noise from a hash
of the id.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.functions.ordering import with_row_index
from tidelex.llm.common import ALPHANUMERIC, LOWER, Texts, Words, binary_column, chunks, id_and_text, words_of
from tidelex.llm.graph import stored
from tidelex.llm.ship import shipped

BUCKETS = 10_000
SHARE = 5
SEED = 42
LEAST_WORDS = 20
#: Words up to this many bytes are hashed together, byte by byte; longer ones one by one.
TOGETHER = 64
NEWLINE = 10

_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, (_STEP >> 1) ^ np.uint32(0xEDB88320), _STEP >> 1)


def _zero_byte(crc: np.ndarray) -> np.ndarray:
    """The effect of one more byte 0 on the linear part of a CRC-32."""
    return _STEP[crc & 255] ^ (crc >> 8)


@lru_cache(maxsize=1)
def _shifts(most: int = 256) -> np.ndarray:
    """Entry (n, k, b): what byte b at place k of a CRC becomes after n bytes 0."""
    out = np.empty((most, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most):
        out[n] = _zero_byte(out[n - 1])
    return out


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs after ``n`` bytes 0: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    tables = _shifts()
    crc, left = crc.astype(np.uint32), n.copy()
    while len(left):
        now = np.minimum(left, len(tables) - 1)
        crc = (tables[now, 0, crc & 255] ^ tables[now, 1, (crc >> 8) & 255]
               ^ tables[now, 2, (crc >> 16) & 255] ^ tables[now, 3, crc >> 24])
        left = left - now
        if not left.any():
            break
    return crc


def crc_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans."""
    length = end - start
    out = np.empty(len(start), dtype=np.uint32)
    for i in np.flatnonzero(length > TOGETHER):
        out[i] = zlib.crc32(buf[start[i]:end[i]].tobytes())
    order = np.flatnonzero(length <= TOGETHER)
    order = order[np.argsort(-length[order], kind="stable")]
    at, sizes = start[order], length[order]
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    for j, k in enumerate(alive):
        state[:k] = _STEP[(state[:k] ^ buf[at[:k] + j]) & 255] ^ (state[:k] >> 8)
    out[order] = ~state
    return out


def grams(buf: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Buckets of the runs of 1, 2 and 3 words that begin at each word, as if all words followed one another."""
    word = crc_spans(buf, start, end)
    length = end - start
    spaced = shifted(np.full(len(word), zlib.crc32(b" "), dtype=np.uint32), length) ^ word
    two = shifted(word[:-1], length[1:] + 1) ^ spaced[1:]
    three = shifted(two[:-1], length[2:] + 1) ^ spaced[2:]
    return [(x % np.uint32(buckets)).astype(np.int64) for x in (word, two, three)]


def inside(buf: np.ndarray, off: np.ndarray, buckets: int):
    """Runs of words inside each text (here a line): for 1, 2 and 3 words, the text and the bucket of every run."""
    buf = LOWER[buf]
    words = words_of(buf, off, ALPHANUMERIC)
    owner = np.repeat(np.arange(len(off) - 1), words.counts)
    for k, bucket in enumerate(grams(buf, words.start, words.end, buckets)):
        same = owner[:len(bucket)] == owner[k:]
        yield owner[:len(bucket)][same], bucket[same]


def across(chunk: Texts, buckets: int) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of a chunk, and the runs of 2 and 3 words that reach over a newline: document and bucket of each."""
    buf = LOWER[chunk.buf]
    words = words_of(buf, chunk.off, ALPHANUMERIC)
    n = len(words.start)
    line = np.cumsum(buf == NEWLINE)[words.start] if n else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(chunk)), words.counts)
    begins = [np.flatnonzero((line[:-k] != line[k:]) & (owner[:-k] == owner[k:])) if n > k else np.empty(0, np.int64) for k in (1, 2)]
    # Only words of such runs are hashed.
    used = np.zeros(n + 3, dtype=bool)
    for k, at in enumerate(begins, 1):
        for j in range(k + 1):
            used[at + j] = True
    pick = np.flatnonzero(used[:n])
    place = np.cumsum(used) - 1
    found = grams(buf, words.start[pick], words.end[pick], buckets)
    return words, [(owner[at], found[k][place[at]]) for k, at in enumerate(begins, 1)]


def _totals(counts: np.ndarray):
    there = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there].astype(np.int64))], ["bucket", "n"])


def _line_counts(batches, buckets: int):
    counts = np.zeros(buckets, dtype=np.int64)
    for chunk in chunks(batches, "line"):
        times = chunk.rows.column("times").to_numpy()
        for owner, bucket in inside(chunk.buf, chunk.off, buckets):
            # Exact: a chunk's sums stay far below 2**53.
            counts += np.bincount(bucket, times[owner], buckets).astype(np.int64)
    yield from _totals(counts)


def _across_counts(batches, buckets: int):
    counts = np.zeros(buckets, dtype=np.int64)
    for chunk in chunks(batches):
        for _, bucket in across(chunk, buckets)[1]:
            counts += np.bincount(bucket, minlength=buckets)
    yield from _totals(counts)


def feature_counts(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n) of all runs of 1 to 3 words of whole texts.

    Lines are gathered by an aggregate with a map-side part, so a line that a
    third of all documents holds is one row a task.
    """
    shipped(docs.sparkSession)
    texts = docs.select(docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    kinds = "bucket int, n long"
    both = lines.mapInArrow(lambda b: _line_counts(b, buckets), kinds).unionByName(
        texts.mapInArrow(lambda b: _across_counts(b, buckets), kinds))
    return both.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the documents."""
    raw, wanted = (feature_counts(x, buckets, text_col).withColumnRenamed("n", n) for x, n in ((docs, "s"), (target, "t")))
    counted = raw.join(wanted, "bucket", "full_outer").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t")])
    # One row per bucket reaches the driver: a number fixed by the parameter.
    found = {r.bucket: (r.s, r.t) for r in counted.collect()}
    s, t = (np.array([found.get(i, (0, 0))[k] for i in range(buckets)], dtype=np.float64) for k in (0, 1))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])


def _weighed(batches, gain: np.ndarray):
    buckets = len(gain)
    for chunk in chunks(batches):
        n = len(chunk)
        words, reaching = across(chunk, buckets)
        cut = np.union1d(chunk.off, np.flatnonzero(chunk.buf == NEWLINE) + 1)
        lines = binary_column(chunk.buf, cut).dictionary_encode()
        known, off = lines.dictionary, np.zeros(len(lines.dictionary) + 1, dtype=np.int64)
        off[1:] = np.cumsum([len(x) for x in known.to_pylist()]) if len(known) else 0
        buf = np.frombuffer(b"".join(known.to_pylist()), dtype=np.uint8)
        per_line = np.zeros(len(known), dtype=np.int64)
        for owner, bucket in inside(buf, off, buckets):
            per_line += _sums(gain[bucket], np.searchsorted(owner, np.arange(len(known) + 1)))
        which = lines.indices.to_numpy()
        weight = _sums(per_line[which], np.searchsorted(cut, chunk.off))
        for owner, bucket in reaching:
            weight += _sums(gain[bucket], np.searchsorted(owner, np.arange(n + 1)))
        counts = words.counts
        features = counts + np.maximum(counts - 1, 0) + np.maximum(counts - 2, 0)
        yield pa.RecordBatch.from_arrays(
            [chunk.rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(features, pa.int64()), pa.array(weight, pa.int64())],
            ["doc_id", "n_words", "n_features", "weight"])


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
             share: int = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document with its weight, its score and, if it is drawn, its rank.

    Returns doc_id, n_words, n_features, weight, score, rank. Of the N documents
    with at least ``least_words`` words the floor(``share`` * N / 100) highest
    scores are drawn, equal scores by ascending id; rank counts them from 1 and is
    null for all others.

    The gains (one number a bucket) are broadcast. Scores are ranked by a range
    shuffle of narrow rows.

    Defined cases: a null or empty text has no features and weight 0; rows
    without an id are counted and weighed but have no score and are never drawn;
    each of several rows with one id is drawn by its own score; other columns are
    ignored; no documents give no rows, no target gives gains against an empty
    one. A very long text is worked as one chunk, in memory of some 30 times its
    bytes.
    """
    spark = docs.sparkSession
    narrow = id_and_text(docs, id_col, text_col)
    told = spark.sparkContext.broadcast(gains(docs, target, buckets, text_col))
    weighed = narrow.mapInArrow(lambda b: _weighed(b, told.value), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighed.withColumn("score", (F.col("weight") + noise).cast("long"))
                    .withColumn("may", F.col("score").isNotNull() & (F.col("n_words") >= least_words)), "weighed")
    drawn = share * scored.where("may").count() // 100
    order = [F.desc("may"), F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")]
    return with_row_index(scored, order, "_at").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_at") < drawn, F.col("_at") + 1).alias("rank"))
