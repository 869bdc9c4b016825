"""Quality rules: text statistics and an n-gram likelihood ratio.

Word n-grams are hashed into a fixed number of buckets and counted twice: over
trusted documents (the target) and over all documents (the raw corpus). Every
text is counted; near copies share the weight of one text. A document's score is
the mean log ratio of its n-grams' probabilities under the two multinomials; one
below the threshold reads unlike what is trusted. Every document is scored, by
the same rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import (SPACED, Texts, Words, carried, chunks, giving_back, hash_spans, id_and_text, mix64, packed_texts,
                                partitions, random_numbers, schema_of, unpacked, words_of)
from tidelex.llm.minhash import shingle_sets

BITS = 17
#: Added to every bucket of the target, and as much, in proportion, to the raw corpus: so many times the median count
#: of the buckets that the target has, so that verdicts do not depend on how large a table is.
PRIOR = 8.0
THRESHOLD = -0.1
#: Bands of minima that find near copies.
BANDS, ROWS = 16, 5
#: Weight of a text without near copies. Weights are whole numbers, so sums do not depend on their order.
UNIT = 1 << 20
_SIGN = -1 << 63
MIN_WORDS = 50
#: Trusted ids up to this number are broadcast (about 30 MB as a hash table); more are joined by a shuffle.
BROADCAST_IDS = 500_000
_SLICE = 4096
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Flags set in every text."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[off])


def repeated(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (text, value) rows: whether an equal row came earlier, and whether there is any other equal row."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    same = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    earlier, other = np.zeros(len(o), dtype=bool), np.zeros(len(o), dtype=bool)
    earlier[order[1:][same]] = True
    other[order[1:][same]] = other[order[:-1][same]] = True
    return earlier, other


def statistics(chunk: Texts, words: Words, hashed: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    buf, off = chunk.buf, chunk.off
    inside = SPACED[buf]
    # Lines: cut at \n and at texts; those with a word are compared as a whole.
    cut = np.concatenate((np.flatnonzero(buf == 10), off[1:]))
    begin = np.concatenate((np.flatnonzero(buf == 10) + 1, off[:-1]))
    cut, begin = np.sort(cut), np.sort(begin)
    has = np.concatenate(([0], np.cumsum(inside)))
    lines = np.flatnonzero(has[cut] > has[begin]) if len(cut) else cut
    owner = np.searchsorted(off, begin[lines], side="right") - 1
    earlier, _ = repeated(owner, hash_spans(buf, begin[lines], cut[lines]))
    at, per = words.windows(3)
    row = np.repeat(np.arange(len(chunk)), per)
    _, twice = repeated(row, _ngram(hashed, at, 3))
    delta = np.zeros(len(words.start) + 4, dtype=np.int64)
    np.add.at(delta, at[twice], 1)
    np.add.at(delta, at[twice] + 3, -1)
    covered = np.cumsum(delta)[:len(words.start)] > 0
    return {"n_words": words.counts, "word_chars": per_text(inside & _LEAD[buf], off), "n_symbols": per_text(_SYMBOL[buf], off),
            "n_dup_lines": np.bincount(owner[earlier], minlength=len(chunk)), "n_repeat_words": per_text(covered, words.per)}


def _ngram(hashed: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    value = hashed[at]
    for j in range(1, n):
        value = mix64(value) + hashed[at + j]
    return mix64(value)


def buckets(words: Words, hashed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all word unigrams and bigrams of a chunk, and the text of each."""
    found, owner = [], []
    for n in (1, 2):
        at, per = words.windows(n)
        found.append((_ngram(hashed, at, n) >> np.uint64(64 - bits)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(per)), per))
    return np.concatenate(found), np.concatenate(owner)


@giving_back
def banded(batches, bands: int, rows: int):
    """Band values of every text: hashes of ``rows`` minima each over its word triples."""
    scale = random_numbers(bands * rows, 31) | np.uint64(1)
    shift = random_numbers(bands * rows, 32)
    seeds = random_numbers(bands, 33)
    for chunk in chunks(unpacked(batches)):
        found, bounds = shingle_sets(chunk.buf, chunk.off, 3)
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            continue
        start = bounds[:-1][full]
        band = np.empty((bands, len(full)), dtype=np.uint64)
        for b in range(bands):
            band[b] = seeds[b]
            for j in range(b * rows, (b + 1) * rows):
                band[b] = mix64(band[b] ^ mix64(np.minimum.reduceat(found * scale[j] + shift[j], start)))
        own = pa.array(np.tile(full, bands))
        yield pa.RecordBatch.from_arrays([chunk.rows.column("text_key").take(own), chunk.rows.column("trusted").take(own),
                                          pa.array(band.ravel().view(np.int64))], ["text_key", "trusted", "band"])


def weighted(marked: DataFrame) -> DataFrame:
    """(trusted, packed, near, near_trusted): every distinct text, with how many texts it shares its weight with.

    Equal texts become one row by an aggregate. ``near`` is the number of texts, itself included, in the fullest of a
    text's bands, ``near_trusted`` that of trusted ones: of texts that share 0.8 of their word triples two meet in a
    band with a probability of 0.998, at 0.2 once in 200. No text is left out.
    """
    distinct = marked.groupBy("text_key").agg(F.max("trusted").alias("trusted"), F.first("packed").alias("packed"))
    # Shuffled once by text, so that the bands are not computed for the count and again for the join.
    bands = distinct.mapInArrow(lambda b: banded(b, BANDS, ROWS), "text_key long NOT NULL, trusted boolean NOT NULL, band long NOT NULL").repartition("text_key")
    crowded = (bands.groupBy("band").agg(F.count("*").alias("n"), F.count_if("trusted").alias("t")).where("n > 1")
               .select(F.col("band").alias("shared"), "n", "t"))
    near = (bands.join(crowded, F.col("band") == F.col("shared")).groupBy(F.col("text_key").alias("key"))
            .agg(F.max("n").alias("near"), F.max(F.when(F.col("trusted"), F.col("t"))).alias("near_trusted")))
    return (distinct.join(near, F.col("text_key") == F.col("key"), "left")
            .select("trusted", "packed", F.coalesce("near", F.lit(1)).alias("near"),
                    F.coalesce("near_trusted", F.lit(1)).alias("near_trusted")))


def shares(among: pa.Array) -> np.ndarray:
    """Weight of a text that shares with so many; a text always counts, in a group of more than ``UNIT`` by the least weight."""
    return np.maximum(UNIT // among.to_numpy(zero_copy_only=False), 1).astype(np.float64)


@giving_back
def counted(batches, bits: int):
    """Per task: weighted n-gram counts of trusted and of all texts, in slices of buckets."""
    raw, target = np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
    for chunk in chunks(unpacked(batches)):
        words = words_of(chunk.buf, chunk.off)
        found, owner = buckets(words, hash_spans(chunk.buf, words.start, words.end), bits)
        # Sums of a chunk stay far below 2**53, so doubles hold them exactly.
        raw += np.bincount(found, shares(chunk.rows.column("near"))[owner], len(raw)).astype(np.int64)
        of = chunk.rows.column("trusted").to_numpy(zero_copy_only=False)[owner]
        target += np.bincount(found[of], shares(chunk.rows.column("near_trusted"))[owner[of]], len(raw)).astype(np.int64)
    if raw.any():
        yield _slices(target, raw, np.arange(0, len(raw), _SLICE))


def _slices(target: np.ndarray, raw: np.ndarray, at) -> pa.RecordBatch:
    kind = "<u4" if raw.max() < 1 << 32 else "<u8"
    rows = [(target[a:a + _SLICE].astype(kind).tobytes(), raw[a:a + _SLICE].astype(kind).tobytes()) for a in at]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(at) // _SLICE, pa.int32()), pa.array([r[0] for r in rows], pa.binary()),
                                       pa.array([r[1] for r in rows], pa.binary())], ["slice", "target", "raw"])


@giving_back
def summed(batches):
    """Counts of the slices of a partition, added up."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            size = min(_SLICE * 8, len(row["raw"]))
            kind = "<u4" if size < _SLICE * 8 else "<u8"
            held = total.setdefault(row["slice"], [np.zeros(_SLICE, dtype=np.int64), np.zeros(_SLICE, dtype=np.int64)])
            for side, name in zip(held, ("target", "raw"), strict=True):
                part = np.frombuffer(row[name], dtype=kind)
                side[:len(part)] += part.astype(np.int64)
    for at, (target, raw) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([target.astype("<u8").tobytes()], pa.binary()),
                                          pa.array([raw.astype("<u8").tobytes()], pa.binary())], ["slice", "target", "raw"])


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float) -> np.ndarray:
    """log(P target / P raw) per bucket; ``prior`` times the median of the target's counts above 0 is added to each.

    Counts that are all ``k`` times as high give the same values.
    """
    if not target.sum():
        return np.zeros(len(target), dtype=np.float32)
    added = prior * np.median(target[target > 0])
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + added) / (expected + added)).astype(np.float32)


def ratios(texts: DataFrame, bits: int, prior: float) -> np.ndarray:
    """log(P target / P raw) for every bucket; the driver receives two numbers a bucket, however large the corpus is."""
    kinds = "slice int, target binary, raw binary"
    slices = (texts.mapInArrow(lambda b: counted(b, bits), kinds)
              .repartitionById(min(partitions(texts), -(-(1 << bits) // _SLICE)), "slice").mapInArrow(summed, kinds))
    target, raw = np.zeros(1 << bits), np.zeros(1 << bits)
    for row in slices.collect():
        at = row["slice"] * _SLICE
        size = min(_SLICE, (1 << bits) - at)
        target[at:at + size] = np.frombuffer(row["target"], dtype="<u8")[:size]
        raw[at:at + size] = np.frombuffer(row["raw"], dtype="<u8")[:size]
    return log_ratios(target, raw, prior)


_SCORED = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, score double, kept boolean")


@giving_back
def scored(batches, ratio: np.ndarray, bits: int, threshold: float, keep: tuple[str, ...]):
    for chunk in chunks(batches):
        words = words_of(chunk.buf, chunk.off)
        hashed = hash_spans(chunk.buf, words.start, words.end)
        stats = statistics(chunk, words, hashed)
        found, owner = buckets(words, hashed, bits)
        total = np.bincount(owner, weights=ratio[found].astype(np.float64), minlength=len(chunk))
        score = total / np.maximum(np.bincount(owner, minlength=len(chunk)), 1)
        n = stats["n_words"]
        failed = (n < MIN_WORDS) | (100 * stats["n_repeat_words"] > 50 * n)
        more, names = carried(chunk.rows, *keep)
        yield pa.RecordBatch.from_arrays(
            [chunk.rows.column("doc_id"), *(pa.array(v, pa.int64()) for v in stats.values()), pa.array(failed),
             pa.array(score), pa.array(~failed & (score >= threshold)), *more],
            ["doc_id", *stats, "base_failed", "score", "kept", *names])


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS,
                  prior: float = PRIOR, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """Statistics, score and verdict of every document; ``trusted`` has the ids of the target documents in doc_id.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score and kept; with ``carry`` also the other columns as struct
    ``row``, and text. A document is kept if the base rules pass and its mean log
    ratio is at least ``threshold``.

    Defined cases: a null or empty text has no words and fails the base rules; a
    document without an id is scored and is part of the raw corpus, but never
    trusted; equal texts count once, as trusted if one of them is; near copies all
    count, with shares of one text's weight, the trusted ones with shares of one
    trusted text's; ids that are trusted twice count once; with no trusted document every
    score is 0; other columns are ignored; no rows give no rows.
    """
    narrow = id_and_text(docs, id_col, text_col, carry)
    keep = ("row", "text") if carry else ()
    ids = trusted.select(trusted["doc_id"].cast("long").alias("doc_id"), F.lit(True).alias("trusted")).where("doc_id IS NOT NULL").distinct()
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = packed_texts(narrow.where("text <> ''").select("doc_id", F.xxhash64("text").bitwiseAND(F.lit(~_SIGN)).alias("text_key"), "text"))
    marked = (texts.join(F.broadcast(ids) if small else ids.hint("merge"), "doc_id", "left")
              .select("text_key", F.coalesce("trusted", F.lit(False)).alias("trusted"), "packed"))
    ratio = docs.sparkSession.sparkContext.broadcast(ratios(weighted(marked), bits, prior))
    return narrow.mapInArrow(lambda b: scored(b, ratio.value, bits, threshold, keep), schema_of(_SCORED, narrow, *keep))
