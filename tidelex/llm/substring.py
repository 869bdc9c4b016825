"""Substring deduplication over word windows.

Every window of ``window`` words gets a Rabin-Karp hash. The hashes are counted
in one shuffle: a window that also starts in a document with a smaller id is
reported back to the later document, where overlapping windows merge into
maximal removal intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm import exchange as ex
from tidelex.llm.common import (chunks, hash_spans, id_and_text, join_words, packed_texts, partitions,
                                rolling, unpacked, words_of)

WINDOW = 13


def window_hashes(buf: np.ndarray, off: np.ndarray, width: int):
    """Words of a chunk, its windows' first words, windows per text and window hashes."""
    words = words_of(buf, off)
    at, per = words.windows(width)
    return words, at, per, rolling(hash_spans(buf, words.start, words.end), width)[at]


def offers(batches, lanes: ex.Lanes, width: int):
    """Window hashes and the documents they are in, packed per chunk."""
    for chunk in chunks(batches):
        _, _, per, hashes = window_hashes(chunk.buf, chunk.off, width)
        yield from ex.offer(hashes, np.repeat(chunk.ids(), per), lanes)


def remove(batches, width: int):
    """Cut the words that told windows cover."""
    for chunk in chunks(unpacked(batches)):
        words, at, per, hashes = window_hashes(chunk.buf, chunk.off, width)
        hit = at[ex.member_of(hashes, per, chunk.rows.column("told"))]
        size = len(words.start) + 1
        delta = np.bincount(hit, minlength=size) - np.bincount(np.minimum(hit + width, size - 1), minlength=size)
        covered = (np.cumsum(delta) > 0)[:-1]
        gone = np.concatenate(([0], np.cumsum(covered)))
        text, bounds = join_words(chunk.buf, words, ~covered)
        kept = pa.Array.from_buffers(pa.large_string(), len(chunk),
                                     [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text)])
        yield pa.RecordBatch.from_arrays(
            [chunk.rows.column("doc_id"), pa.array(words.counts, pa.int64()),
             pa.array(gone[words.per[1:]] - gone[words.per[:-1]], pa.int64()), kept.cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller id.

    Returns one row per row of ``docs``: doc_id, n_words, n_removed and kept_text
    (kept words with one space between them).

    Defined cases: a null text has no words; a text shorter than the window
    keeps all of them; a row without an id is neither searched nor a source of
    repeats and keeps its words; rows with one id are one document, so none of
    them is earlier than another; other columns are ignored; no rows give no rows.

    Windows are equal if their 64-bit hashes are.
    """
    narrow = id_and_text(docs, id_col, text_col)
    parts = partitions(docs)
    lanes = ex.Lanes(parts)
    told = (narrow.where("doc_id IS NOT NULL").mapInArrow(lambda b: offers(b, lanes, window), ex.ROW)
            .repartitionById(parts, "part").sortWithinPartitions("lane")
            .mapInArrow(lambda b: ex.judge(b, lanes), "doc_id long, hashes binary")
            .groupBy("doc_id").agg(F.collect_list("hashes").alias("told")))
    return (packed_texts(narrow).join(told, "doc_id", "left").select("doc_id", "packed", "told")
            .mapInArrow(lambda b: remove(b, window),
                        "doc_id long, n_words long, n_removed long, kept_text string"))
