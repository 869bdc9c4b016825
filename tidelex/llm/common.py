"""Vectorised text handling shared by the corpus operators.

Texts arrive in Arrow batches and are handled as one run of UTF-8 bytes per
chunk. A chunk holds whole texts of about ``CHUNK`` bytes together, so memory
does not depend on the number of rows in a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelex.llm.ship import shipped

CHUNK = 2 << 20
BLOCK = 1 << 16
LONG_WORD = 1 << 20

_U = np.uint64
_MIX1, _MIX2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    x ^= x >> _U(31)
    return x


def random_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _STEP + _U(seed))


BYTE_VALUE = random_numbers(256, 11)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: all but the six ASCII white-space characters.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words: digits, ASCII letters of lower case and everything outside ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        made = []
        for base in (_BASE, _INVERSE):
            run = np.full(size, base, dtype=np.uint64)
            run[0] = 1
            made.append(np.multiply.accumulate(run))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def rolling(values: np.ndarray, width: int, table: np.ndarray | None = None) -> np.ndarray:
    """Rabin-Karp hashes of every ``width`` consecutive values (one per start), in blocks.

    With ``table`` the values are looked up in it first.
    """
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(count, dtype=np.uint64)
    for lo in range(0, count, BLOCK):
        hi = min(count, lo + BLOCK)
        part = values[lo:hi + width - 1]
        if table is not None:
            part = table[part]
        up, down = powers(len(part))
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up, out=prefix[1:])
        out[lo:hi] = mix64((prefix[width:] - prefix[:-width]) * down[:hi - lo])
    return out


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of ``counts``, concatenated."""
    total = int(counts.sum())
    starts = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(starts, counts)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Start of every run of equal neighbours."""
    if not len(ordered):
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


@dataclass
class Texts:
    """The whole texts of some rows as one byte run; text i is ``buf[off[i]:off[i + 1]]``."""

    rows: pa.RecordBatch
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def ids(self, column: str = "doc_id") -> np.ndarray:
        return self.rows.column(column).to_numpy(zero_copy_only=False).astype(np.int64)

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i]:self.off[i + 1]].tobytes()


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the bounds of its values; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[Texts]:
    """Cut batches into chunks of whole texts; a text longer than ``size`` is a chunk of its own.

    A null text is an empty one.
    """
    for batch in batches:
        buf, off = flat_bytes(batch.column(column))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
            hi = min(hi, n)
            yield Texts(batch.slice(lo, hi - lo), buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            lo = hi


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker waits for the next one beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``work`` over the batches of a task, which gives back what it freed when the last one is done."""
    @wraps(work)
    def task(*args, **named):
        yield from work(*args, **named)
        give_back()
    return task


@dataclass
class Words:
    """Words of a chunk: byte bounds, and the first word of every text in ``per``."""

    start: np.ndarray
    end: np.ndarray
    per: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.per)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``width`` words inside one text, and windows per text."""
        counts = np.maximum(self.counts - width + 1, 0)
        return np.repeat(self.per[:-1], counts) + ragged(counts), counts


def words_of(buf: np.ndarray, off: np.ndarray, inside: np.ndarray = SPACED) -> Words:
    """Maximal runs of bytes of ``inside``; runs never cross texts."""
    word = inside[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before = np.concatenate(([False], word[:-1]))[:len(buf)] & ~edge[:-1]
    after = np.concatenate((word[1:], [False]))[:len(buf)] & ~edge[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return Words(start, end, np.searchsorted(start, off))


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hashes of ascending, disjoint byte spans, in blocks."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        if end[i] - start[i] > LONG_WORD:
            import hashlib
            out[i] = int.from_bytes(hashlib.blake2b(buf[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        j = max(int(np.searchsorted(end, start[i] + BLOCK, side="right")), i + 1)
        lo, hi = start[i], end[j - 1]
        up, down = powers(int(hi - lo))
        prefix = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[buf[lo:hi]] * up, out=prefix[1:])
        first, last = start[i:j] - lo, end[i:j] - lo
        empty = first == last
        first = np.minimum(first, hi - lo - 1) if hi > lo else first * 0
        out[i:j] = mix64((prefix[last] - prefix[np.where(empty, last, first)]) * down[first])
        i = j
    return out


def binary_column(data: np.ndarray | bytes, bounds: np.ndarray) -> pa.Array:
    """A binary column whose value i is ``data[bounds[i]:bounds[i + 1]]``."""
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data)
    if bounds[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                     [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])


def gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after another, in blocks of about 1 MB."""
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    i, done = 0, 0
    while i < len(start):
        j = max(int(np.searchsorted(ends, done + 16 * BLOCK, side="right")), i + 1)
        if j == i + 1:
            out[done:ends[i]] = buf[start[i]:start[i] + length[i]]
        else:
            out[done:ends[j - 1]] = buf[np.repeat(start[i:j], length[i:j]) + ragged(length[i:j])]
        i, done = j, int(ends[j - 1])
    return out


def join_words(buf: np.ndarray, words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of every text with one space between them: bytes and bounds per text."""
    start, end, per = words.start, words.end, words.per
    if keep is not None:
        per = np.concatenate(([0], np.cumsum(keep)))[per]
        start, end = start[keep], end[keep]
    length = end - start + 1
    out = gather(np.concatenate((buf, np.array([32], dtype=np.uint8))), start, length)
    stops = np.cumsum(length)
    out[stops - 1] = 32
    at = np.concatenate(([0], stops))
    low, high = at[per[:-1]], at[per[1:]]
    high = np.where(high > low, high - 1, high)
    # The space after the last word of a text is cut out by copying all but those bytes.
    drop = np.zeros(len(out), dtype=bool)
    drop[at[per[1:]][per[1:] > per[:-1]] - 1] = True
    return out[~drop], np.concatenate(([0], np.cumsum(high - low)))


def id_and_text(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(doc_id long, text string) of a table, whatever its other columns are.

    With ``carry`` the other columns come along as one struct ``row`` before the text.
    """
    shipped(docs.sparkSession)
    columns = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")]
    if carry:
        others = [docs[f"`{c}`"] for c in docs.columns if c not in (id_col, text_col)]
        columns.insert(1, F.struct(*others, F.lit(True).alias("_")).alias("row"))
    return docs.select(*columns)


def carried_back(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` from rows with doc_id, row and text."""
    return found.select(*[F.col("doc_id").cast(docs.schema[c].dataType).alias(c) if c == id_col else F.col("text").alias(c)
                          if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def schema_of(ddl: str, narrow: DataFrame, *more: str) -> T.StructType:
    """Fields of ``ddl``, and those of ``narrow`` named in ``more`` where it has them."""
    return T.StructType([*T.StructType.fromDDL(ddl).fields, *(narrow.schema[c] for c in more if c in narrow.columns)])


def carried(rows: pa.RecordBatch, *names: str) -> tuple[list[pa.Array], list[str]]:
    """Columns of a batch that are there under these names."""
    there = [n for n in names if n in rows.schema.names]
    return [rows.column(n) for n in there], there


def partitions(df: DataFrame) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """Column ``text``, the last, as ``packed``: zstd-compressed before it is shuffled; null stays null."""
    *others, _ = docs.columns
    kinds = T.StructType([*(docs.schema[c] for c in others), T.StructField("packed", T.BinaryType())])

    @giving_back
    def pack(batches):
        import zstandard
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column(len(others))
            packed = pa.array([None if not t.is_valid else press.compress(t.as_buffer()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], [*others, "packed"])
    return docs.mapInArrow(pack, kinds)


def unpacked(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Replace column ``packed`` by ``text``, in batches of about ``size`` bytes of text."""
    import zstandard
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index("packed")
        texts, lo, held = [], 0, 0
        for i, value in enumerate(batch.column(at)):
            texts.append(press.decompress(value.as_buffer()) if value.is_valid else None)
            held += len(texts[-1] or b"")
            if held >= size or i == batch.num_rows - 1:
                part = batch.slice(lo, i + 1 - lo)
                yield part.set_column(at, "text", pa.array(texts, pa.large_binary()))
                texts, lo, held = [], i + 1, 0


def concat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an array<binary> column joined per row: one byte run and bounds; null is empty."""
    n = len(column)
    if column.null_count:
        column = pc.if_else(pc.is_valid(column), column, pa.scalar([], column.type))
    flat = column.flatten()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)) if n else np.empty(0, int)
    buf, off = flat_bytes(flat)
    return buf, off[np.concatenate(([0], ends)).astype(np.int64)]
