"""Token files with ids of fixed width.

A file holds the ids of consecutive documents, each in the fewest bits that the
vocabulary needs. Blocks of 4,096 ids start on byte borders and their offsets are
stored, so any range of ids is read and unpacked by itself.

Layout: 8-byte magic; header of four little-endian unsigned 32-bit numbers
(version, bits, ids per block, 0); blocks; offset of each block and the end (64
bit); document ids and, for every document and the end, its first id (64 bit);
footer of four 64-bit numbers (ids, documents, place of the block offsets, 1 if
the file's first document has no id). Missing document ids are stored as 0 and
listed first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelex.llm.bpe import encode, vocabulary
from tidelex.llm.common import binary_column, chunks, id_and_text, packed_texts, partitions, unpacked
from tidelex.llm.files import Written, opened, read_at, size_of
from tidelex.llm.graph import stored
from tidelex.llm.ship import shipped
from tidelex.session import scratch

MAGIC = b"FIXWIDTH"
BLOCK = 4096
HEAD = 24
#: Ids held while writing or reading.
HELD = 1 << 20


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of ids of ``bits`` bits each; 64 ids fill ``bits`` words, and the last group is filled up with zeros."""
    groups = -(-len(ids) // 64)
    rows = np.zeros((groups, 64), dtype=np.uint64)
    rows.reshape(-1)[:len(ids)] = ids
    words = np.zeros((groups, bits), dtype="<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return words.reshape(-1).view(np.uint8)


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes."""
    words = np.frombuffer(data, dtype="<u8").reshape(-1, bits)
    rows = np.empty((len(words), 64), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        rows[:, j] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            rows[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    rows &= np.uint64((1 << bits) - 1)
    return rows.reshape(-1)[:count].astype(np.uint32)


class TokenWriter:
    """Writes one file, block by block."""

    def __init__(self, uri: str, bits: int):
        self.out, self.bits = Written(uri), bits
        self.out.write(MAGIC + np.array([1, bits, BLOCK, 0], dtype="<u4").tobytes())
        self.at, self.offsets, self.held, self.waiting = HEAD, [], [], 0
        self.docs, self.sizes, self.n, self.missing = [], [], 0, 0

    def add(self, docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.missing += sum(d is None for d in docs)
        self.docs.append(np.array([0 if d is None else d for d in docs], dtype="<i8"))
        self.sizes.append(sizes)
        self.held.append(ids)
        self.waiting += len(ids)
        self.n += len(ids)
        if self.waiting >= HELD:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        data = pack(ids[:count], self.bits)
        step = BLOCK * self.bits // 8
        self.offsets += range(self.at, self.at + len(data), step)
        self.out.write(data.tobytes())
        self.at += len(data)
        self.held, self.waiting = [ids[count:]], len(ids) - count

    def close(self) -> None:
        self._flush(self.waiting)
        first = np.concatenate(([0], np.cumsum(np.concatenate(self.sizes)))) if self.sizes else np.zeros(1)
        with self.out as out:
            out.write(np.array([*self.offsets, self.at], dtype="<u8").tobytes())
            out.write((np.concatenate(self.docs) if self.docs else np.empty(0, "<i8")).tobytes())
            out.write(first.astype("<u8").tobytes())
            out.write(np.array([self.n, len(first) - 1, self.at, self.missing], dtype="<u8").tobytes())


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        size = size_of(uri)
        self.source = opened(uri)
        if read_at(self.source, 0, 8) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        _, self.bits, self.block, _ = np.frombuffer(read_at(self.source, 8, 16), dtype="<u4").tolist()
        self.n, docs, place, self.missing = np.frombuffer(read_at(self.source, size - 32, 32), dtype="<u8").tolist()
        blocks = -(-self.n // self.block)
        index = read_at(self.source, place, 8 * (blocks + 1) + 8 * docs + 8 * (docs + 1))
        self.offsets = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", docs, 8 * (blocks + 1))
        self.first = np.frombuffer(index, "<u8", docs + 1, 8 * (blocks + 1 + docs)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start..stop-1``; only the blocks that hold them are read."""
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        data = read_at(self.source, int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        return unpack(data, self.bits, min(b * self.block, self.n) - a * self.block)[start - a * self.block:stop - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))

    def close(self) -> None:
        self.source.close()


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, packed) in ranges of ascending ids, one per partition; rows without an id come first."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    return (packed_texts(keyed).repartitionByRange(partitions(docs), F.col("doc_id").asc_nulls_first(), "row_key")
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row_key"))


def _write(batches, tokenizer: str, folder: str, end_id: int):
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    vocab, writer = vocabulary(tokenizer, library=True), None
    uri = f"{folder}/tokens-{part:06d}.bin"
    for chunk in chunks(unpacked(batches)):
        ids, bounds = encode(chunk, vocab)
        n = len(chunk)
        place = bounds[1:] + np.arange(n)
        full = np.full(len(ids) + n, end_id, dtype=np.uint32)
        inner = np.ones(len(full), dtype=bool)
        inner[place] = False
        full[inner] = ids
        writer = writer or TokenWriter(uri, max(vocab.size - 1, end_id).bit_length())
        writer.add(chunk.rows.column("doc_id").to_pylist(), np.diff(bounds) + 1, full)
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([writer.n], pa.int64())],
                                         ["part", "uri", "n_tokens"])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Encode all texts and write them, each followed by ``end_id``, to files in ascending id order.

    Returns one row per file: part, uri, n_tokens. ``folder`` must be one that
    all executors reach; by default it is a new one below ``spark.checkpoint.dir``.

    Defined cases: a null or empty text is its end id alone; rows without an id
    come first, rows with one id in the order of their texts' hashes; other
    columns are ignored; no rows give no files.
    """
    folder = folder or scratch(docs.sparkSession, "tokens")
    narrow = id_and_text(docs, id_col, text_col)
    return stored(in_order(narrow).mapInArrow(lambda b: _write(b, tokenizer, folder, end_id),
                                              "part int, uri string, n_tokens long"), "token-files")


def _read(batches):
    for batch in batches:
        for uri, before in zip(batch.column("uri").to_pylist(), batch.column("before").to_pylist(), strict=True):
            source = TokenFile(uri)
            lo, n = 0, len(source.docs)
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(source.first, source.first[lo] + HELD, side="right")) - 1)
                bounds = source.first[lo:hi + 1]
                ids = source.ids(int(bounds[0]), int(bounds[-1]))
                own = [None if lo + i < source.missing else int(d) for i, d in enumerate(source.docs[lo:hi])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(bounds[:-1] + before, pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                     binary_column(ids.astype("<u4"), (bounds - bounds[0]) * 4).cast(pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])
                lo = hi
            source.close()


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before it), n_tokens, ids.

    Ids are little-endian unsigned 32-bit numbers. The running sum is over one
    row per file.
    """
    shipped(files.sparkSession)
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("part", "uri", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.repartitionById(partitions(files), "part").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
