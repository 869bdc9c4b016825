"""Token counts from flat files of ids.

A flat file is ids and nothing else; a document ends with the end id. Files are
read in blocks by separate tasks, each of which finds the end ids of its block at
once. Documents that run over block borders are put together by a prefix scan over
the blocks of a file: the last end before a block, and the documents ended so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelex.llm.bpe import encode, vocabulary
from tidelex.llm.common import chunks, id_and_text, partitions
from tidelex.llm.files import Written, opened, read_at, size_of
from tidelex.llm.graph import stored
from tidelex.llm.ship import shipped
from tidelex.session import scratch

BLOCK_BYTES = 4 << 20


def _write(batches, tokenizer: str, folder: str):
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    vocab, out, position = vocabulary(tokenizer), None, 0
    end_id, kind = vocab.size, np.dtype("<u2" if vocab.size < 1 << 16 else "<u4")
    uri = f"{folder}/flat-{part:06d}.bin"
    try:
        for chunk in chunks(batches):
            ids, bounds = encode(chunk, vocab)
            n = len(chunk)
            full = np.full(len(ids) + n, end_id, dtype=kind)
            inner = np.ones(len(full), dtype=bool)
            inner[bounds[1:] + np.arange(n)] = False
            full[inner] = ids
            out = out or Written(uri)
            out.write(full.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part), pa.int32()), pa.array([None if position or i else uri for i in range(n)], pa.string()),
                 pa.array(np.arange(position, position + n), pa.int64()), chunk.rows.column("doc_id")],
                ["part", "uri", "position", "doc_id"])
            position += n
    except BaseException as error:
        if out is not None:
            out.__exit__(type(error), error, None)
        raise
    if out is not None:
        out.__exit__(None, None, None)


def write_flat(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> tuple[DataFrame, int, int]:
    """Write all texts as flat files, one for each partition of ``docs``, in the order of its rows.

    Returns the list of documents (part, position in the file, doc_id, and uri with
    the first of a file), the end id (the first that the vocabulary does not use)
    and the bytes of an id. No text is shuffled.
    """
    folder = folder or scratch(docs.sparkSession, "flat")
    listed = stored(id_and_text(docs, id_col, text_col).mapInArrow(
        lambda b: _write(b, tokenizer, folder), "part int, uri string, position long, doc_id long"), "listed")
    end_id = vocabulary(tokenizer).size
    return listed, end_id, 2 if end_id < 1 << 16 else 4


def _blocks(batches, block_bytes: int):
    for batch in batches:
        for part, uri in zip(batch.column("part").to_pylist(), batch.column("uri").to_pylist(), strict=True):
            size = size_of(uri)
            n = -(-size // block_bytes)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([uri] * n, pa.string()),
                                              pa.array(np.arange(n), pa.int64()), pa.array([size] * n, pa.int64())],
                                             ["part", "uri", "block", "size"])


def _ends(batches, end_id: int, width: int, block_bytes: int):
    for batch in batches:
        for row in batch.to_pylist():
            lo = row["block"] * block_bytes
            hi = min(lo + block_bytes, row["size"])
            source = opened(row["uri"])
            ids = np.frombuffer(read_at(source, lo, hi - lo), dtype=f"<u{width}")
            source.close()
            ends = np.flatnonzero(ids == end_id) + lo // width
            last = int(ends[-1]) if len(ends) else None
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]], pa.int32()), pa.array([row["uri"]]), pa.array([row["block"]], pa.int64()),
                 pa.array([hi // width - 1 if hi == row["size"] else None], pa.int64()), pa.array([len(ends)], pa.int64()),
                 pa.array([last], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64()))],
                ["part", "uri", "block", "file_last", "n_ends", "last_end", "ends"])


def count_tokens(files: DataFrame, end_id: int, width: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of flat files: part, uri, position (in the file), start (in the file), n_tokens (without the end id), ended.

    ``files`` has part and uri, one row per file; ``width`` is the bytes of an
    id. Ids after the last end of a file are one more document, not ended. An
    empty file has no documents; two ends in a row are an empty document.
    """
    shipped(files.sparkSession)
    block_bytes -= block_bytes % width
    n = partitions(files)
    blocks = (files.select("part", "uri").repartitionById(n, "part")
              .mapInArrow(lambda b: _blocks(b, block_bytes), "part int, uri string, block long, size long"))
    ends = stored(blocks.repartition(n, "part", "block").mapInArrow(
        lambda b: _ends(b, end_id, width, block_bytes),
        "part int, uri string, block long, file_last long, n_ends long, last_end long, ends array<long>"), "ends")
    # The prefix scan of a file is over two numbers a block; the ends stay where they are until it is joined to them.
    earlier = Window.partitionBy("part", "uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = ends.select("part", "uri", "block", F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("before"),
                       F.coalesce(F.max("last_end").over(earlier), F.lit(-1)).alias("previous"))
    scanned = ends.join(scan.hint("merge"), ["part", "uri", "block"]).select(
        "part", "uri", "before", "previous", "n_ends",
        # What follows the last end of a file is a document without an end.
        F.when(F.coalesce("last_end", "previous") < F.col("file_last"),
               F.concat("ends", F.array(F.col("file_last") + 1))).otherwise(F.col("ends")).alias("ends"))
    return (scanned.select("part", "uri", "before", "previous", "n_ends", "ends", F.posexplode("ends").alias("i", "end"))
            .select("part", "uri", (F.col("before") + F.col("i")).alias("position"),
                    (F.when(F.col("i") == 0, F.col("previous")).otherwise(F.get("ends", F.col("i") - 1)) + 1).alias("start"),
                    "end", (F.col("i") < F.col("n_ends")).alias("ended"))
            .select("part", "uri", "position", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended"))


def document_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of documents, through flat files: doc_id, part, start (in the file), n_tokens, ended.

    Defined cases: a null or empty text has no tokens; rows without an id are
    counted too; other columns are ignored; no rows give no rows.
    """
    listed, end_id, width = write_flat(docs, tokenizer, id_col=id_col, text_col=text_col)
    counted = count_tokens(listed.where("position = 0").select("part", "uri"), end_id, width)
    # Both sides have a row for each document, so neither is broadcast, however small its file is.
    return (listed.select("part", "position", "doc_id").join(counted.drop("uri").hint("merge"), ["part", "position"])
            .select("doc_id", "part", "start", "n_tokens", "ended"))
