"""An archive of posts in blocks, with an index from character trigrams to blocks.

A block is a range of time in one file. A term can only occur in blocks that
hold all of its trigrams; only these are read, and the texts in them are
searched as ever. Terms of fewer than three characters, and blocks whose
postings were lost with their run, are searched everywhere.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.operators.search import POST_TIME, searchable, term_search
from tidelex.session import materialize
from tidelex.sources.keyfilter import exists

# Workers get this module's functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 100_000
#: Blocks in one posting row: a trigram of every block has many rows and not one long list.
PIECE = 4096
GRAM = 3
#: Characters that are cut into trigrams at once.
_SLICE = 1 << 20


def grams(text: str) -> list[str]:
    return sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})


def block_grams(batches):
    """(block, gram): the trigrams of all texts, each once for a block and about a million characters."""
    for batch in batches:
        size = np.zeros(batch.num_rows + 1, dtype=np.int64)
        points = [np.frombuffer((t or "").encode("utf-32-le"), dtype="<u4") for t in batch.column("text").to_pylist()]
        size[1:] = np.cumsum([len(p) for p in points])
        block = batch.column("block").to_numpy(zero_copy_only=False)
        lo = 0
        while lo < len(points):
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + _SLICE, side="right")) - 1)
            found = _distinct(points[lo:hi], block[lo:hi])
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.string())], ["block", "gram"])
            lo = hi


def _distinct(points: list[np.ndarray], block: np.ndarray) -> tuple[list[int], list[str]]:
    blocks, grams_ = [], []
    for b in np.unique(block):
        own = [p for p, of in zip(points, block, strict=True) if of == b and len(p) >= GRAM]
        # Three code points of 21 bits are one number; none reaches into another text.
        coded = [np.unique(p[:-2].astype(np.int64) | p[1:-1].astype(np.int64) << 21 | p[2:].astype(np.int64) << 42) for p in own]
        if not coded:
            continue
        found = np.unique(np.concatenate(coded))
        text = np.stack([found & 0x1FFFFF, found >> 21 & 0x1FFFFF, found >> 42], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        grams_ += [text[i:i + GRAM] for i in range(0, len(text), GRAM)]
        blocks += [int(b)] * len(found)
    return blocks, grams_


def blocks_of(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all blocks, from the folder names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("block="))


def add_posts(posts: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> list[int]:
    """Write posts as new blocks in time order and index them. Returns the blocks' numbers.

    Rows are written first, then their postings, then the list of indexed blocks:
    a block that a lost run left without postings is read by every search. An
    archive is only added to by this function, one run at a time; a run that was
    lost after its rows is not repeated but completed by ``index_blocks``.
    """
    spark = posts.sparkSession
    stored = materialize(posts)
    rows = stored.count()
    if not rows:
        return []
    before = blocks_of(spark, path)
    first = before[-1] + 1 if before else 0
    n = -(-rows // block_rows)
    (stored.repartitionByRange(n, POST_TIME, "id").withColumn("block", F.spark_partition_id() + first)
     .sortWithinPartitions(POST_TIME, "id").write.mode("append").partitionBy("block").parquet(f"{path}/data"))
    new = [b for b in blocks_of(spark, path) if b >= first]
    index_blocks(spark, path, new)
    return new


def index_blocks(spark: SparkSession, path: str, blocks: list[int]) -> None:
    """Postings of some blocks. Trigrams are made distinct before they leave Python, and again per task."""
    if not blocks:
        return
    texts = read_blocks(spark, path, blocks)
    found = texts.select("block", searchable(texts).alias("text")).mapInArrow(block_grams, "block int, gram string").distinct()
    pieces = found.groupBy("gram", F.floor(F.col("block") / PIECE).alias("piece")).agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    (pieces.repartitionByRange("gram", "piece").sortWithinPartitions("gram", "piece").select("gram", "blocks")
     .write.mode("append").parquet(f"{path}/postings"))
    spark.createDataFrame([(b,) for b in blocks], "block int").coalesce(1).write.mode("append").parquet(f"{path}/indexed")


def read_blocks(spark: SparkSession, path: str, blocks: list[int]) -> DataFrame:
    """Rows of some blocks; the files of others are not opened."""
    return spark.read.parquet(f"{path}/data").where(F.col("block").isin(blocks))


def term_blocks(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(term, block): the indexed blocks that hold all trigrams of a term of three characters or more."""
    wanted = [(t, g) for t in terms for g in grams(t.lower())]
    told = spark.createDataFrame(wanted, "term string, gram string")
    need = {t: len(grams(t.lower())) for t in terms}
    needed = spark.createDataFrame(list(need.items()), "term string, need int").where("need > 0")
    if not exists(spark, f"{path}/postings"):
        return needed.select("term", F.lit(0).alias("block")).limit(0)
    postings = spark.read.schema("gram string, blocks array<int>").parquet(f"{path}/postings")
    own = postings.where(F.col("gram").isin(sorted({g for _, g in wanted})))
    held = own.join(told, "gram").select("term", "gram", F.explode("blocks").alias("block")).distinct()
    return (held.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n")).join(needed, "term")
            .where(F.col("n") == F.col("need")).select("term", "block"))


def blocks_to_read(spark: SparkSession, path: str, terms: list[str]) -> list[int]:
    """Numbers of the blocks in which one of the terms may occur: one number a block reaches the driver."""
    every = blocks_of(spark, path)
    if any(len(t) < GRAM for t in terms):
        return every
    indexed = set()
    if exists(spark, f"{path}/indexed"):
        indexed = {r[0] for r in spark.read.schema("block int").parquet(f"{path}/indexed").distinct().collect()}
    found = {r[0] for r in term_blocks(spark, path, terms).select("block").distinct().collect()}
    return [b for b in every if b in found or b not in indexed]


def indexed_search(spark: SparkSession, path: str, terms: list[str], start=None, end=None, seen: DataFrame | None = None) -> DataFrame:
    """``term_search`` over the archive that reads only blocks in which a term may occur."""
    return term_search(read_blocks(spark, path, blocks_to_read(spark, path, terms)).drop("block"), terms, start, end, seen)
