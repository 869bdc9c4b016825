"""Ranked lexical search of every document for each query text.

Documents are indexed in shards of some megabytes of text: for every query term
the documents that hold it and how often. A shard is scored for one query by a
hybrid of two strategies: the postings of the rare terms are added up at once,
and their sums become one list with a bound; then that list and the long lists
of frequent terms are walked together in blocks of ascending documents, and a
list is only probed for documents that its bound can still bring among the best.
The best documents found so far carry over to the next shard of a task, so the
bound to beat rises.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelex.llm.common import ALPHANUMERIC, LOWER, binary_column, chunks, gather, id_and_text, partitions, words_of
from tidelex.llm.graph import stored

BEST = 20
#: Bytes of text of a shard.
SHARD = 8 << 20
#: Documents that are walked at once.
WALKED = 1024
#: Lists shorter than this share of a shard's documents are added up beforehand.
RARE = 1 / 16
#: Bytes of query text whose terms one index holds; more queries take several passes.
QUERY_BYTES = 8 << 20
#: First partitions of the merge of each query's candidates.
SALTS = 32


def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts, and the first term of every text."""
    buf = LOWER[buf]
    words = words_of(buf, off, ALPHANUMERIC)
    length = words.end - words.start
    return binary_column(gather(buf, words.start, length), np.concatenate(([0], np.cumsum(length)))), words.per


@dataclass
class Queries:
    """Some queries: their terms in one vocabulary, and for each query its term numbers and how often it has them."""

    vocabulary: pa.Array
    items: list[tuple[int | None, np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Queries:
        numbers: dict[bytes, int] = {}
        items = []
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            counted = Counter(_terms(raw, np.array([0, len(raw)]))[0].to_pylist())
            own = [numbers.setdefault(t, len(numbers)) for t in counted]
            items.append((item, np.array(own, dtype=np.int64), np.fromiter(counted.values(), np.int64, len(own))))
        return Queries(pa.array(list(numbers), pa.binary()), items)


_SHARD = ("n_docs long, n_terms long, terms array<int>, found array<int>, ids binary, known binary, sizes binary, places binary, times binary")


def _indexed(batches, vocabulary: pa.Array, size: int):
    """One row per shard: counts for the statistics, and the postings, ordered by term and document."""
    for chunk in chunks(batches, size=size):
        words, per = _terms(chunk.buf, chunk.off)
        n, sizes = len(chunk), np.diff(per)
        term = pc.index_in(words, value_set=vocabulary)
        there = term.is_valid().to_numpy(zero_copy_only=False)
        key = term.fill_null(0).to_numpy(zero_copy_only=False)[there].astype(np.int64) * n + np.repeat(np.arange(n), sizes)[there]
        key, times = np.unique(key, return_counts=True)
        terms, found = np.unique(key // n, return_counts=True)
        ids = chunk.rows.column("doc_id")
        blobs = [ids.fill_null(0).to_numpy().astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False), sizes.astype("<i4"),
                 (key % n).astype("<i4"), times.astype("<i4")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
             pa.array([found.astype(np.int32)], pa.list_(pa.int32())), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]],
            ["n_docs", "n_terms", "terms", "found", "ids", "known", "sizes", "places", "times"])


@dataclass
class Statistics:
    """What scores need of all documents: how many have a term, all their terms, and a weight for every query term."""

    n: int
    length: int
    weight: np.ndarray


class Shard:
    """Postings of one shard with the impact of each, and the greatest impact of each list and block of documents."""

    def __init__(self, row: dict, told: Statistics):
        self.ids, self.known = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], bool)
        self.n = len(self.ids)
        terms, found = np.asarray(row["terms"], np.int64), np.asarray(row["found"], np.int64)
        self.begin = np.zeros(len(told.weight) + 1, np.int64)
        self.count = np.zeros(len(told.weight), np.int64)
        self.begin[terms], self.count[terms] = np.cumsum(found) - found, found
        self.docs = np.frombuffer(row["places"], "<i4")
        tf = np.frombuffer(row["times"], "<i4").astype(np.int64)
        size = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        m = 75 + 25 * size * told.n // max(told.length, 1)
        weight = np.repeat(told.weight[terms], found)
        self.impact = weight * (1_000_000_000 * tf // (1000 * tf + 12 * m[self.docs]))
        self.bound = np.zeros(len(told.weight), np.int64)
        if len(terms):
            self.bound[terms] = np.maximum.reduceat(self.impact, self.begin[terms])

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a = self.begin[term]
        b = a + self.count[term]
        return self.docs[a:b], self.impact[a:b]


def _summed(shard: Shard, terms: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: documents of the rare terms with the sums of their impacts."""
    lists = [shard.postings(t) for t in terms]
    docs = np.concatenate([d for d, _ in lists])
    impact = np.concatenate([x * q for (_, x), q in zip(lists, often, strict=True)])
    order = np.argsort(docs, kind="stable")
    docs, impact = docs[order], impact[order]
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return docs[first], np.add.reduceat(impact, first)


class Best:
    """The best documents of a query so far."""

    def __init__(self, most: int):
        self.most = most
        self.score, self.doc = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """Scores below this one cannot be among the best."""
        return int(self.score[-1]) if len(self.score) == self.most else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, -score))[:self.most]
        self.score, self.doc = score[order], doc[order]


def walk(shard: Shard, terms: np.ndarray, often: np.ndarray, best: Best, walked: int = WALKED, rare: float = RARE) -> None:
    """Document at a time over the sums of the rare terms and the lists of the others, in blocks of documents.

    Lists are ordered by their bound. While the bounds of the first lists together
    stay below the score to beat, a document that only they hold cannot be among
    the best: the others give the candidates, the first are only probed for them.
    """
    there = shard.count[terms] > 0
    terms, often = terms[there], often[there]
    if not len(terms):
        return
    short = shard.count[terms] < max(rare * shard.n, 2)
    lists = [(*shard.postings(t), int(q)) for t, q in zip(terms[~short], often[~short], strict=True)]
    bounds = [int(shard.bound[t] * q) for t, q in zip(terms[~short], often[~short], strict=True)]
    if short.any():
        docs, sums = _summed(shard, terms[short], often[short])
        lists.append((docs, sums, 1))
        bounds.append(int(sums.max()))
    order = np.argsort(bounds, kind="stable")
    lists, bounds = [lists[i] for i in order], np.array(bounds, np.int64)[order]
    upto = np.cumsum(bounds)
    if upto[-1] < best.least:
        return
    edges = np.append(np.arange(0, shard.n, walked), shard.n)
    cuts = [np.searchsorted(docs, edges) for docs, _, _ in lists]
    for b in range(len(edges) - 1):
        # Lists below ``first`` cannot bring a document among the best by themselves.
        first = int(np.searchsorted(upto, best.least))
        if first == len(lists):
            return
        lo, n = edges[b], edges[b + 1] - edges[b]
        total, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        for (docs, impact, q), cut in zip(lists[first:], cuts[first:], strict=True):
            at = docs[cut[b]:cut[b + 1]] - lo
            total[at] += q * impact[cut[b]:cut[b + 1]]
            seen[at] = True
        own = np.flatnonzero(seen & shard.known[lo:lo + n])
        for j in range(first - 1, -1, -1):
            own = own[total[own] + upto[j] >= best.least]
            docs, impact, q = lists[j]
            part, values = docs[cuts[j][b]:cuts[j][b + 1]], impact[cuts[j][b]:cuts[j][b + 1]]
            if len(own) and len(part):
                at = np.minimum(np.searchsorted(part, own + lo), len(part) - 1)
                total[own] += np.where(part[at] == own + lo, q * values[at], 0)
        own = own[total[own] >= best.least]
        if len(own):
            best.add(total[own], shard.ids[own + lo])


def _searched(batches, queries: Queries, told: Statistics, most: int):
    held = [Best(most) for _ in queries.items]
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard(batch.slice(i, 1).to_pylist()[0], told)
            for best, (_, terms, often) in zip(held, queries.items, strict=True):
                walk(shard, terms, often, best)
    for at, (best, (item, _, _)) in enumerate(zip(held, queries.items, strict=True)):
        if len(best.doc):
            n = len(best.doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([at] * n, pa.int32()), pa.array([item] * n, pa.int64()), pa.array(best.doc), pa.array(best.score)],
                ["query", "item_id", "doc_id", "score"])


def _blocks(queries: DataFrame, block_bytes: int):
    """The queries in parts of about ``block_bytes`` of text, one at a time on the driver."""
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-int(size) // block_bytes) or 1
    for i in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        yield sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def _statistics(index: DataFrame, terms: int) -> Statistics:
    n, length = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n = n or 0
    held = np.zeros(terms, np.int64)
    counted = index.select(F.explode(F.arrays_zip("terms", "found")).alias("t")).groupBy("t.terms").agg(F.sum("t.found").alias("df"))
    # One row per query term: as many as the queries' block holds.
    for row in counted.toLocalIterator():
        held[row.terms] = row.df
    return Statistics(n, length or 0, np.floor(1000 * np.log((2 * n + 2) / (2 * held + 1))).astype(np.int64))


def ranked_search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  best: int = BEST, shard_bytes: int = SHARD, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``best`` documents for every row of ``queries``: item_id, rank, doc_id, score.

    Each block of at most about ``query_bytes`` of query text is one index of all
    documents over its terms, written as one row per shard; its vocabulary and
    its terms' document counts are broadcast. Shards are scored where they are;
    a task sends at most ``best`` rows a query, which are ranked in two steps.

    Defined cases: a null or empty text has no terms and is never found; a query
    without terms, or whose terms no document holds, has no rows; every row of
    queries is answered for itself, also where ids repeat or are null; documents
    without an id count in the statistics but are not returned, each of several
    rows with one id is ranked for itself; other columns are ignored. A very long
    text is a shard of its own, and one query is never divided.
    """
    spark = docs.sparkSession
    narrow = id_and_text(docs, id_col, text_col)
    asked = queries.select(queries[item_col].cast("long").alias("item_id"), queries[text_col].cast("string").alias("text"))
    found = None
    for i, rows in enumerate(_blocks(asked, query_bytes)):
        block = Queries.of(rows)
        words = spark.sparkContext.broadcast(block.vocabulary)
        index = stored(narrow.mapInArrow(lambda b, w=words: _indexed(b, w.value, shard_bytes), _SHARD), "index")
        told = spark.sparkContext.broadcast((block, _statistics(index, len(block.vocabulary))))
        part = index.select("terms", "found", "ids", "known", "sizes", "places", "times").mapInArrow(
            lambda b, t=told: _searched(b, *t.value, best), "query int, item_id long, doc_id long, score long").withColumn("block", F.lit(i))
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc("doc_id")]
    keys = ["block", "query"]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(min(SALTS, partitions(docs)))))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order))).where(F.col("rank") <= best)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    return last.select("item_id", "rank", "doc_id", "score")
