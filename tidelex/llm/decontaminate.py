"""Benchmark decontamination by Wu-Manber search for many strings at once.

The strings searched for are the word windows of the benchmark, as normal bytes
with a space around every word. They are sorted into classes by length. In a
class, a table by hashed block of bytes says how far a cursor can move without
passing an occurrence; where it may not move, buckets by the hash of the last
block name the strings to compare directly. Cursors run through many stretches
of text at once, as numpy vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import ALPHANUMERIC, LOWER, binary_column, carried, chunks, gather, giving_back, id_and_text, mix64, ragged, schema_of, words_of

WINDOW = 13
#: Bytes of benchmark text that one search holds; a larger benchmark is searched in several passes.
BLOCK_BYTES = 8 << 20
#: Classes of strings by their number of bytes, and the bytes of a block in each.
CLASSES = ((48, 8), (24, 6), (12, 4), (6, 3), (3, 2))
STRETCH = 256
_TABLE_BITS = 20


def normal(buf: np.ndarray, off: np.ndarray):
    """Words of every text as bytes with a space before each and after the last.

    Returns the bytes, their bounds per text, the words' first bytes (the space
    before them) and the first word of every text.
    """
    buf = LOWER[buf]
    words = words_of(buf, off, ALPHANUMERIC)
    per = words.per
    last = per[1:][per[1:] > per[:-1]] - 1
    # A word comes with the byte before it, the last one of a text also with the byte after it; both become spaces.
    size = words.end - words.start + 1
    size[last] += 1
    edge = np.array([32], dtype=np.uint8)
    out = gather(np.concatenate((edge, buf, edge)), words.start, size)
    ends = np.concatenate(([0], np.cumsum(size)))
    out[ends[:-1]] = 32
    out[ends[last + 1] - 1] = 32
    return out, ends[per], ends[:-1], per


def equal_runs(codes: np.ndarray, width: int) -> np.ndarray:
    """A number for every ``width`` consecutive codes, equal where the codes are: lengths are doubled, then two runs overlap."""
    out, span = codes.astype(np.int64), 1
    while span < width:
        step = min(span, width - span)
        pair = out[:-step] * (int(out.max(initial=0)) + 1) + out[step:] if len(out) > step else out[:0]
        out = np.unique(pair, return_inverse=True)[1]
        span += step
    return out


class Patterns:
    """Search tables for distinct strings, each with the items it is a window of.

    Every item's normal bytes are held once, with the first byte of each word. A
    string is the number of its first word, at the first place where it stands;
    further items that have it are listed apart. That is some 14 bytes a word
    (22 if every window is in several items) and the tables of shifts and buckets,
    which grow with the strings up to 5 MB a class.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        raw = [(text or "").encode() for _, text in items]
        off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        out, _, at, per = normal(np.frombuffer(b"".join(raw), dtype=np.uint8), off)
        self.window, self.items, self.bytes, self.per = window, [i for i, _ in items], out, per
        self.at = np.append(at, len(out)).astype(np.int32 if len(out) < 1 << 31 else np.int64)
        texts = np.flatnonzero(np.diff(per))
        # Words without the space after the last one of a text.
        size = np.diff(self.at).astype(np.int64)
        size[per[texts + 1] - 1] -= 1
        codes = binary_column(gather(out, at, size), np.concatenate(([0], np.cumsum(size)))).dictionary_encode().indices.to_numpy()
        whole = np.maximum(np.diff(per) - window + 1, 0)
        words = np.repeat(per[:-1], whole) + ragged(whole)
        code = equal_runs(codes, window)[words]
        short = texts[whole[texts] == 0]
        seen: dict[bytes, int] = {}
        few = [seen.setdefault(out[at[w]:self.at[e]].tobytes(), len(seen)) for w, e in zip(per[short], per[short + 1], strict=True)]
        code = np.concatenate((code, np.array(few, dtype=np.int64) + int(code.max(initial=-1)) + 1))
        words = np.concatenate((words, per[short]))
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        strings = words[first]
        # Items beside that of the first place, once for each string.
        alike = {}
        item = np.array([alike.setdefault(i, len(alike)) for i in self.items], dtype=np.int64)
        mine, theirs = item[self._text(words)], item[self._text(strings)][which]
        other = mine != theirs
        pairs = np.unique(strings[which][other] * len(alike) + mine[other])
        self.more = np.stack(np.divmod(pairs, max(len(alike), 1))).astype(self.at.dtype)
        self.items = list(alike)
        self.item = item.astype(np.int32)
        size = self.spans(strings)[1]
        self.longest, self.classes = int(size.max(initial=0)), []
        upper = np.inf
        for least, block in CLASSES:
            own = (size >= least) & (size < upper)
            upper = least
            if own.any():
                self.classes.append(self._tables(np.sort(strings[own]), int(size[own].min()), block))

    def _text(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.per, words, side="right") - 1

    def spans(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, bytes (with the space after the last word) and words of strings."""
        end = self.per[self._text(strings) + 1]
        stop = np.minimum(strings + self.window, end)
        start = self.at[strings].astype(np.int64)
        return start, self.at[stop] - start + (stop < end), stop - strings

    def owners(self, string: int) -> list[int | None]:
        """The items that have a string as a window."""
        lo, hi = np.searchsorted(self.more[0], [string, string + 1])
        own = self.item[self._text(np.array([string]))[0]]
        return [self.items[i] for i in (own, *self.more[1][lo:hi])]

    def _tables(self, own: np.ndarray, prefix: int, block: int):
        """Shift per block hash over the first ``prefix`` bytes of the strings, and buckets by the last block."""
        steps = prefix - block + 1
        bits = min(max(10, int(16 * len(own) * steps).bit_length()), _TABLE_BITS)
        shift = np.full(1 << bits, steps, dtype=np.min_scalar_type(steps))
        at = self.at[own].astype(np.int64)
        mask = np.uint64((1 << bits) - 1)
        for j in range(steps):
            value = (_block_hash(self.bytes, at + j, block) & mask).astype(np.int64)
            # Later places are nearer to the end, so they come last and stay.
            shift[value] = steps - 1 - j
        last = (_block_hash(self.bytes, at + steps - 1, block) & mask).astype(np.int64)
        order = np.argsort(last, kind="stable")
        bucket = np.searchsorted(last[order], np.arange((1 << bits) + 1))
        return prefix, block, bits, shift, bucket.astype(np.int32), own[order].astype(self.at.dtype)


def _block_hash(data: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    value = np.zeros(len(at), dtype=np.uint64)
    for j in range(block):
        value = (value << np.uint64(8)) | data[at + j]
    return mix64(value)


def search(patterns: Patterns, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of the strings: (first byte, number of the string's first word)."""
    where, which = [], []
    padded = np.concatenate((data, np.zeros(patterns.longest, dtype=np.uint8)))
    for prefix, block, bits, shift, bucket, own in patterns.classes:
        mask = np.uint64((1 << bits) - 1)
        starts = np.arange(0, max(len(data) - prefix + 1, 0), STRETCH)
        cursor, stop = starts.copy(), np.minimum(starts + STRETCH, len(data) - prefix + 1)
        while len(cursor):
            value = (_block_hash(padded, cursor + prefix - block, block) & mask).astype(np.int64)
            move = shift[value]
            here = np.flatnonzero(move == 0)
            if len(here):
                times = bucket[value[here] + 1] - bucket[value[here]]
                at = np.repeat(cursor[here], times)
                text = own[np.repeat(bucket[value[here]], times) + ragged(times)].astype(np.int64)
                same = _equal(patterns, padded, at, text)
                where.append(at[same])
                which.append(text[same])
            cursor = cursor + np.maximum(move, 1)
            going = cursor < stop
            cursor, stop = cursor[going], stop[going]
    if not where:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(where), np.concatenate(which)


def _equal(patterns: Patterns, data: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Direct comparison, eight bytes first and the rest only where those agree."""
    same = np.ones(len(at), dtype=bool)
    alive = np.arange(len(at))
    start, size, _ = patterns.spans(text)
    done = 0
    while len(alive):
        alive = alive[size[alive] > done]
        for j in range(8):
            here = np.minimum(done + j, size[alive] - 1)
            # The space after the last word of a window is the one before the next word.
            ok = data[at[alive] + here] == patterns.bytes[start[alive] + here]
            same[alive[~ok]] = False
            alive = alive[ok]
        done += 8
    return same


@giving_back
def scan(batches, patterns: Patterns, keep: tuple[str, ...] = ()):
    """Per document: words, hit word runs (first, last + 1) and items found."""
    for chunk in chunks(batches):
        data, bounds, at, per = normal(chunk.buf, chunk.off)
        where, which = search(patterns, data)
        first = np.searchsorted(at, where)
        row = np.searchsorted(bounds, where, side="right") - 1
        n = len(at) + 1
        delta = np.bincount(first, minlength=n) - np.bincount(first + patterns.spans(which)[2], minlength=n)
        hit = np.cumsum(delta) > 0
        edge = np.zeros(n, dtype=bool)
        edge[per] = True
        before = np.concatenate(([False], hit[:-1]))
        start, end = np.flatnonzero(hit & (~before | edge)), np.flatnonzero(before & (~hit | edge))
        owner = np.searchsorted(per, start, side="right") - 1
        runs = [[] for _ in range(len(chunk))]
        for r, a, b in zip(owner, start - per[owner], end - per[owner], strict=True):
            runs[r].append({"first": int(a), "last": int(b)})
        items = [set() for _ in range(len(chunk))]
        for r, t in set(zip(row.tolist(), which.tolist(), strict=True)):
            items[r].update(patterns.owners(t))
        more, names = carried(chunk.rows, *keep)
        yield pa.RecordBatch.from_arrays(
            [chunk.rows.column("doc_id"), chunk.rows.column("row_key"), pa.array(np.diff(per), pa.int64()),
             pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
             pa.array([[None] * (None in i) + sorted(str(t) for t in i if t is not None) for i in items], pa.list_(pa.string())), *more],
            ["doc_id", "row_key", "n_words", "hits", "items", *names])


_FOUND = "doc_id long, row_key long, n_words long, hits array<struct<first:long,last:long>>, items array<string>"


@giving_back
def merged(batches):
    """Hit runs of several passes as one set of words."""
    for batch in batches:
        hits = []
        for found in batch.column("hits").to_pylist():
            held: list[dict] = []
            for run in sorted((r for part in found for r in part), key=lambda r: r["first"]):
                if held and run["first"] <= held[-1]["last"]:
                    held[-1]["last"] = max(held[-1]["last"], run["last"])
                else:
                    held.append(run)
            hits.append(held)
        at = batch.schema.get_field_index("hits")
        yield batch.set_column(at, "hits", pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))))


@giving_back
def cut_items(batches, window: int, most: int):
    """Items of more than ``most`` bytes as pieces that share all but one word of a window, so that no window is lost."""
    for chunk in chunks(batches):
        ids, texts = [], []
        for i, item in enumerate(chunk.rows.column("item_id").to_pylist()):
            raw = chunk.text(i)
            words = words_of(LOWER[np.frombuffer(raw, dtype=np.uint8)], np.array([0, len(raw)]), ALPHANUMERIC)
            first, n = 0, len(words.start)
            while n:
                last = max(int(np.searchsorted(words.end, words.start[first] + most, side="right")), first + window)
                ids.append(item)
                texts.append(raw[words.start[first]:words.end[min(last, n) - 1]].decode("utf-8"))
                if last >= n:
                    break
                first = last - window + 1
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["item_id", "text"])


def blocks_of(benchmark: DataFrame, block_bytes: int, window: int):
    """The benchmark in parts of about ``block_bytes`` of text, one at a time on the driver; repeated rows count once."""
    pieces = (benchmark.where("text IS NOT NULL").distinct()
              .mapInArrow(lambda b: cut_items(b, window, max(block_bytes // 4, 1)), "item_id long, text string"))
    size = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-int(size) // block_bytes) or 1
    for i in range(parts):
        own = pieces if parts == 1 else pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        yield [(r[0], r[1]) for r in own.orderBy("item_id", "text").collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", window: int = WINDOW, share: int = 20,
                  block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Words of documents inside a window of ``window`` words of a benchmark item.

    Returns one row per row of ``docs``: doc_id, row_key, n_words, n_hit, hits
    (runs of hit words), items (ids with a window in the document, in string
    order) and contaminated (a word is hit and ``share`` * n_hit >= n_words); with
    ``carry`` also the other columns as struct ``row``, and text.

    The search tables are broadcast for at most ``block_bytes`` of benchmark
    text; a larger benchmark is searched in one pass over the documents for each
    part, and the passes are joined by document. An item larger than a part is cut
    into pieces that overlap by all but one word of a window.

    Defined cases: a null or empty text has no words and is clean; an item with
    fewer words than a window is one window, one without words none; windows of
    items without an id are searched like others, and all such items are one null,
    the first of items; items with one id count once; rows without an id are
    searched like others; other columns are ignored; no rows give no rows.
    """
    keep = ("row", "text") if carry else ()
    narrow = id_and_text(docs, id_col, text_col, carry).withColumn("row_key", F.xxhash64("text"))
    kinds = schema_of(_FOUND, narrow, *keep)
    tests = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text"))
    tables = [docs.sparkSession.sparkContext.broadcast(Patterns(items, window)) for items in blocks_of(tests, block_bytes, window)]

    def one(table, *with_: str) -> DataFrame:
        return narrow.mapInArrow(lambda b: scan(b, table.value, with_), schema_of(_FOUND, narrow, *with_))

    if len(tables) == 1:
        found = one(tables[0], *keep)
    else:
        several = one(tables[0])
        for table in tables[1:]:
            several = several.unionByName(one(table))
        grouped = several.groupBy("doc_id", "row_key", "n_words").agg(
            F.collect_set("hits").alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        ordered = grouped.select(*[F.col(c).alias({"doc_id": "_id", "row_key": "_key"}.get(c, c)) for c in grouped.columns])
        verdicts = ordered.mapInArrow(merged, _FOUND.replace("doc_id", "_id").replace("row_key", "_key"))
        # Verdicts are narrow; whole rows are shuffled once, to meet theirs.
        found = (narrow.select("doc_id", "row_key", *keep)
                 .join(verdicts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")))
                 .select("doc_id", "row_key", "n_words", "hits", "items", *keep))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))

