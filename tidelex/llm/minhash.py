"""Near-duplicate groups by b-bit MinHash.

Documents with equal shingle sets form classes first, by an aggregate. The
smallest document of a class carries its signature: ``bands * rows`` minima, of
which bands of full minima make candidates and only the low ``bits`` bits are
kept, packed, to estimate the similarity by bit counts with the chance
agreement taken out. Every candidate that may reach the threshold is confirmed
on the full shingle sets.

Candidates of a band value are checked against its smallest document first,
which links nearly everything without looking at pairs. Only where a band value
still holds several components are its other pairs looked at, in blocks and
only across components, so no link is lost and a group of copies costs one
check per member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import (LOWER, chunks, giving_back, hash_spans, id_and_text, mix64, packed_texts, partitions,
                                random_numbers, rolling, words_of)
from tidelex.llm.graph import components, stored

SHINGLE = 5
THRESHOLD = 80
BANDS, ROWS = 40, 5
BITS = 4
#: A pair is confirmed unless its estimate is this far below the threshold: six standard deviations.
MARGIN = 0.18
#: Documents of one band value that are compared in one task, and shingles held for it.
BLOCK = 2048
HELD_SHINGLES = 1 << 20
_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands binary, sig binary"


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, text after text, and their bounds.

    A text with fewer words than ``width``, but some, has one shingle of all of them.
    """
    buf = LOWER[buf]
    words = words_of(buf, off)
    counts = words.counts
    hashed = hash_spans(buf, words.start, words.end)
    at, per = words.windows(width)
    owner = np.repeat(np.arange(len(counts)), per)
    found = rolling(hashed, width)[at]
    for few in range(1, width):
        short = np.flatnonzero(counts == few)
        if len(short):
            owner = np.concatenate((owner, short))
            found = np.concatenate((found, mix64(rolling(hashed, few)[words.per[short]] + np.uint64(few))))
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    if len(found):
        fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])))
        owner, found = owner[fresh], found[fresh]
    return found, np.searchsorted(owner, np.arange(len(counts) + 1))


@giving_back
def signatures(batches, width: int, bands: int, rows: int, bits: int):
    """Per document: set size, a 128-bit hash of the set, band values and packed low bits."""
    scale = random_numbers(bands * rows, 21) | np.uint64(1)
    shift = random_numbers(bands * rows, 22)
    seeds = random_numbers(bands, 23)
    for chunk in chunks(batches):
        found, bounds = shingle_sets(chunk.buf, chunk.off, width)
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        start = bounds[:-1][full]
        sums = np.zeros((2, len(chunk)), dtype=np.uint64)
        band = np.zeros((len(chunk), bands), dtype=np.uint64)
        low = np.zeros((len(chunk), bands * rows), dtype=np.uint8)
        if len(full):
            for i in range(2):
                sums[i, full] = np.add.reduceat(mix64(found ^ np.uint64(i + 1)), start)
            for b in range(bands):
                value = np.full(len(full), seeds[b])
                for j in range(b * rows, (b + 1) * rows):
                    least = mix64(np.minimum.reduceat(found * scale[j] + shift[j], start))
                    low[full, j] = (least & np.uint64((1 << bits) - 1)).astype(np.uint8)
                    value = mix64(value ^ least)
                band[full, b] = value
        planes = np.packbits(((low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1).reshape(len(chunk), -1), axis=1)
        yield pa.RecordBatch.from_arrays(
            [chunk.rows.column("doc_id"), pa.array(size, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
             pa.array([b.tobytes() for b in band], pa.binary()), pa.array([p.tobytes() for p in planes], pa.binary())],
            ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sig"])


def estimate(left: np.ndarray, right: np.ndarray, count: int, bits: int) -> np.ndarray:
    """Similarity of rows of packed signatures, corrected for low bits that agree by chance."""
    x = left ^ right
    if bits == 4:
        unequal = ((x & 0xF0) != 0).sum(axis=-1) + ((x & 0x0F) != 0).sum(axis=-1)
    else:
        planes = np.unpackbits(x, axis=-1)[..., :count * bits]
        unequal = planes.reshape(*planes.shape[:-1], count, bits).any(axis=-1).sum(axis=-1)
    chance = 2.0 ** -bits
    return ((1 - unequal / count) - chance) / (1 - chance)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


@giving_back
def likely(batches, count: int, bits: int, least: float):
    """Candidate pairs whose estimated similarity is not clearly too low."""
    for batch in batches:
        if batch.num_rows:
            near = estimate(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), count, bits) >= least
            yield batch.select(["a", "b"]).filter(pa.array(near))


@giving_back
def linked(batches, width: int, threshold: int):
    """Pairs whose full shingle sets are similar enough."""
    import zstandard
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        lo, held, sides = 0, 0, ([], [])
        for i in range(batch.num_rows):
            for side, name in zip(sides, ("text_a", "text_b"), strict=True):
                value = batch.column(name)[i]
                side.append(press.decompress(value.as_buffer()) if value.is_valid else b"")
                held += len(side[-1])
            if held >= 2 << 20 or i == batch.num_rows - 1:
                sets = []
                for side in sides:
                    off = np.concatenate(([0], np.cumsum([len(t) for t in side])))
                    sets.append(shingle_sets(np.frombuffer(b"".join(side), dtype=np.uint8), off, width))
                pair = np.concatenate([np.repeat(np.arange(len(b) - 1), np.diff(b)) for _, b in sets])
                value = np.concatenate([v for v, _ in sets])
                order = np.lexsort((value, pair))
                pair, value = pair[order], value[order]
                same = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
                both = np.bincount(pair[1:][same], minlength=len(sides[0]))
                union = np.diff(sets[0][1]) + np.diff(sets[1][1]) - both
                yield batch.select(["a", "b"]).slice(lo, i + 1 - lo).filter(
                    pa.array((union > 0) & (100 * both >= threshold * union)))
                lo, held, sides = i + 1, 0, ([], [])


class Block:
    """The documents of a block pair of one band value, and the links between its components.

    A pair is looked at in the first band that it shares only, and no longer
    once other links have joined its components.
    """

    def __init__(self, rows: pa.RecordBatch, count: int, bits: int, least: float, width: int, threshold: int):
        self.doc, self.label, self.side, self.size = (
            rows.column(n).to_numpy().copy() for n in ("doc_id", "label", "side", "n_shingles"))
        self.sig, self.bands = _matrix(rows.column("sig")), _matrix(rows.column("bands")).view("<u8")
        self.band = rows.column("band")[0].as_py()
        self.packed, self.diagonal = rows.column("packed"), rows.column("g")[0] == rows.column("h")[0]
        self.count, self.bits, self.least, self.width, self.threshold = count, bits, least, width, threshold

    def likely(self, i: int) -> np.ndarray:
        """Documents of other components that may be similar enough to document ``i``."""
        if self.diagonal:
            others = np.arange(i + 1, len(self.doc))
        else:
            others = np.flatnonzero(self.side == 1) if self.side[i] == 0 else np.empty(0, dtype=np.int64)
        others = others[(self.label[others] != self.label[i])
                        & (100 * np.minimum(self.size[others], self.size[i]) >= self.threshold * np.maximum(self.size[others], self.size[i]))]
        others = others[estimate(self.sig[others], self.sig[i], self.count, self.bits) >= self.least]
        return others[(self.bands[others] == self.bands[i]).argmax(axis=1) == self.band]

    def links(self):
        """Pairs (a, b) of linked documents, enough to join what links join."""
        found = [(i, others) for i in range(len(self.doc)) if len(others := self.likely(i))]
        if not found:
            return
        need = np.unique(np.concatenate([[i for i, _ in found], *(o for _, o in found)]))
        # Shingle sets of two stretches of documents are held at a time.
        stretch = np.zeros(len(self.doc), dtype=np.int64)
        stretch[need] = np.cumsum(self.size[need]) // HELD_SHINGLES
        pairs = np.concatenate([np.stack((np.full(len(o), i), o)) for i, o in found], axis=1)
        order = np.lexsort((pairs[0], stretch[pairs[1]], stretch[pairs[0]]))
        held: dict[int, tuple] = {}
        for i, others in _grouped(pairs[:, order], stretch):
            others = others[self.label[others] != self.label[i]]
            if not len(others):
                continue
            wanted = {int(stretch[i]), int(stretch[others[0]])}
            held = {k: v for k, v in held.items() if k in wanted}
            for k in wanted - held.keys():
                held[k] = self._sets(need[stretch[need] == k])
            own, sets = self._set(held[int(stretch[i])], i), [self._set(held[int(stretch[others[0]])], j) for j in others]
            size = np.array([len(x) for x in sets])
            flat = np.concatenate(sets)
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(size) - size)
            for j in others[100 * both >= self.threshold * (size + len(own) - both)]:
                yield min(self.doc[i], self.doc[j]), max(self.doc[i], self.doc[j])
                self.label[self.label == self.label[j]] = self.label[i]

    def _sets(self, rows: np.ndarray) -> tuple:
        import zstandard
        press = zstandard.ZstdDecompressor()
        texts = [press.decompress(self.packed[int(i)].as_buffer()) for i in rows]
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        return (rows, *shingle_sets(np.frombuffer(b"".join(texts), dtype=np.uint8), off, self.width))

    @staticmethod
    def _set(held: tuple, i: int) -> np.ndarray:
        rows, values, bounds = held
        at = int(np.searchsorted(rows, i))
        return values[bounds[at]:bounds[at + 1]]


def _grouped(pairs: np.ndarray, stretch: np.ndarray):
    """(i, [j]) of ordered pairs, with the j of one stretch at a time."""
    cut = np.flatnonzero(np.concatenate(([True], (pairs[0, 1:] != pairs[0, :-1]) | (stretch[pairs[1, 1:]] != stretch[pairs[1, :-1]]))))
    for a, b in zip(cut, np.append(cut[1:], pairs.shape[1]), strict=True):
        yield int(pairs[0, a]), pairs[1, a:b]


@giving_back
def across(batches, count: int, bits: int, least: float, width: int, threshold: int):
    """Links between components, block pair by block pair. Rows are sorted by (key, g, h)."""
    def out(rows):
        found = list(Block(rows, count, bits, least, width, threshold).links())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    rest = None
    for batch in batches:
        whole = pa.Table.from_batches(([rest] if rest is not None else []) + [batch]).combine_chunks()
        if not whole.num_rows:
            continue
        rows = whole.to_batches()[0]
        ids = np.stack([rows.column(n).to_numpy() for n in ("key", "g", "h")])
        cut = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0))))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield from out(rows.slice(a, b - a))
        rest = rows.slice(cut[-1])
    if rest is not None:
        yield from out(rest)


@giving_back
def band_rows(batches):
    """One (band value, document) row per band."""
    for batch in batches:
        values = _matrix(batch.column("bands")).view("<i8") if batch.num_rows else np.empty((0, 1), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(values).reshape(-1)),
             pa.array(np.repeat(batch.column("doc_id").to_numpy(), values.shape[1])),
             pa.array(np.tile(np.arange(values.shape[1], dtype=np.int32), batch.num_rows))], ["key", "doc_id", "band"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """Groups of documents whose word-shingle sets have a Jaccard similarity of ``threshold`` percent or more.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest id that links lead to) and kept (the row's id is that one).

    A pair of the threshold's similarity shares none of the 40 bands of 5 rows
    with a probability of 1.2e-7, and a more similar one more rarely still.

    Defined cases: a text without words, or a null one, has no shingles and no
    links; a row without an id has no links, no component and is kept; rows with
    one id are one document, so what links one of them links all; other columns
    are ignored; no rows give no rows. Sets are compared by 64-bit hashes.
    """
    count, least = bands * rows, threshold / 100 - MARGIN
    narrow = id_and_text(docs, id_col, text_col)
    signed = stored(narrow.mapInArrow(lambda b: signatures(b, shingle, bands, rows, bits), _SIGNED), "signed")
    same = ["set_a", "set_b", "n_shingles"]
    classes = stored(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    heads = signed.join(classes.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same], "left_semi")
    classed = stored(signed.select("doc_id", *same).join(classes, same, "left").select("doc_id", "n_shingles", "rep"), "classed")

    placed = heads.select("doc_id", "bands").mapInArrow(band_rows, "key long, doc_id long, band int")
    groups = placed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    members = stored(placed.join(groups, "key").select("key", "doc_id", "band", "first"), "members")
    asked = members.select("doc_id").distinct()
    texts = stored(packed_texts(narrow).join(asked, "doc_id", "left_semi"), "texts")
    sigs = stored(heads.join(asked, "doc_id", "left_semi").select("doc_id", "n_shingles", "sig", "bands"), "sigs")

    def side(s: str) -> DataFrame:
        return sigs.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))

    star = members.where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = (star.join(side("a"), "a").join(side("b"), "b")
            .where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b")
            .mapInArrow(lambda x: likely(x, count, bits, least), "a long, b long").distinct())
    text_a, text_b = (texts.select(F.col("doc_id").alias(s), F.col("packed").alias(f"text_{s}")) for s in "ab")
    checked = star.join(text_a, "a").join(text_b, "b").mapInArrow(lambda x: linked(x, shingle, threshold), "a long, b long")
    # Rows that share an id tie the classes they are in.
    per_id = classed.where("doc_id IS NOT NULL AND rep IS NOT NULL")
    several = per_id.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last")
    tied = per_id.join(several, "doc_id").where("rep > a").select("a", F.col("rep").alias("b"))
    edges = stored(checked.unionByName(tied).distinct(), "links")
    labels = components(edges)

    # Band values that still hold several components: the pairs across components.
    placed = (members.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left")
              .select("key", "doc_id", "band", F.coalesce("label", "doc_id").alias("label")))
    open_ = (placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
             .where("low < high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = (placed.join(open_, "key").join(sigs, "doc_id").join(texts, "doc_id")
             .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("block", "other").alias("g"), F.greatest("block", "other").alias("h"), "doc_id", "label", "band",
                     (F.col("block") > F.col("other")).cast("int").alias("side"), "n_shingles", "sig", "bands", "packed"))
    more = stored(dealt.repartition(partitions(docs), "key", "g", "h").sortWithinPartitions("key", "g", "h")
                  .mapInArrow(lambda x: across(x, count, bits, least, shingle, threshold), "a long, b long").distinct(), "more")
    if more.limit(1).count():
        labels = components(edges.unionByName(more))

    return (classed.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
