"""Compact shuffles of (64-bit key, document) pairs.

One Spark row per pair would cost several times the pair itself. Here each
chunk of texts is cut by key into lanes, and a lane is one row: keys without
their leading byte and documents as one-byte steps. All pairs of a key meet in
one task; what a chunk can decide alone is decided before the shuffle, so a key
that is in a third of all documents costs one pair per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidelex.llm.common import concat_lists, giving_back

ROW = "part int, lane int, doc_id long, docs binary, data binary"
_ROW = ["part", "lane", "doc_id", "docs", "data"]
PASSED = -1


class Lanes:
    """How keys of ``bits`` bits are dealt out to ``parts`` partitions."""

    def __init__(self, parts: int, bits: int = 64):
        self.parts, self.bits = parts, bits
        self.lane_bits = max(8, (4 * parts - 1).bit_length())
        self.stored = max(1, -(-(bits - 8) // 8))

    def lane(self, keys: np.ndarray) -> np.ndarray:
        lane = keys >> np.uint64(self.bits - self.lane_bits)
        return lane.astype(np.uint16 if self.lane_bits <= 16 else np.uint32)

    def part(self, lane: np.ndarray) -> np.ndarray:
        return (lane.astype(np.int64) * self.parts) >> self.lane_bits

    def pack_keys(self, keys: np.ndarray) -> np.ndarray:
        """Keys as rows of their low bytes; the leading byte follows from the lane."""
        return np.ascontiguousarray(keys).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.stored]

    def unpack_keys(self, data: np.ndarray, lane: int) -> np.ndarray:
        full = np.zeros((len(data) // self.stored, 8), dtype=np.uint8)
        full[:, :self.stored] = data.reshape(-1, self.stored)
        low = full.view("<u8").reshape(-1)
        top = np.uint64(lane >> (self.lane_bits - 8)) << np.uint64(self.bits - 8)
        return (low & ((np.uint64(1) << np.uint64(self.bits - 8)) - np.uint64(1))) | top

    def order(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A stable order by lane, the lanes in use and the bounds of each."""
        lane = self.lane(keys)
        order = np.argsort(lane, kind="stable")
        lane = lane[order]
        starts = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1]))) if len(lane) else np.empty(0, int)
        return order, lane[starts].astype(np.int64), np.append(starts, len(lane))


def pack_docs(docs: np.ndarray) -> bytes:
    """Document ids as one-byte steps; a step outside 0..254 is stored in full."""
    if not len(docs):
        return b""
    step = np.diff(docs)
    wide = (step < 0) | (step > 254)
    full = step[wide]
    head = np.array([docs[0], len(full)], dtype="<i8")
    return head.tobytes() + full.astype("<i8").tobytes() + np.where(wide, 255, step).astype(np.uint8).tobytes()


def unpack_docs(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, dtype=np.int64)
    first, wide = np.frombuffer(raw, dtype="<i8", count=2)
    full = np.frombuffer(raw, dtype="<i8", count=int(wide), offset=16)
    step = np.frombuffer(raw, dtype=np.uint8, offset=16 + 8 * int(wide)).astype(np.int64)
    step[step == 255] = full
    return np.concatenate(([first], first + np.cumsum(step)))


def by_document(docs: np.ndarray, values: np.ndarray, *more: np.ndarray):
    """Order rows by document: the documents, the ordered values and bounds in rows."""
    order = np.lexsort((*more, docs)) if more else np.argsort(docs, kind="stable")
    docs = docs[order]
    starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.empty(0, int)
    return docs[starts], values[order], np.append(starts, len(docs)), order


def lane_groups(batches, names: tuple[str, ...], at_once: int | None = None):
    """Rows of a partition sorted by lane, as (lane, {column: list}) one lane at a time.

    Rows of lane ``at_once`` are handed on batch by batch and never gathered.
    """
    lane, held = None, {n: [] for n in names}
    for batch in batches:
        lanes = batch.column("lane").to_numpy()
        for lo, hi in _bounds(lanes):
            now = int(lanes[lo])
            if lane is not None and (now != lane or lane == at_once):
                yield lane, held
                held = {n: [] for n in names}
            lane = now
            for n in names:
                held[n].extend(batch.column(n).slice(lo, hi - lo).to_pylist())
    if lane is not None:
        yield lane, held


def _bounds(lanes: np.ndarray):
    starts = np.flatnonzero(np.concatenate(([True], lanes[1:] != lanes[:-1]))) if len(lanes) else np.empty(0, int)
    ends = np.append(starts[1:], len(lanes))
    return zip(starts, ends, strict=True)


def offer(keys: np.ndarray, owner: np.ndarray, lanes: Lanes, smallest_too: bool = False):
    """One (key, smallest document) pair per distinct key of a chunk, packed in lanes.

    A key that the chunk itself has in several documents needs no answer from
    elsewhere for the later ones (with ``smallest_too`` for all of them): these
    pass through as decided.
    """
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    ordered, owners = keys[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    length = np.diff(np.append(starts, len(ordered)))
    least = np.minimum.reduceat(owners, starts)
    if smallest_too:
        told = np.repeat(np.maximum.reduceat(owners, starts) != least, length)
    else:
        told = owners > np.repeat(least, length)
    # In text order, which keeps the steps between documents short.
    first = np.empty(len(keys), dtype=np.int64)
    first[order[starts]] = least
    pick = np.sort(order[starts])
    keys, asking = keys[pick], first[pick]
    shuffled, lane, bounds = lanes.order(keys)
    low, asking = lanes.pack_keys(keys[shuffled]), asking[shuffled]
    cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
    yield pa.RecordBatch.from_arrays(
        [pa.array(lanes.part(lane), pa.int32()), pa.array(lane, pa.int32()), pa.nulls(len(lane), pa.int64()),
         pa.array([pack_docs(asking[a:b]) for a, b in cuts], pa.binary()),
         pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary())], _ROW)
    if told.any():
        ids, data = _told(owners[told], ordered[told])
        n = len(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.abs(ids) % lanes.parts, pa.int32()), pa.array(np.full(n, PASSED), pa.int32()),
             pa.array(ids, pa.int64()), pa.nulls(n, pa.binary()), data], _ROW)


def _told(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    ids, values, bounds, _ = by_document(docs, keys)
    return ids, pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())


@giving_back
def judge(batches, lanes: Lanes, smallest_too: bool = False):
    """Per lane: a key offered several times goes back to every document but the smallest (or to all)."""
    names = ["doc_id", "hashes"]
    for lane, held in lane_groups(batches, ("doc_id", "docs", "data"), PASSED):
        if lane == PASSED:
            yield pa.RecordBatch.from_arrays([pa.array(held["doc_id"], pa.int64()), pa.array(held["data"], pa.binary())], names)
            continue
        keys = lanes.unpack_keys(np.frombuffer(b"".join(held["data"]), dtype=np.uint8), lane)
        docs = np.concatenate([unpack_docs(d) for d in held["docs"]])
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        length = np.diff(np.append(starts, len(keys)))
        if smallest_too:
            told = np.repeat(length > 1, length)
        else:
            told = docs > np.repeat(np.minimum.reduceat(docs, starts), length)
        if told.any():
            ids, data = _told(docs[told], keys[told])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), data], names)


def member_of(keys: np.ndarray, per: np.ndarray, told: pa.Array) -> np.ndarray:
    """Which keys (``per`` of them for each row, in order) are among those told to their row."""
    raw, bounds = concat_lists(told)
    found = np.zeros(len(keys), dtype=bool)
    ends = np.cumsum(per)
    for i in np.flatnonzero(np.diff(bounds)):
        lo, hi = ends[i] - per[i], ends[i]
        if hi > lo:
            known = np.sort(raw[bounds[i]:bounds[i + 1]].view("<u8"))
            own = keys[lo:hi]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            found[lo:hi] = known[at] == own
    return found
