"""Byte-level repeat removal with enhanced suffix arrays.

A string of ``length`` bytes belongs to the smallest hash of the shorter grams
inside it, so equal strings always meet under the same hash, and neighbouring
strings that share it form one piece. Pieces whose hash is in one document only
cannot repeat and stay where they are; the others meet in the task of their
hash. There a suffix array with common-prefix lengths is built over them, and a
stack scan of its interval tree yields the maximal repeats: intervals of at
least ``length`` bytes whose occurrences differ in the byte to their left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm import exchange as ex
from tidelex.llm.common import (BYTE_VALUE, binary_column, carried, chunks, flat_bytes, gather, giving_back, id_and_text,
                                mix64, packed_texts, partitions, schema_of, ragged, rolling, unpacked)

LENGTH = 50
GRAM = 24
SEGMENT = 1 << 20
LONGEST_RUN = 62
_ROW = ["part", "lane", "doc_id", "row_key", "docs", "data"]
_SCHEMA = "part int, lane int, doc_id long, row_key long, docs binary, data binary"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[:len(values) - width + 1], out[width - span:])
    return out


def pieces(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Runs of string starts that share their smallest gram hash: (first start, starts, hash).

    Worked in segments, so a very long text needs no more memory than a short one.
    """
    first, count, key = [], [], []
    for lo in range(0, len(buf) - length + 1, SEGMENT):
        data = buf[lo:lo + SEGMENT + length - 1]
        least = sliding_min(rolling(data, gram, BYTE_VALUE), length - gram + 1)
        hi = lo + len(least)
        a, b = np.searchsorted(off, lo, side="right") - 1, np.searchsorted(off, hi, side="left")
        stop = np.repeat(off[a + 1:b + 1], np.minimum(off[a + 1:b + 1], hi) - np.maximum(off[a:b], lo))
        valid = np.flatnonzero(np.arange(lo + length, hi + length) <= stop)
        if not len(valid):
            continue
        own = least[valid]
        fresh = np.concatenate(([True], (valid[1:] != valid[:-1] + 1) | (own[1:] != own[:-1])))
        starts = np.flatnonzero(fresh)
        size = np.diff(np.append(starts, len(valid)))
        times = -(-size // LONGEST_RUN)
        step = ragged(times) * LONGEST_RUN
        first.append(np.repeat(valid[starts], times) + step + lo)
        count.append(np.minimum(np.repeat(size, times) - step, LONGEST_RUN))
        # Minima are small numbers; mixed again they spread over all lanes.
        key.append(np.repeat(mix64(own[starts]), times))
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(first), np.concatenate(count), np.concatenate(key)


@giving_back
def offers(batches, lanes: ex.Lanes, length: int, gram: int):
    """The piece hashes of every document, packed per chunk."""
    for chunk in chunks(batches):
        first, _, key = pieces(chunk.buf, chunk.off, length, gram)
        row = np.searchsorted(chunk.off, first, side="right") - 1
        yield from ex.offer(key >> np.uint64(64 - lanes.bits), chunk.ids()[row], lanes, smallest_too=True)


def _spans(ids, row_keys, start, end):
    """Spans grouped by document row: (doc_id, row_key, data)."""
    order = np.lexsort((start, row_keys, ids))
    ids, row_keys = ids[order], row_keys[order]
    pairs = np.stack((start[order], end[order]), axis=1).astype("<u4")
    starts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (row_keys[1:] != row_keys[:-1]))))
    bounds = np.append(starts, len(ids)) * 8
    return pa.array(ids[starts], pa.int64()), pa.array(row_keys[starts], pa.int64()), binary_column(pairs.reshape(-1), bounds)


@giving_back
def shared_pieces(batches, lanes: ex.Lanes, filter_lanes: ex.Lanes, length: int, gram: int):
    """Pieces under hashes that several documents have, packed in lanes.

    Of equal pieces in a chunk only those of its smallest document move on; the
    others are repeats already and pass through as spans.
    """
    import zstandard
    press = zstandard.ZstdCompressor(level=1)
    for chunk in chunks(unpacked(b.filter(b.column("told").is_valid()) for b in batches)):
        first, count, key = pieces(chunk.buf, chunk.off, length, gram)
        row = np.searchsorted(chunk.off, first, side="right") - 1
        per = np.bincount(row, minlength=len(chunk))
        hit = ex.member_of(key >> np.uint64(64 - filter_lanes.bits), per, chunk.rows.column("told"))
        if not hit.any():
            continue
        first, size, key, row = first[hit], count[hit] + length - 1, key[hit], row[hit]
        ids, row_keys = chunk.ids()[row], chunk.ids("row_key")[row]
        pos = first - chunk.off[row]
        bounds = np.concatenate(([0], np.cumsum(size)))
        codes = binary_column(gather(chunk.buf, first, size), bounds).dictionary_encode().indices.to_numpy()
        least = np.full(codes.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, codes, ids)
        later = ids > least[codes]
        if later.any():
            who, rk, data = _spans(ids[later], row_keys[later], pos[later], pos[later] + size[later])
            n = len(who)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.abs(who.to_numpy()) % lanes.parts, pa.int32()), pa.array(np.full(n, ex.PASSED), pa.int32()),
                 who, rk, pa.nulls(n, pa.binary()), data], _ROW)
        first, size, key, ids, row_keys, pos = (x[~later] for x in (first, size, key, ids, row_keys, pos))
        order, lane, cuts = lanes.order(key)
        first, size, ids, row_keys, pos = (x[order] for x in (first, size, ids, row_keys, pos))
        data = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            body = gather(chunk.buf, first[a:b], size[a:b])
            data.append(press.compress(size[a:b].astype("<u2").tobytes() + pos[a:b].astype("<u4").tobytes()
                                       + row_keys[a:b].astype("<i8").tobytes() + body.tobytes()))
        n = len(lane)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lanes.part(lane), pa.int32()), pa.array(lane, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
             pa.array([ex.pack_docs(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
             pa.array(data, pa.binary())], _ROW)


_DIGITS = 7


def suffix_array(buf: np.ndarray, off: np.ndarray, least: int):
    """Suffixes of at least ``least`` bytes in order, and common-prefix lengths of neighbours.

    Returns (string, offset in it, length, lcp); lcp[i] compares i-1 and i.
    Suffixes are sorted by seven bytes at a time, and only those that still tie
    are looked at again.
    """
    size = np.diff(off)
    per = np.maximum(size - least + 1, 0)
    string = np.repeat(np.arange(len(size)), per)
    offset = ragged(per)
    rest = size[string] - offset
    # Each string is followed by a zero digit, which sorts before every byte.
    digits = np.zeros(len(buf) + len(size) + 200, dtype=np.uint64)
    digits[np.arange(len(buf)) + np.repeat(np.arange(len(size)), size)] = buf.astype(np.uint64) + np.uint64(1)
    word = np.zeros(len(digits) - _DIGITS, dtype=np.uint64)
    for j in range(_DIGITS):
        word = (word << np.uint64(9)) | digits[j:j + len(word)]
    at = off[:-1][string] + string + offset
    n = len(at)
    order = np.arange(n)
    lcp = np.zeros(n, dtype=np.int64)
    slots, group, level = np.arange(n), np.zeros(n, dtype=np.int64), 0
    deepest = int(size.max()) if len(size) else 0
    while len(slots) and level * _DIGITS <= deepest:
        key = word[np.minimum(at[order[slots]] + level * _DIGITS, len(word) - 1)]
        perm = np.argsort(key, kind="stable") if level == 0 else np.lexsort((key, group))
        order[slots], key = order[slots[perm]], key[perm]
        same_group = np.concatenate(([False], group[1:] == group[:-1]))
        differ = np.zeros(len(slots), dtype=bool)
        differ[1:] = key[1:] != key[:-1]
        split = same_group & differ
        x = key[np.flatnonzero(split)] ^ key[np.flatnonzero(split) - 1]
        common = np.zeros(len(x), dtype=np.int64)
        for j in range(1, _DIGITS):
            common += (x >> np.uint64(63 - 9 * j)) == 0
        lcp[slots[split]] = level * _DIGITS + common
        tied = same_group & ~differ
        open_ = tied | np.append(tied[1:], False)
        lcp[slots[tied]] = deepest
        group = np.cumsum(~tied)[open_]
        slots = slots[open_]
        level += 1
    string, offset, rest = string[order], offset[order], rest[order]
    if n:
        lcp[1:] = np.minimum(lcp[1:], np.minimum(rest[1:], rest[:-1]))
    return string, offset, rest, lcp


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, owner: np.ndarray, least: int):
    """Stack scan of the common-prefix intervals of at least ``least`` bytes.

    ``left`` is the byte before each suffix (a number of its own where there is
    none); an interval whose occurrences all have the same one is part of a longer
    repeat and no group. Returns the groups (first, last, depth) with all
    occurrences ``first..last``, and (suffix, depth) for every occurrence in a
    document later than the first of its group, at the deepest such group.
    """
    groups, marked = [], []
    change = np.cumsum(np.concatenate(([0], left[1:] != left[:-1]))) if len(left) else left
    inside = np.flatnonzero(lcp >= least)
    if not len(inside):
        return groups, marked
    cut = np.flatnonzero(np.concatenate(([True], inside[1:] != inside[:-1] + 1)))
    for a, b in zip(cut, np.append(cut[1:], len(inside)), strict=True):
        lo, hi = int(inside[a]) - 1, int(inside[b - 1])
        depth, doc = lcp[lo:hi + 1].tolist() + [0], owner[lo:hi + 1].tolist()
        turn = change[lo:hi + 1].tolist()
        stack = []  # depth, first, smallest document, occurrences without a mark, whether those are of several documents
        for i in range(1, hi - lo + 2):
            h = depth[i]
            first, small, open_, mixed = i - 1, doc[i - 1], [i - 1], False
            while stack and stack[-1][0] > h:
                d, first, m, held, mix = stack.pop()
                mixed = mix or mixed or m != small
                small = min(small, m)
                held.extend(open_)
                open_ = held
                if turn[i - 1] != turn[first]:
                    groups.append((lo + first, lo + i - 1, d))
                    if mixed:
                        marked.extend((lo + s, d) for s in open_ if doc[s] > small)
                        open_ = [s for s in open_ if doc[s] == small]
                        mixed = False
            if not h:
                break
            if stack and stack[-1][0] == h:
                top = stack[-1]
                top[4] = top[4] or mixed or top[2] != small
                top[2] = min(top[2], small)
                top[3].extend(open_)
            else:
                stack.append([h, first, small, open_, mixed])
    return groups, marked


@giving_back
def judge(batches, length: int):
    """Per lane: spans of the pieces that also start in an earlier document."""
    import zstandard
    press = zstandard.ZstdDecompressor()
    names = ["doc_id", "row_key", "spans"]
    for lane, held in ex.lane_groups(batches, ("doc_id", "row_key", "docs", "data"), ex.PASSED):
        if lane == ex.PASSED:
            yield pa.RecordBatch.from_arrays([pa.array(held["doc_id"], pa.int64()), pa.array(held["row_key"], pa.int64()),
                                              pa.array(held["data"], pa.binary())], names)
            continue
        ids, sizes, poses, keys, bodies = [], [], [], [], []
        for docs, raw in zip(held["docs"], held["data"], strict=True):
            docs, raw = ex.unpack_docs(docs), press.decompress(raw)
            n = len(docs)
            ids.append(docs)
            sizes.append(np.frombuffer(raw, "<u2", n))
            poses.append(np.frombuffer(raw, "<u4", n, 2 * n))
            keys.append(np.frombuffer(raw, "<i8", n, 6 * n))
            bodies.append(np.frombuffer(raw, np.uint8, offset=14 * n))
        ids, row_keys = np.concatenate(ids), np.concatenate(keys)
        size, pos = np.concatenate(sizes).astype(np.int64), np.concatenate(poses).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(size)))
        # Equal pieces are one string of the array, with all their occurrences.
        coded = binary_column(np.concatenate(bodies), bounds).dictionary_encode()
        code = coded.indices.to_numpy()
        distinct = coded.dictionary
        buf = np.frombuffer(distinct.buffers()[2], np.uint8)
        off = np.frombuffer(distinct.buffers()[1], np.int32)[:len(distinct) + 1].astype(np.int64)
        owner = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(owner, code, ids)
        later = ids > owner[code]
        found = [(ids[later], row_keys[later], pos[later], pos[later] + size[later])]
        string, offset, _, lcp = suffix_array(buf, off, length)
        before = off[:-1][string] + offset - 1
        left = np.where(offset > 0, buf[before], 256 + np.arange(len(string)))
        _, marked = maximal_repeats(lcp, left, owner[string], length)
        if marked:
            suffix, depth = np.array(marked, dtype=np.int64).T
            # Back to the occurrences: those of the string's first document, the later ones being gone as a whole.
            rest = np.flatnonzero(~later)
            rest = rest[np.argsort(code[rest], kind="stable")]
            begin = np.searchsorted(code[rest], np.arange(len(distinct) + 1))
            times = (begin[1:] - begin[:-1])[string[suffix]]
            who = rest[np.repeat(begin[:-1][string[suffix]], times) + ragged(times)]
            start = pos[who] + np.repeat(offset[suffix], times)
            found.append((ids[who], row_keys[who], start, start + np.repeat(depth, times)))
        ids, row_keys, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(ids):
            yield pa.RecordBatch.from_arrays(list(_spans(ids, row_keys, start, end)), names)


@giving_back
def remove(batches, carry: bool = False):
    """Cut the told spans out of the texts; with ``carry`` the rest is text, without the bytes of cut characters."""
    for chunk in chunks(unpacked(batches)):
        told = chunk.rows.column("told")
        row, parts = pc.list_parent_indices(told).to_numpy(), told.flatten()
        own = parts.field("row_key").to_numpy(zero_copy_only=False) == chunk.ids("row_key")[row]
        raw, bounds = flat_bytes(parts.field("spans").filter(pa.array(own)))
        pairs = raw.view("<u4").astype(np.int64).reshape(-1, 2)
        at = np.repeat(chunk.off[row[own]], np.diff(bounds) // 8)
        size = len(chunk.buf) + 1
        delta = np.zeros(size, dtype=np.int32)
        np.add.at(delta, at + pairs[:, 0], 1)
        np.subtract.at(delta, at + pairs[:, 1], 1)
        covered = np.cumsum(delta, out=delta) > 0
        edge = np.zeros(size, dtype=bool)
        edge[chunk.off] = True
        gone = np.concatenate(([0], np.cumsum(covered)))[chunk.off]
        before = np.concatenate(([False], covered[:-1]))
        start = np.flatnonzero(covered & (~before | edge))
        end = np.flatnonzero(before & (~covered | edge))
        per = np.searchsorted(start, chunk.off)
        base = np.repeat(chunk.off[:-1], np.diff(per))
        spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"]))
        keep = chunk.off - gone
        kept = binary_column(chunk.buf[~covered[:-1]], keep).cast(pa.binary())
        more, names = carried(chunk.rows, "row")
        if carry:
            more.append(pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string()))
            names.append("text")
            kept = pa.nulls(len(chunk), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [chunk.rows.column("doc_id"), chunk.rows.column("row_key"), pa.array(np.diff(chunk.off), pa.int64()),
             pa.array(np.diff(gone), pa.int64()), spans, kept, *more],
            ["doc_id", "row_key", "n_bytes", "n_removed", "spans", "kept", *names])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 gram: int = GRAM, carry: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Returns one row per row of ``docs``: doc_id, row_key (xxhash64 of the text,
    null texts included), n_bytes, n_removed, spans (maximal removed runs as
    byte bounds) and kept (the other bytes). With ``carry`` kept is null, and the
    other columns come as struct ``row`` with text, the kept bytes without those of
    characters that a span cuts through.

    Defined cases: a null text is empty; a text shorter than ``length`` keeps all
    its bytes; a row without an id is neither searched nor a source of repeats
    and keeps its bytes; rows with one id are one document, so none of them is
    earlier than another; other columns are ignored; no rows give no rows.

    The strings themselves are compared. Hashes only route them, and the short
    ones that look for shared pieces grow with the size of the corpus.
    """
    full = id_and_text(docs, id_col, text_col, carry)
    full = full.select("doc_id", F.xxhash64("text").alias("row_key"), *full.columns[1:])
    narrow = full.select("doc_id", "row_key", "text")
    known = narrow.where("doc_id IS NOT NULL")
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions(docs)
    gram = min(gram, length)
    finder = ex.Lanes(parts, min(64, 8 * math.ceil((max(20, math.log2(total + 1)) + 8) / 8)))
    lanes = ex.Lanes(parts)
    shared = (known.select("doc_id", "text").mapInArrow(lambda b: offers(b, finder, length, gram), ex.ROW)
              .repartitionById(parts, "part").sortWithinPartitions("lane")
              .mapInArrow(lambda b: ex.judge(b, finder, smallest_too=True), "doc_id long, hashes binary")
              .groupBy("doc_id").agg(F.collect_list("hashes").alias("told")))
    # Both joins take the texts dealt out by doc_id in the same way, so they are shuffled once.
    texts = packed_texts(full)
    spans = (texts.join(shared, "doc_id", "left").select("doc_id", "row_key", "packed", "told")
             .mapInArrow(lambda b: shared_pieces(b, lanes, finder, length, gram), _SCHEMA)
             .repartitionById(parts, "part").sortWithinPartitions("lane")
             .mapInArrow(lambda b: judge(b, length), "doc_id long, row_key long, spans binary")
             .groupBy("doc_id").agg(F.collect_list(F.struct("row_key", "spans")).alias("told")))
    kinds = schema_of("doc_id long, row_key long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary",
                      full, *(("row", "text") if carry else ()))
    return (texts.join(spans, "doc_id", "left").select(*full.columns[:-1], "packed", "told")
            .mapInArrow(lambda b: remove(b, carry), kinds))
