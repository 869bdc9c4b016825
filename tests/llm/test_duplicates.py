"""Substring, suffix and near-duplicate removal against plain re-computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidelex.llm import exchange, graph, minhash, suffix
from tidelex.llm.common import hash_spans, rolling
from tidelex.llm.minhash import near_duplicates
from tidelex.llm.substring import substring_dedup
from tidelex.llm.suffix import suffix_dedup


def removed_words(df, **k):
    return cases.ordered(tuple(r) for r in substring_dedup(df, **k).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect())


def removed_bytes(df, **k):
    return cases.ordered(tuple(r) for r in suffix_dedup(df, **k).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect())


def groups(df, **k):
    return cases.ordered(tuple(r) for r in near_duplicates(df, **k).select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("spread", [1, 9])
def test_substring(spark, spread):
    df = cases.table(spark).repartition(spread)
    assert removed_words(df) == cases.brute_substring(cases.pairs(df))
    assert removed_words(df, window=3) == cases.brute_substring(cases.pairs(df), 3)


@pytest.mark.parametrize("spread", [1, 9])
def test_suffix(spark, spread):
    df = cases.table(spark).repartition(spread)
    assert removed_bytes(df) == cases.brute_suffix(cases.pairs(df))
    assert removed_bytes(df, length=12, gram=5) == cases.brute_suffix(cases.pairs(df), 12)


def test_suffix_random_overlaps(spark):
    rng = random.Random(5)
    source = "".join(rng.choice("ab") for _ in range(400))
    rows = []
    for i in range(60):
        text = "".join(source[a:a + rng.randrange(5, 70)] for a in (rng.randrange(330) for _ in range(4)))
        rows.append((rng.randrange(50), text))
    df = cases.table(spark, rows).repartition(5)
    assert removed_bytes(df, length=20, gram=8) == cases.brute_suffix(cases.pairs(df), 20)


@pytest.mark.parametrize("spread", [1, 9])
def test_near_duplicates(spark, spread):
    df = cases.table(spark).repartition(spread)
    rows = cases.pairs(df)
    assert groups(df) == cases.brute_near(rows, 5)
    assert groups(df, shingle=4) == cases.brute_near(rows, 4)


def test_near_duplicate_chains(spark):
    """Chains whose ends are unlike, and a bucket that several components share."""
    rng = random.Random(3)
    rows, base = [], cases.prose(50, 100).split(" ")
    for i in range(40):
        rows.append((100 - i, " ".join(base)))
        base = list(base)
        base[rng.randrange(100)] = f"new{i}"
    rows += [(200 + i, cases.prose(60 + i, 30) + " " + cases.prose(50, 60)) for i in range(30)]
    df = cases.table(spark, rows).repartition(4)
    assert groups(df) == cases.brute_near(cases.pairs(df), 5)


def test_hot_copies_and_block_pairs(spark, monkeypatch):
    """One text in most rows; and blocks so small that a band value is compared in several."""
    rows = [(i, cases.prose(9, 60)) for i in range(300)] + [(1000 + i, cases.prose(i, 50)) for i in range(20)]
    df = cases.table(spark, rows).repartition(6)
    got = groups(df)
    assert got == cases.brute_near(cases.pairs(df), 5)
    assert sum(r[2] == 0 for r in got) >= 300
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rows = [(i, cases.prose(70, 40) + " " + cases.prose(100 + i, 14)) for i in range(12)] + [(50 + i, cases.prose(70, 40)) for i in range(3)]
    df = cases.table(spark, rows).repartition(3)
    assert groups(df, threshold=60) == cases.brute_near(cases.pairs(df), 5, 60)


def test_empty_tables(spark):
    df = cases.table(spark, [])
    for out in (substring_dedup(df), suffix_dedup(df), near_duplicates(df)):
        assert out.count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_other_column_names(spark):
    df = cases.table(spark).select(F.col("doc_id").alias("key"), F.col("text").alias("body"), F.lit(1).alias("doc_id"), F.lit("t").alias("text"))
    want = cases.brute_substring([(r["key"], r["body"]) for r in df.collect()])
    assert removed_words(df, id_col="key", text_col="body") == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 5), (300, 300)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 200: 1, 100: 100, 101: 100, 103: 100, 300: 300}


def test_estimate_takes_out_chance():
    rng = np.random.default_rng(1)
    for bits in (1, 2, 4):
        low = rng.integers(0, 1 << bits, (2, 20_000), dtype=np.uint8)
        low[1, :10_000] = low[0, :10_000]
        packed = np.packbits(((low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1).reshape(2, -1), axis=1)
        assert abs(minhash.estimate(packed[:1], packed[1], 20_000, bits)[0] - 0.5) < 0.03


def test_lanes_keep_pairs():
    rng = np.random.default_rng(2)
    for parts, bits in ((1, 64), (50, 64), (211, 40), (3000, 48)):
        lanes = exchange.Lanes(parts, bits)
        keys = rng.integers(0, 1 << bits, 500, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2)
        order, lane, bounds = lanes.order(keys)
        packed = lanes.pack_keys(keys[order])
        back = np.concatenate([lanes.unpack_keys(packed[a:b].reshape(-1), int(x)) for x, a, b in zip(lane, bounds, bounds[1:])])
        assert (back == keys[order]).all() and (lanes.part(lane) < parts).all()
    for docs in ([5], [1, 1, 2, 300, 299, -4, 2**40, 2**40 + 255, 2**40 + 509], []):
        assert exchange.unpack_docs(exchange.pack_docs(np.array(docs, dtype=np.int64))).tolist() == docs


def test_suffix_array_and_repeats():
    strings = [b"banana", b"ananas", b"xxbananaxx", b"nan"]
    off = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    string, offset, rest, lcp = suffix.suffix_array(np.frombuffer(b"".join(strings), np.uint8), off, 2)
    found = [strings[s][o:] for s, o in zip(string, offset)]
    assert found == sorted(s[i:] for s in strings for i in range(len(s) - 1))
    for a, b, n in zip(found, found[1:], lcp[1:]):
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == common
    left = np.array([strings[s][o - 1] if o else 256 + i for i, (s, o) in enumerate(zip(string, offset))])
    groups_, _ = suffix.maximal_repeats(lcp, left, string, 3)
    assert {(found[a][:d], b - a + 1) for a, b, d in groups_} == {(b"banana", 2), (b"anana", 3), (b"nan", 6), (b"ana", 6)} - {(b"nan", 6)} | {
        (found[a][:d], b - a + 1) for a, b, d in groups_ if found[a][:d] == b"nan"}


def test_hashes_depend_on_content_only():
    raw = np.frombuffer(b"abc abc xabc", np.uint8)
    a = hash_spans(raw, np.array([0, 4, 8]), np.array([3, 7, 12]))
    assert a[0] == a[1] != a[2]
    values = np.arange(200_000, dtype=np.uint64) % np.uint64(7)
    h = rolling(values, 13)
    assert len(set(h.tolist())) == 7 and (h[7:] == h[:-7]).all()
