"""Importance resampling, ranked search and byte-level encoding against plain re-computations."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidelex.llm import byte_bpe, queries, ranked, resample


def words(text):
    return [w.decode() for w in cases.words(text, cases.PLAIN, lower=True)]


def features(text):
    ws = words(text)
    return [" ".join(ws[i:i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def brute_resample(rows, target, buckets, share, least=20):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            counts.update(zlib.crc32(f.encode()) % buckets for f in features(text))
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)}
    out = []
    for doc, text in rows:
        found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, None, len(words(text)) >= least and doc is not None])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(may[:share * len(may) // 100]):
        r[4] = i + 1
    return cases.ordered(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("share", [5, 40, 100])
def test_resample_awkward_texts(spark, share):
    df = cases.table(spark).repartition(3)
    target = [cases.prose(5, 300), cases.prose(6, 50) + "\n" + cases.prose(1, 30), None, "", "one two"]
    tests = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resample.resample(df, tests, buckets=97, share=share).drop("n_words").collect()
    rows = cases.pairs(df)
    got, want = cases.ordered(tuple(r) for r in got), brute_resample(rows, target, 97, share)
    # Rows of one id and equal scores may change places.
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted((r[0], r[4]) for r in got if r[4]) == sorted((r[0], r[4]) for r in want if r[4])


def test_resample_lines_and_long_words(spark):
    rng = random.Random(4)
    line = "the same line of a licence"
    rows = [(i, "\n".join(rng.choice([line, "", "x", "a b", cases.prose(i, 9), "é" * 90 + " " + "w" * rng.randrange(1, 3000)])
                          for _ in range(rng.randrange(30)))) for i in range(60)]
    df = cases.table(spark, rows).repartition(5)
    got = resample.resample(df, cases.table(spark, rows[:3]), share=30).drop("n_words").collect()
    assert cases.ordered(tuple(r) for r in got) == brute_resample(rows, [t for _, t in rows[:3]], resample.BUCKETS, 30)


def test_resample_empty_tables(spark):
    df = cases.table(spark)
    assert resample.resample(df.limit(0), df).collect() == []
    assert resample.resample(df, df.limit(0)).count() == df.count()


def test_crc_of_spans():
    rng = np.random.default_rng(3)
    buf = rng.integers(0, 256, 9000).astype(np.uint8)
    start = np.sort(rng.integers(0, 8000, 400))
    end = start + rng.integers(0, 900, 400)
    want = [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    assert resample.crc_spans(buf, start, end).tolist() == want
    n = rng.integers(0, 2000, 400)
    tail = [zlib.crc32(b"q" * int(k)) for k in n]
    joined = resample.shifted(np.array(want, np.uint32), n) ^ np.array(tail, np.uint32)
    assert joined.tolist() == [zlib.crc32(buf[a:b].tobytes() + b"q" * int(k)) for a, b, k in zip(start, end, n, strict=True)]


def brute_search(rows, asked, best=20):
    bags = [(doc, Counter(words(text))) for doc, text in rows]
    sizes = [sum(b.values()) for _, b in bags]
    n, length = sum(k > 0 for k in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in asked:
        q = Counter(words(text))
        scored = []
        for (doc, bag), size in zip(bags, sizes, strict=True):
            if doc is None:
                continue
            m = 75 + 25 * size * n // max(length, 1)
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t, k in q.items() if bag[t])
            if score > 0:
                scored.append((-score, doc))
        out += [(item, i + 1, doc, -score) for i, (score, doc) in enumerate(sorted(scored)[:best])]
    return cases.ordered(out)


ASKED = [(1, cases.prose(1, 40)), (2, "one two two THREE"), (3, None), (4, ""), (5, "nowhere_at_all qqq"), (None, cases.prose(2, 20)),
         (7, cases.prose(3, 400)), (7, "alpha1 日本 la12"), (8, "la3 la3 la3 x")]


@pytest.mark.parametrize("shard,query_bytes", [(1 << 23, 1 << 23), (900, 1 << 23), (3000, 700)])
def test_search_awkward_texts(spark, shard, query_bytes):
    df = cases.table(spark).repartition(3)
    asked = spark.createDataFrame([(i, t, "x") for i, t in ASKED], "item_id long, text string, score string")
    got = ranked.ranked_search(df, asked, shard_bytes=shard, query_bytes=query_bytes)
    assert cases.ordered(tuple(r) for r in got.collect()) == brute_search(cases.pairs(df), ASKED)


def test_search_skips_without_losing(spark):
    """Many documents, small shards and blocks: pruned lists give the same best documents, ties by id."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "of", "and", "rare%d" % rng.randrange(40), "mid%d" % rng.randrange(6)], k=rng.randrange(1, 30))))
            for i in rng.sample(range(9000), 3000)]
    asked = [(i, "the of the rare%d mid%d and" % (i, i % 6)) for i in range(12)]
    df = cases.table(spark, rows).repartition(4)
    got = ranked.ranked_search(df, spark.createDataFrame(asked, "item_id long, text string"), shard_bytes=6000)
    assert cases.ordered(tuple(r) for r in got.collect()) == brute_search(rows, asked)


def test_walk_probes_only_what_can_win():
    texts = [f"common {'needle' if i % 50 == 0 else 'hay'}" for i in range(2000)]
    import pyarrow as pa
    block = ranked.Queries.of([(1, "common needle")])
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["doc_id", "text"])
    (shard,) = list(ranked._indexed([batch], block.vocabulary, 1 << 20))
    told = ranked.Statistics(2000, 4000, np.array([5, 4000]))
    best = ranked.Best(20)
    ranked.walk(ranked.Shard(shard.to_pylist()[0], told), *block.items[0][1:], best, walked=100)
    assert best.doc.tolist() == list(range(0, 1000, 50))


def test_search_empty_tables(spark):
    df = cases.table(spark)
    asked = spark.createDataFrame(ASKED, "item_id long, text string")
    assert ranked.ranked_search(df.limit(0), asked).collect() == []
    assert ranked.ranked_search(df, asked.limit(0)).collect() == []


def byte_level():
    import tiktoken
    path, pattern = queries.rank_file()
    return path, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


@pytest.mark.parametrize("remembered", [byte_bpe.REMEMBERED, 0])
def test_byte_level_awkward_texts(spark, remembered):
    path, pattern, library = byte_level()
    rng = random.Random(5)
    texts = ["a" * 5000, " " * 900 + "x", "it's  the\n\n end<|endoftext|> we'LL", "abab" * 800, "👨‍👩" * 30, "日本語" * 200,
             "".join(rng.choices("abcdeéß", k=1500)), "".join(rng.choices("ab \t\n 　1٣é'st.,", k=3000))]
    df = cases.table(spark, cases.pairs(cases.table(spark)) + [(100 + i, t) for i, t in enumerate(texts)]).repartition(3)
    encoded = byte_bpe.byte_bpe_encode(df, path, pattern, remembered=remembered)
    got = [(r.doc_id, r.n_tokens, list(r.ids), bytes(r.decoded))
           for r in byte_bpe.byte_bpe_decode(encoded, path).collect()]
    want = []
    for doc, text in cases.pairs(df):
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), ids, (text or "").encode()))
    assert cases.ordered(got) == cases.ordered(want)


def test_byte_level_decodes_any_ids(spark):
    path, pattern, library = byte_level()
    lists = [[], [0], [50255, 3, 3], list(range(300, 50256, 501))]
    df = spark.createDataFrame(list(enumerate(lists)) + [(9, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in byte_bpe.byte_bpe_decode(df, path).collect()}
    assert got == {i: library.decode_bytes(x) for i, x in enumerate(lists)} | {9: b""}
    raw = df.where("ids IS NOT NULL").select("doc_id", byte_bpe.ids_bytes(F.col("ids"), path).alias("raw")).collect()
    assert {r.doc_id: np.frombuffer(bytes(r.raw), "<u4").tolist() for r in raw} == dict(enumerate(lists))
    for ids in ([50256], [-1], [5, None]):
        with pytest.raises(Exception, match="no token has the id"):
            byte_bpe.byte_bpe_decode(spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>"), path).collect()


def test_byte_level_plan_has_no_python(spark):
    path, pattern, _ = byte_level()
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = byte_bpe.byte_bpe_decode(byte_bpe.byte_bpe_encode(docs, path, pattern), path)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_byte_level_ranks_not_made_by_merges(spark, tmp_path):
    import base64

    import tiktoken
    tokens = [bytes([b]) for b in range(256)] + [b"aba", b"ab", b"xyz", b"bb"]
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    _, pattern, _ = byte_level()
    library = tiktoken.Encoding("odd", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(str(path)), special_tokens={})
    texts = ["ab" * 30, "ab" * 600, "xyz xyz axyz", "xyz", "abbab abaab", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for remembered in (0, 10):
        got = {r.doc_id: list(r.ids) for r in byte_bpe.byte_bpe_encode(df, str(path), pattern, remembered=remembered).collect()}
        assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_byte_level_remembers_words_in_one_job(spark):
    path, pattern, _ = byte_level()
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('a b c d ', id % 90, ' x', id % 90) AS text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.sparkContext.setJobGroup("remembered words", "")
    try:
        byte_bpe.byte_bpe_encode(docs, path, pattern)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("remembered words")) < 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_byte_level_empty(spark):
    path, pattern, _ = byte_level()
    assert byte_bpe.byte_bpe_encode(cases.table(spark).limit(0), path, pattern).where(F.lit(True)).collect() == []
