"""The trigram index of the post archive."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from tidelex.operators.search import term_search
from tidelex.sources import termindex as TI

T0 = datetime(2024, 1, 1)
SCHEMA = "id string, subreddit string, posted_at timestamp, title string, selftext string"


def posts(spark, n, seed=1, start=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgé ", k=rng.randrange(1, 9)))
    rows = [(f"p{i}", "g", T0 + timedelta(minutes=i), " ".join(word() for _ in range(3)), None if i % 11 == 0 else " ".join(word() for _ in range(12)))
            for i in range(start, start + n)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df, terms, **more):
    return sorted(map(tuple, term_search(df, terms, **more).select("id", "term").collect()))


def test_same_rows_as_a_whole_search(spark, tmp_path):
    path, df = str(tmp_path / "a"), posts(spark, 600)
    assert TI.add_posts(df, path, 25) == list(range(24))
    terms = ["Abc", "bad g", "é f", "nothing here", "ddd", "GAB", "\n"]
    for some in ([t for t in terms if len(t) > 2], terms, ["ab"], ["zzz"]):
        assert sorted(map(tuple, TI.indexed_search(spark, path, some).select("id", "term").collect())) == plain(df, some)
    span = {"start": "2024-01-01 01:00:00", "end": "2024-01-01 05:00:00"}
    seen = df.where("id like 'p1%'").select("id")
    got = TI.indexed_search(spark, path, ["abc", "dda"], seen=seen, **span).select("id", "term").collect()
    assert sorted(map(tuple, got)) == plain(df, ["abc", "dda"], seen=seen, **span)


def test_a_rare_term_opens_its_blocks_only(spark, tmp_path):
    path = str(tmp_path / "a")
    df = posts(spark, 400).withColumn("selftext", F.when(F.col("id").isin("p7", "p399"), F.lit("to the Moon!")).otherwise(F.col("selftext")))
    TI.add_posts(df, path, 20)
    assert TI.blocks_to_read(spark, path, ["moon"]) == [0, 19]
    for block in range(1, 19):
        for file in Path(path, "data", f"block={block}").glob("*.parquet"):
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
            file.write_bytes(b"not parquet")
    assert sorted(r.id for r in TI.indexed_search(spark, path, ["MOON"]).collect()) == ["p399", "p7"]
    assert TI.blocks_to_read(spark, path, ["quux"]) == []
    assert TI.indexed_search(spark, path, ["quux"]).collect() == []


def test_blocks_without_postings_are_read(spark, tmp_path, monkeypatch):
    """A run lost after its rows: the blocks are searched whole until they are indexed."""
    path, first, second = str(tmp_path / "a"), posts(spark, 100), posts(spark, 100, 2, 100)
    TI.add_posts(first, path, 10)
    with monkeypatch.context() as m:
        m.setattr(TI, "index_blocks", lambda *a: None)
        TI.add_posts(second, path, 10)
    assert set(range(10, 20)) <= set(TI.blocks_to_read(spark, path, ["quux"]))
    both = first.unionByName(second)
    find = lambda: sorted(map(tuple, TI.indexed_search(spark, path, ["abc", "gfe"]).select("id", "term").collect()))
    assert find() == plain(both, ["abc", "gfe"])
    TI.index_blocks(spark, path, list(range(10, 20)))
    TI.index_blocks(spark, path, list(range(10, 20)))
    assert TI.blocks_to_read(spark, path, ["quux"]) == [] and find() == plain(both, ["abc", "gfe"])


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "a")
    assert TI.add_posts(posts(spark, 5).limit(0), path) == []
    TI.add_posts(posts(spark, 1), path)
    assert TI.indexed_search(spark, path, ["quux", "x y z"]).collect() == []


def test_trigrams_of_blocks(monkeypatch):
    """Every run of three characters of one text, also with rare characters, and none across texts; slices lose nothing."""
    texts = ["abcab", "ab", None, "", "a\x00\x00\x00", "x😀y😀z", "né à 日本", "q" * 50, "cabd"]
    block = [0, 0, 0, 1, 1, 1, 2, 2, 0]
    want = {(b, t[i:i + 3]) for b, t in zip(block, texts) for i in range(len(t or "") - 2)}
    batch = pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(texts, pa.string())], ["block", "text"])
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(TI, "_SLICE", size)
        got = [(r["block"], r["gram"]) for out in TI.block_grams(iter([batch])) for r in out.to_pylist()]
        assert set(got) == want and (size < 1 << 20 or len(got) == len(want))


def test_postings_hold_whole_characters(spark, tmp_path):
    path = str(tmp_path / "a")
    TI.add_posts(spark.createDataFrame([("p", "g", T0, "A😀b", "c")], SCHEMA), path)
    assert {r.gram for r in spark.read.parquet(f"{path}/postings").collect()} == set(TI.grams("a😀b c"))
