"""Quality rules, the classifier and decontamination against plain re-computations."""

import hashlib
import pickle
import re
import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidelex.llm import classifier, decontaminate, quality, queries
from tidelex.llm.common import chunks

SF = "/root/testdata/sf0.01"
have_tables = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


def test_statistics(spark):
    df = cases.table(spark)
    got = quality.quality_rules(df, df.where("doc_id < 10")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for doc, text in cases.pairs(df):
        s = cases.brute_statistics(text)
        want.append((doc, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert cases.ordered(tuple(r) for r in got) == cases.ordered(want)


def test_ratio(spark):
    """Mean log ratio over exact n-gram counts; with many buckets hashing changes nothing."""
    rows = [(i, cases.prose(i, 80)) for i in range(12)] + [(20 + i, " ".join(f"### {w}" for w in cases.prose(i, 80).split())) for i in range(4)]
    df = cases.table(spark, rows).repartition(3)
    trusted = spark.createDataFrame([(i,) for i in [*range(12), 3, 3, None]], "doc_id long")

    def grams(text):
        ws = text.split(" ")
        return [*ws, *zip(ws, ws[1:])]

    raw, target = Counter(), Counter()
    for doc, text in rows:
        raw.update(grams(text))
        if doc < 12:
            target.update(grams(text))
    share = sum(target.values()) / sum(raw.values())
    got = {r["doc_id"]: r for r in quality.quality_rules(df, trusted, bits=22).collect()}
    for doc, text in rows:
        own = grams(text)
        score = sum(math.log((target[g] + quality.PRIOR) / (raw[g] * share + quality.PRIOR)) for g in own) / len(own)
        assert abs(got[doc]["score"] - score) < 1e-3
        assert got[doc]["kept"] == (score >= quality.THRESHOLD) == (doc < 12)


@pytest.mark.parametrize("near", [False, True])
@pytest.mark.parametrize("copies", [2, 50, 2000])
def test_copies_without_a_trusted_one_stay(spark, copies, near):
    """A clean text nobody labelled, many times over, reads no worse than a single one."""
    text = " ".join(f"c{i}" for i in range(300))
    rows = [(i, cases.prose(i, 150)) for i in range(60)]
    rows += [(1000 + i, text + (f" end{i} of{i} it{i}" if near else "")) for i in range(copies)]
    df = cases.table(spark, rows).repartition(3)
    got = {r["doc_id"]: r for r in quality.quality_rules(df, df.where("doc_id < 40")).collect()}
    assert len(got) == len(rows) and all(r["kept"] for r in got.values())


def test_near_copies_are_all_counted(spark):
    """Words that only one of several near copies has are in the counts, with its share of one text's weight."""
    base = cases.prose(500, 150)
    rows = [(i, cases.prose(i, 80)) for i in range(12)] + [(100 + i, f"{base} own{i} tail{i}") for i in range(4)]
    df = cases.table(spark, rows).repartition(3)
    trusted = spark.createDataFrame([(i,) for i in [*range(12), 100]], "doc_id long")
    raw, target = Counter(), Counter()
    for doc, text in rows:
        ws = text.split(" ")
        for g in [*ws, *zip(ws, ws[1:])]:
            raw[g] += 1 if doc < 100 else 0.25
            target[g] += doc <= 100
    share = sum(target.values()) / sum(raw.values())
    got = {r["doc_id"]: r["score"] for r in quality.quality_rules(df, trusted, bits=22).collect()}
    for doc, text in rows:
        ws = text.split(" ")
        own = [*ws, *zip(ws, ws[1:])]
        score = sum(math.log((target[g] + quality.PRIOR) / (raw[g] * share + quality.PRIOR)) for g in own) / len(own)
        assert abs(got[doc] - score) < 1e-5


def test_ratios_do_not_depend_on_table_size():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 40, 5000)
    target = rng.binomial(raw, 0.3)
    once = quality.log_ratios(target, raw, quality.PRIOR)
    for k in (10, 100, 1000):
        assert np.allclose(quality.log_ratios(k * target, k * raw, quality.PRIOR), once, atol=1e-5)


def test_repeated_table_gives_the_same_verdicts(spark):
    junk = [(200 + i, " ".join(f"### {w}" for w in cases.prose(i + 70, 60).split())) for i in range(9)]
    rows = [(i, cases.prose(i, 120)) for i in range(60)] + junk
    verdicts = []
    for k in (1, 10):
        df = cases.table(spark, [(1000 * j + d, t) for j in range(k) for d, t in rows]).repartition(3)
        got = quality.quality_rules(df, df.where("doc_id % 1000 < 40")).collect()
        verdicts.append({(r["doc_id"] % 1000, round(r["score"], 5), r["kept"]) for r in got})
    assert verdicts[0] == verdicts[1] and {d for d, _, kept in verdicts[0] if not kept} == {d for d, _ in junk}


def test_quality_without_trust_and_empty(spark):
    df = cases.table(spark)
    none = df.select("doc_id").limit(0)
    assert {r["score"] for r in quality.quality_rules(df, none).collect()} == {0.0}
    assert quality.quality_rules(cases.table(spark, []), none).count() == 0


def test_shuffled_trust(spark, monkeypatch):
    df = cases.table(spark)
    want = sorted(map(str, quality.quality_rules(df, df.where("doc_id < 30")).collect()))
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert sorted(map(str, quality.quality_rules(df, df.where("doc_id < 30")).collect())) == want


def test_carried_columns(spark):
    df = cases.table(spark)
    from tidelex.llm.common import carried_back
    back = carried_back(quality.quality_rules(df, df.limit(0), carry=True), df)
    assert back.columns == df.columns and back.schema["told"].dataType == df.schema["told"].dataType
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (20, "Tie-break: né à 日本"),
         (3, "a b"), (4, None), (5, " ... "), (6, "x"), (None, "zzz"), (7, "x"), (8, cases.prose(1, 40)), (9, cases.prose(12, 13))]


def found(df):
    return cases.ordered((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontaminate(spark, block_bytes):
    """Short items, shared windows, clashing columns; and a benchmark that takes several passes."""
    extra = ["zero one TWO three four, five six-seven eight nine ten eleven twelve thirteen fourteen x fifteen", "a b a b x", "tie break né à 日本",
             "tie break né à 日", "axb", "A.B", cases.prose(12, 13), "y " * 500 + "x"]
    rows = [*cases.pairs(cases.table(spark)), *((1000 + i, t) for i, t in enumerate(extra))]
    df = cases.table(spark, rows).repartition(3)
    tests = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.decontaminate(df, tests, block_bytes=block_bytes)
    assert found(got) == cases.brute_benchmark(cases.pairs(df), ITEMS)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_items_without_an_id(spark, block_bytes, tmp_path):
    """Their windows are hits as in the SQL of the query: alone, beside a named item with the same one, and short."""
    items = [(None, cases.prose(40, 20)), (2, cases.prose(40, 20)), (None, cases.prose(41, 30)), (None, "zzz"), (5, cases.prose(42, 15)), (11, "zzz yyy")]
    texts = [cases.prose(40, 20), cases.prose(41, 30), cases.prose(43, 60) + " " + cases.prose(41, 30), "a zzz b", "zzz yyy", cases.prose(42, 15), cases.prose(44, 90), None]
    cases.table(spark, list(enumerate(texts))).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, benchmark = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        want = {r[0]: r[1:] for r in con.execute(queries.OP6_SQL).fetchall()}
    found = decontaminate.decontaminate(docs, benchmark, block_bytes=block_bytes).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(i for i in r["items"] if i).encode()).hexdigest(),
                         r["contaminated"]) for r in found}
    assert got == want and len(found) == len(texts)
    assert {d for d, r in got.items() if r[1]} == {0, 1, 2, 3, 4, 5} and want[1][-1]


def test_decontaminate_empty(spark):
    df, none = cases.table(spark), spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] or r["n_hit"] for r in decontaminate.decontaminate(df, none).collect())
    assert decontaminate.decontaminate(cases.table(spark, []), none).count() == 0


def test_shifts_skip(spark):
    """Cursors meet far fewer positions than there are bytes when no block is one of the strings."""
    patterns = decontaminate.Patterns([(1, cases.prose(1, 40))], 13)
    prefix, block, _, shift, _, own = patterns.classes[0]
    assert prefix >= 48 and shift.max() == prefix - block + 1 and (shift == shift.max()).mean() > 0.9
    strings = strings_of(patterns)
    assert len(strings) == len(own) == 28
    data = np.frombuffer(b" " + cases.prose(2, 400).encode() + strings[own[3]] + b" tail ", dtype=np.uint8)
    where, which = decontaminate.search(patterns, data)
    raw = data.tobytes()
    assert sorted(zip(where, which)) == sorted((i, k) for k, s in strings.items() for i in range(len(raw)) if raw.startswith(s, i))


def strings_of(patterns):
    """The strings by the number of their first word."""
    own = np.concatenate([c[-1] for c in patterns.classes]).astype(np.int64)
    start, size, _ = patterns.spans(own)
    return {int(k): patterns.bytes[a:a + n].tobytes() for k, a, n in zip(own, start, size)}


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_strings_and_their_items(window):
    """Every distinct window once, with all items that have it; repeated, short, empty and null items."""
    shared = cases.prose(1, 30)
    items = [(1, shared), (2, "x " + shared), (1, shared), (None, shared), (3, "a b"), (4, "A, b!"), (5, None), (6, " .. "), (None, "a b"),
             (7, "a a a a a a a a a a a a a a a a"), (8, "é"), (9, " ".join(shared.split()[:13]))]
    want = {}
    for item, text in items:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        for i in range(max(len(words) - window + 1, 1) if words else 0):
            want.setdefault(b" " + b" ".join(words[i:i + window]) + b" ", set()).add(item)
    patterns = decontaminate.Patterns(items, window)
    found = strings_of(patterns)
    assert {s: set(patterns.owners(k)) for k, s in found.items()} == want and len(found) == len(want)
    assert all(len(patterns.owners(k)) == len(set(patterns.owners(k))) for k in found)


def test_tables_are_bounded():
    """What is broadcast for a full block of benchmark text stays below three times that text."""
    items, text = [], 0
    while text < decontaminate.BLOCK_BYTES:
        items.append((len(items), cases.prose(len(items), 2000)))
        text += len(items[-1][1].encode())
    sent = len(pickle.dumps(decontaminate.Patterns(items, 13)))
    assert sent < 3 * text, sent / text


def test_long_items_are_cut_without_losing_a_window(spark):
    """An item far above the block size, and one row many times, hit what they hit as a whole."""
    long = cases.prose(70, 400)
    tests = spark.createDataFrame([(1, long), (None, "q w e"), *[(2, cases.prose(71, 40))] * 300], "item_id long, text string")
    held = list(decontaminate.blocks_of(tests, 600, 13))
    assert sum(len(h) for h in held) < 60 and max(len(t) for h in held for _, t in h) < 250
    docs = cases.table(spark, [(i, f"a {' '.join(long.split()[i:i + 13])} b") for i in range(388)] + [(900, " ".join(long.split()[:12])), (901, cases.prose(71, 40))])
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs, tests, block_bytes=600).collect()}
    assert all(got[i] == (13, ["1"]) for i in range(388)) and got[900] == (0, []) and got[901] == (40, ["2"])


def test_several_passes_carry_rows(spark):
    """Every copy comes back with its own columns."""
    docs = spark.createDataFrame([(1, cases.prose(1, 40), "u"), (1, cases.prose(1, 40), "v"), (None, cases.prose(12, 13), "w"), (2, None, "x")],
                                 "doc_id long, text string, hits string")
    tests = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.decontaminate(docs, tests, block_bytes=60, carry=True).select("doc_id", "n_hit", "text", "row.hits")
    assert cases.ordered(tuple(r) for r in got.collect()) == cases.ordered(
        [(1, 40, cases.prose(1, 40), "u"), (1, 40, cases.prose(1, 40), "v"), (None, 13, cases.prose(12, 13), "w"), (2, 0, None, "x")])


def test_trees_walk_like_rules():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = classifier.fit(x[:2000], y[:2000])

    def walk(row, node):
        for _ in range(model.depth):
            node = model.left[node] if row[model.feature[node]] <= model.limit[node] else model.right[node]
        return model.value[node]

    plain = [model.base + sum(walk(row, r) for r in model.roots) for row in x[2000:2050]]
    assert np.allclose(model.margin(x[2000:2050]), plain)
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97


def test_one_kind_of_label_and_none():
    x = np.zeros((5, 2))
    assert np.allclose(classifier.fit(x, np.ones(5)).score(x), 6 / 7)
    assert np.allclose(classifier.fit(x[:0], np.ones(0)).score(x), 0.5)


def test_features_of_odd_texts(spark):
    rows = cases.table(spark).select("doc_id", "text").toArrow().to_batches()
    values = np.concatenate([classifier.features(c) for c in chunks(rows)])
    assert values.shape[1] == len(classifier.FEATURES) and np.isfinite(values).all()
    assert not values[[i for i, t in enumerate(r for b in rows for r in b.column("text").to_pylist()) if not t]].any()


@have_tables
def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.train(docs, labels)
    turned = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.train(docs, turned)
    assert (model.value == again.value).all()
    got = classifier.quality_scores(docs, model).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95 and len(got) > 40
    assert classifier.quality_scores(cases.table(spark, []), model).count() == 0
    odd = classifier.quality_scores(cases.table(spark), model).collect()
    assert len(odd) == cases.table(spark).count() and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["held_out"] for r in odd if r["doc_id"] is None} == {False}


def test_classifier_does_not_depend_on_the_order(spark):
    """Equal models whatever the partitions are, with ids three times, contradicting labels and two texts of one id."""
    rows = [(i, cases.prose(i, 60) if i % 3 else "### " * (i + 20)) for i in range(200)]
    rows += [(i, t + " more words of another text") for i, t in rows[:40]]
    labels = [(i, int(i % 3 > 0)) for i in range(200)] + [(i, 1) for i in range(0, 60, 3)]

    def model(docs, told):
        return classifier.train(docs, spark.createDataFrame(told, "doc_id long, quality int"))
    df = cases.table(spark, rows)
    first = model(df.coalesce(1), labels)
    for docs, told in ((df.repartition(9), labels[::-1]), (df.unionByName(df).unionByName(df).repartition(5), labels + labels)):
        other = model(docs, told)
        assert first.base == other.base
        for name in ("roots", "feature", "limit", "left", "right", "value"):
            assert np.array_equal(getattr(first, name), getattr(other, name)), name
