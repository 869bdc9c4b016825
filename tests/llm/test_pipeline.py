"""The corpus pipeline, stage by stage, on a small corpus with planted cases."""

import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import cases
from tidelex.llm import bpe, common, decontaminate, minhash, quality, suffix
from tidelex.llm import exchange as ex
from tidelex.llm.graph import stored
from tidelex.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, junk, an exact and a near copy, a shared passage and a benchmark passage."""
    folder = tmp_path_factory.mktemp("sf")
    clean = [(i, cases.prose(i, 150)) for i in range(40)]
    shared, item = cases.prose(500, 30), cases.prose(600, 20)
    rows = clean + [(100, clean[3][1]), (101, clean[4][1].replace(" ", "  ", 3) + " end"), (102, cases.prose(700, 90) + " " + shared),
                    (103, cases.prose(701, 90) + " " + shared), (104, cases.prose(702, 100) + " " + item), (105, "short text"),
                    (106, "spam " * 80), (107, " ".join(f"### {w}" for w in cases.prose(800, 90).split())), (108, None), (None, cases.prose(900, 70))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(107, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, texts, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, corpus), name)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "bpe_encoding" or docs.columns == columns
    first = seen["quality_rules"].keys()
    assert first == texts.keys() - {105, 106, 107, 108}
    assert seen["near_duplicates"].keys() == first - {100, 101}
    cut = seen["suffix_dedup"]
    assert cut.keys() == first - {100, 101}
    assert {d for d in cut if cut[d]["text"] != texts[d]} == {103} and cases.prose(500, 30) not in cut[103]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    assert seen["decontamination"].keys() == cut.keys() - {104}
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path())
    for d, r in seen["bpe_encoding"].items():
        assert r["n_tokens"] == len(library.encode(cut[d]["text"], add_special_tokens=False).ids)


def test_last_stage_decodes(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id < 10")
    library, got = Tokenizer.from_file(tokenizer_path()), corpus_pipeline.encoded(spark, docs, corpus).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == 10
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_and_empty(spark, corpus, tmp_path):
    assert corpus_pipeline.run(spark, corpus).count() == spark.read.parquet(f"{corpus}/documents.parquet").count() - 7
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for path in (root / "tidelex").rglob("*.py"):
        if path.parent.name != "llm":
            assert "llm" not in path.read_text()


def test_tasks_leave_no_memory(monkeypatch):
    """The workers of one stage wait beside those of the next: each task gives back what it freed, and its vocabulary."""
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(30), pa.int64()), "text": [cases.prose(i, 60) for i in range(30)]})
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    lanes = ex.Lanes(1, 24)
    tasks = [minhash.signatures([rows], 5, 40, 5, 4),
             quality.scored([rows], np.zeros(1 << 8, np.float32), 8, 0.0, ()),
             suffix.offers([rows], lanes, 50, 16),
             decontaminate.scan([rows.append_column("row_key", rows.column("doc_id"))], decontaminate.Patterns([(1, "a b c")], 13)),
             *(work([]) for work in (minhash.band_rows, quality.summed, decontaminate.merged, suffix.remove)),
             quality.banded([], 16, 5), quality.counted([], 8), minhash.likely([], 200, 4, 0.6), minhash.linked([], 5, 80),
             minhash.across([], 200, 4, 0.6, 5, 80), decontaminate.cut_items([], 13, 100)]
    for i, task in enumerate(tasks):
        assert len(given) == i
        list(task)
    assert len(given) == len(tasks)
    (ids,) = bpe._encoded([rows], tokenizer_path())
    assert bpe.vocabulary.cache_info().currsize == 0
    list(bpe._decoded([ids], tokenizer_path()))
    assert bpe.vocabulary.cache_info().currsize == 0
