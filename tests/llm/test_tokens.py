"""Encoding, token files and token counts against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import cases
from tidelex.llm import bpe, packing, token_counts
from tidelex.llm.common import chunks
from tidelex.llm.files import Written
from tidelex.llm.graph import stored
from tidelex.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_round_trip(spark, library):
    df = cases.table(spark, [*cases.pairs(cases.table(spark)), (900, "a<|endoftext|>b <|startoftext|> <|start"), (901, "don't!'t 12x É")])
    got = cases.ordered(tuple(r) for r in bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).select(
        "doc_id", "n_tokens", F.sha2("ids", 256), "decoded").collect())
    want = []
    for doc, text in cases.pairs(df):
        ids = ids_of(library, text)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     library.decode(ids, skip_special_tokens=False)))
    assert got == cases.ordered(want)


@pytest.mark.parametrize("own", [True, False])
def test_random_texts(library, own):
    rng = random.Random(1)
    parts = ["a", "B", "é", "é", "ß", "İ", "Σ", "1", "٣", "²", "'", "'s", "'re", "!", "..", "-", " ", "\n", " ", " ", "\x85",
             "日本", "😀", "<|endoftext|>", "<|end", "́", "ﬁ", "क", "सि", "\x00", "ᄀ", "ᅡ", "<", "̸", "tion", "the", "zu"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdeintré") for _ in range(n)) for n in (63, 64, 65, 66, 400, 5000)]
    vocab, i = bpe.vocabulary(PATH, library=not own), 0
    for chunk in chunks([pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})], size=10_000):
        ids, bounds = bpe.encode(chunk, vocab)
        for a, b in zip(bounds, bounds[1:]):
            assert ids[a:b].tolist() == ids_of(library, texts[i]), repr(texts[i])
            i += 1
    assert i == len(texts)


def test_forgets_and_goes_on(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    known = bpe.Remembered(bpe.vocabulary(PATH))
    for words in (["alpha", "beta", "gamma"], ["delta", "alpha"], ["beta"]):
        place = known.places([w.encode() for w in words])
        for p, w in zip(place, words):
            assert known.ids[known.start[p]:known.start[p] + known.length[p]].tolist() == ids_of(library, w)


def test_words_are_encoded_many_at_a_time(library, monkeypatch):
    """One text of the library holds many fragments, and each gets its own ids; those that are no certain word stay alone."""
    rng = random.Random(3)
    parts = ["Abc", "zu", "É", "ß", "İ", "ª", "ŉ", "ǰ", "1", "12", "'s", "!", "</", "w>", "<|endoftext|>", "\x00", "日", "Σ", "́", "-"]
    texts = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(2000)})
    fragments = [t.encode() for t in texts if t.strip()] + ["".join(rng.choices("abcdé", k=300)).encode()]
    vocab, given = bpe.vocabulary(PATH, library=True), []
    encode = vocab.encode_fragments
    monkeypatch.setattr(vocab, "encode_fragments", lambda x: given.append(len(x)) or encode(x))
    order, ids, length = vocab.encode_flat(fragments)
    assert sorted(order) == sorted(fragments) and len(given) == 2
    words = sum(map(bpe.one_word, fragments))
    assert words > 100 and sum(given) == -(-words // bpe.JOINED) + len(fragments) - words
    for f, run in zip(order, np.split(ids, np.cumsum(length)[:-1])):
        assert run.tolist() == ids_of(library, f.decode()), f


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_pack(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = rng.integers(0, 1 << bits, n)
        data = packing.pack(ids, bits)
        assert len(data) == -(-n // 64) * 8 * bits
        assert packing.unpack(data.tobytes(), bits, n).tolist() == ids.tolist()


def test_token_files(spark, library, monkeypatch):
    df = cases.table(spark).repartition(5)
    files = packing.write_tokens(df, PATH, end_id=1)
    got = packing.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(
        (d for d, _ in cases.pairs(df)), key=lambda d: (d is not None, d or 0))
    want = cases.ordered((d, len(ids_of(library, t)) + 1, zlib.crc32(np.array([*ids_of(library, t), 1], dtype="<u4").tobytes()))
                         for d, t in cases.pairs(df))
    assert cases.ordered((r[0], r[2], r[3]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_random_access(tmp_path):
    rng = np.random.default_rng(4)
    sizes = np.array([0, 1, 9000, 4096, 3])
    ids = rng.integers(0, 49_408, sizes.sum()).astype(np.uint32)
    writer = packing.TokenWriter(f"file:{tmp_path}/a.bin", 16)
    writer.add([None, 4, 5], sizes[:3], ids[:9001])
    writer.add([6, 7], sizes[3:], ids[9001:])
    writer.close()
    source = packing.TokenFile(f"file:{tmp_path}/a.bin")
    assert source.missing == 1 and source.docs.tolist() == [0, 4, 5, 6, 7]
    ends = np.cumsum(sizes)
    for i, (a, b) in enumerate(zip(ends - sizes, ends)):
        assert (source.document(i) == ids[a:b]).all()
    assert (source.ids(4000, 4200) == ids[4000:4200]).all()
    with pytest.raises(ValueError):
        (tmp_path / "b.bin").write_bytes(b"x" * 100)
        packing.TokenFile(f"{tmp_path}/b.bin")


def test_token_counts(spark, library):
    df = cases.table(spark).repartition(5)
    got = token_counts.document_tokens(df, PATH).collect()
    assert cases.ordered((r["doc_id"], r["n_tokens"], r["ended"]) for r in got) == cases.ordered(
        (d, len(ids_of(library, t)), True) for d, t in cases.pairs(df))


@pytest.mark.parametrize("width", [2, 4])
def test_counts_across_blocks(spark, tmp_path, width):
    """Documents over several blocks, empty ones, an unended tail and an empty file."""
    sizes = {0: [5, 0, 0, 40, 3, 1], 1: [100], 2: [], 3: [0], 4: [7, 30]}
    rows = []
    for part, docs in sizes.items():
        flat = [x for n in docs for x in [*range(1, n + 1), 0]]
        flat = flat[:-1] if part == 4 else flat
        with Written(f"file:{tmp_path}/{part}.bin") as out:
            out.write(np.array(flat, dtype=f"<u{width}").tobytes())
        rows.append((part, f"file:{tmp_path}/{part}.bin"))
    files = stored(spark.createDataFrame(rows, "part int, uri string"), "flat-list")
    got = token_counts.count_tokens(files, 0, width, block_bytes=8 * width + 1).orderBy("part", "position").collect()
    assert [(r["part"], r["n_tokens"]) for r in got] == [(p, n) for p, docs in sizes.items() for n in docs]
    assert [r["part"] for r in got if not r["ended"]] == [4]
    for r in got:
        assert r["start"] == sum(sizes[r["part"]][:r["position"]]) + r["position"]


def test_empty_tables(spark):
    df = cases.table(spark, [])
    assert bpe.bpe_encode(df, PATH).count() == 0
    assert packing.read_tokens(packing.write_tokens(df, PATH, end_id=1)).count() == 0
    assert token_counts.document_tokens(df, PATH).count() == 0
