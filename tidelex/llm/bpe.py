"""Byte-pair encoding and decoding of whole texts.

A pair of bytes that no vocabulary token holds can never be merged across, so it
marks a certain cut. Texts are first cut at such pairs where the pre-tokenizer
has a border as well (white space, and changes between letters, digits and
marks); the distinct fragments of a chunk are encoded once each, cut again at
such pairs inside their pre-tokens, and the ids are put together by numpy.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidelex.llm.common import CHUNK, Texts, binary_column, chunks, give_back, id_and_text, ragged
from tidelex.llm.ship import shipped

#: Distinct fragments whose ids a worker remembers; more for the library's encoder, whose tasks hold little else.
REMEMBERED, REMEMBERED_BY_LIBRARY = 1 << 17, 400_000
#: Fragments given to the library's encoder as one text.
JOINED = 64
#: Symbols up to which a fragment is merged by scanning its ranks; longer ones use a heap.
SCANNED = 64
#: Letters below this one are the same in all versions of Unicode and normal as they are.
PLAIN_END = "\u0250"

SPACE, LETTER, DIGIT, MARK, QUOTE, WIDE = range(6)
KIND = np.full(256, MARK, dtype=np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[65:91] = KIND[97:123] = LETTER
KIND[48:58] = DIGIT
KIND[39] = QUOTE
KIND[128:] = WIDE
MARKS = bytes(range(256)).translate(None, bytes(b for b in range(256) if KIND[b] != MARK))


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [shown[b] for b in range(256)]


class Vocabulary:
    """A byte-level vocabulary with merges, from a tokenizers JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.path, self.suffix = path, model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        self.library = library
        names = [""] * self.size
        for token, i in [*self.ids.items(), *self.special.items()]:
            names[i] = token
        self.names = names
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[self.ids[left], self.ids[right]] = rank
            self.made.append(self.ids[left + right])
        self.inner = [self.ids[c] for c in self.letters]
        self.final = [self.ids[c + self.suffix] for c in self.letters]
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in self.ids:
            raw = [self.byte_of[c] for c in token.removesuffix(self.suffix) if c in self.byte_of]
            if len(raw) > 1:
                self.joined[raw[:-1], raw[1:]] = True
        self.within = [row.tolist() for row in self.joined]
        self.cuts = self._text_cuts()

    def _text_cuts(self) -> np.ndarray:
        """Byte pairs of raw text that are cut: none of a token, and a border of the pre-tokenizer whatever is around."""
        lower = np.arange(256)
        lower[65:91] += 32
        absent = ~(self.joined | self.joined[lower][:, lower])
        left, right = KIND[:, None], KIND[None, :]
        border = (left != right) & (left != WIDE) & (right != WIDE)
        border &= ~((left == QUOTE) & ((right == LETTER) | (right == MARK))) & ~((left == MARK) & (right == QUOTE))
        border |= (left == DIGIT) & (right == DIGIT)
        space = (left == SPACE) != (right == SPACE)
        return ((absent & border) | space).reshape(-1)

    def encode_word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token: its fragments between certain cuts, one by one."""
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        out, begin = [], 0
        for i in range(1, len(raw)):
            if not self.within[raw[i - 1]][raw[i]]:
                out += self.merge(ids[begin:i])
                begin = i
        return out + self.merge(ids[begin:])

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges by rank, the leftmost first among equals."""
        if len(ids) > SCANNED:
            return self._merge_long(ids)
        never, find = len(self.made), self.ranks.get
        ranks = [find(p, never) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) < never:
            i = ranks.index(rank)
            ids[i:i + 2] = [self.made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = find((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = find((ids[i], ids[i + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.ranks.get((ids[i], ids[j]), -1) != rank:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    before[right] = left
                    if (ids[left], ids[right]) in self.ranks:
                        heapq.heappush(heap, (self.ranks[ids[left], ids[right]], left))
        return [i for i in ids if i >= 0]

    def encode_fragment(self, raw: bytes) -> list[int]:
        """Ids of a fragment. Plain letters, digits and marks are one pre-token each; the tokenizer's own rules
        normalise and cut the rest."""
        if raw.isalpha():
            return self.encode_word(raw.lower())
        if (raw.isdigit() and len(raw) == 1) or not raw.strip(MARKS):
            return self.encode_word(raw)
        text = raw.decode()
        if text in self.special:
            return [self.special[text]]
        lower = text.lower()
        if text.isalpha() and lower.isalpha() and max(text) < PLAIN_END:
            return self.encode_word(lower.encode())
        library = self.library
        if library.normalizer is not None:
            text = library.normalizer.normalize_str(text)
        return [i for word, _ in library.pre_tokenizer.pre_tokenize_str(text)
                for i in self.encode_word(bytes(self.byte_of[c] for c in word))]

    def encode_fragments(self, fragments: list[bytes]) -> list[list[int]]:
        return [self.encode_fragment(f) for f in fragments]

    def encode_flat(self, fragments: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The fragments in some order, their ids one after another, and the number of ids of each."""
        lists = self.encode_fragments(fragments)
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        return fragments, np.fromiter(chain.from_iterable(lists), np.uint32, int(length.sum())), length


def one_word(raw: bytes) -> bool:
    """Whether a fragment is one pre-token for certain, whatever is around it: plain letters, one digit, or marks."""
    if raw.isalpha() or (len(raw) == 1 and raw.isdigit()) or not raw.strip(MARKS):
        return True
    text = raw.decode()
    return text.isalpha() and max(text) < PLAIN_END and text.lower().isalpha()


class LibraryVocabulary(Vocabulary):
    """The same cuts, with fragments encoded by the tokenizers library.

    Fragments that are one pre-token each are given to it many at a time, with a space between: the last id of a
    pre-token, and no other, has the suffix of a word's end. That needs such a suffix, and no special token that is
    one pre-token or holds a space.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.ends = np.array([bool(self.suffix) and name.endswith(self.suffix) for name in self.names])
        self.joins = bool(self.suffix) and not any(one_word(t.encode()) or any(c.isspace() for c in t) for t in self.special)

    def encode_fragments(self, fragments: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([f.decode() for f in fragments], add_special_tokens=False)]

    def encode_flat(self, fragments: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        words, others = [], []
        for f in fragments:
            (words if self.joins and one_word(f) else others).append(f)
        lists = self.encode_fragments([b" ".join(words[i:i + JOINED]) for i in range(0, len(words), JOINED)])
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or len(ids) != (stops[-1] if len(stops) else 0):
            return super().encode_flat(fragments)
        _, more, length = super().encode_flat(others)
        return words + others, np.concatenate((ids, more)), np.concatenate((np.diff(stops, prepend=0), length))


@lru_cache(maxsize=4)
def vocabulary(path: str, library: bool = False) -> Vocabulary:
    """One vocabulary per worker."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return LibraryVocabulary(path) if library else Vocabulary(path)


class Remembered:
    """Ids of fragments that were seen before, as one run of ids with a start and a length for each."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.most = REMEMBERED_BY_LIBRARY if isinstance(vocab, LibraryVocabulary) else REMEMBERED
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def places(self, fragments: list[bytes]) -> np.ndarray:
        """Where each fragment is; new ones are encoded."""
        if len(self.place) > self.most:
            self.clear()
        new = [f for f in fragments if f not in self.place]
        if new:
            new, ids, length = self.vocab.encode_flat(new)
            total = len(ids)
            if self.used + total > len(self.ids):
                self.ids = np.concatenate((self.ids[:self.used], np.empty(max(total, self.used), np.uint32)))
            self.ids[self.used:self.used + total] = ids
            self.place.update(zip(new, range(len(self.length), len(self.length) + len(new)), strict=True))
            self.start = np.concatenate((self.start, self.used + np.cumsum(length) - length))
            self.length = np.concatenate((self.length, length))
            self.used += total
        return np.fromiter(map(self.place.__getitem__, fragments), np.int64, len(fragments))


_remembered: dict[tuple[str, bool], Remembered] = {}


def forget() -> None:
    """Drop the vocabularies and the remembered fragments at the end of a task: together some 50 MB and more a worker,
    which later stages would find taken. Reading a vocabulary takes about 0.3 s a task."""
    _remembered.clear()
    vocabulary.cache_clear()
    give_back()


def encode(chunk: Texts, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk, one after another, and the bounds of each text."""
    buf, off = chunk.buf, chunk.off
    cut = np.zeros(len(buf) + 1, dtype=bool)
    if len(buf) > 1:
        cut[1:-1] = vocab.cuts[(buf[:-1].astype(np.uint16) << 8) | buf[1:]]
    cut[off] = True
    space = KIND[buf] == SPACE
    _cut_specials(buf, off, vocab, cut)
    start = np.flatnonzero(cut[:-1])
    size = np.diff(np.append(start, len(buf)))
    solid = ~space[start]
    per = np.concatenate(([0], np.cumsum(solid)))[np.searchsorted(start, off)]
    bounds = np.concatenate(([0], np.cumsum(size[solid])))
    coded = binary_column(buf[~space], bounds).dictionary_encode()
    kind = vocab.path, type(vocab) is LibraryVocabulary
    known = _remembered.get(kind) or _remembered.setdefault(kind, Remembered(vocab))
    place = known.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    times = known.length[place]
    ids = known.ids[np.repeat(known.start[place], times) + ragged(times)]
    return ids, np.concatenate(([0], np.cumsum(times)))[per]


def _cut_specials(buf: np.ndarray, off: np.ndarray, vocab: Vocabulary, cut: np.ndarray) -> None:
    """A special token written out in a text is one fragment; the leftmost one counts where two overlap."""
    raw, found = None, []
    for token in vocab.special:
        word = token.encode()
        raw = buf.tobytes() if raw is None else raw
        at = raw.find(word)
        while at >= 0:
            found.append((at, at + len(word)))
            at = raw.find(word, at + 1)
    last = 0
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= last and np.searchsorted(off, a, side="right") == np.searchsorted(off, b, side="left"):
            cut[a + 1:b] = False
            cut[a] = cut[b] = True
            last = b


def decode(ids: np.ndarray, bounds: np.ndarray, vocab: Vocabulary) -> pa.Array:
    """Texts of id runs: token strings with a space between, as the tokenizer without a decoder gives them."""
    names = pa.array(vocab.names, pa.large_string()).take(pa.array(ids))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), names), pa.scalar(" ", pa.large_string()))


def _encoded(batches, path: str):
    vocab = vocabulary(path)
    for chunk in chunks(batches, size=CHUNK // 2):
        ids, bounds = encode(chunk, vocab)
        yield pa.RecordBatch.from_arrays(
            [chunk.rows.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), binary_column(ids.astype("<u4"), bounds * 4).cast(pa.binary())],
            ["doc_id", "n_tokens", "ids"])
    vocab = chunk = ids = bounds = None
    forget()


def _decoded(batches, path: str):
    vocab = vocabulary(path)
    for chunk in chunks(batches, "ids"):
        ids = chunk.buf.view("<u4") if chunk.buf.flags.aligned else np.frombuffer(chunk.buf.tobytes(), dtype="<u4")
        yield chunk.rows.append_column("decoded", decode(ids, chunk.off // 4, vocab).cast(pa.string()))
    vocab = chunk = ids = None
    forget()


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts: doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers).

    Defined cases: a null or empty text has no ids; special tokens written out
    in a text get their ids; rows without an id are encoded too; other columns
    are ignored; no rows give no rows.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(
        lambda b: _encoded(b, tokenizer), "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``decoded``, the text of column ``ids``; null ids give an empty text."""
    shipped(encoded.sparkSession)
    kept = encoded.select("doc_id", "n_tokens", "ids")
    return kept.mapInArrow(lambda b: _decoded(b, tokenizer), "doc_id long, n_tokens long, ids binary, decoded string")
