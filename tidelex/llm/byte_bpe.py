"""Byte-level byte-pair encoding and decoding as Spark expressions.

Texts are split by the vocabulary's pattern. Distinct frequent words are encoded
once: their bytes, as one-byte pieces, are folded by merges in the order of their
ranks, which come from a literal map. Every text then looks its words up; the
others are folded in the text, once each. Decoding joins the bytes of the pieces.

While a word is folded a piece is one character and the word a string: in lambda
functions Spark cuts and replaces strings in a tenth of a microsecond, while
joining or cutting arrays takes more than one. Bytes to decode are hex digits,
as Spark joins strings and has no such function for binary values.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import cached_property, lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.binding import let
from tidelex.llm.common import partitions

#: Words whose ids are looked up; all others are folded where they stand. It bounds the literal map.
REMEMBERED = 1 << 17
#: Pieces up to which pairs are cut from the string one by one, which starts at its first character each time.
SHORT = 64
#: Rank of a pair that no token holds.
NEVER = (1 << 31) - 1

Find = Callable[[Column], Column]


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank (the id) from a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path}: no token for the bytes {missing[:5]}")
    return ranks


def _literal(entries: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(entries, ensure_ascii=False, separators=(",", ":"))), f"array<{kind}>")


class Lookup:
    """A literal map from strings, none empty, as two flat arrays: every key is in one of two places that its XXH64 names.

    A lookup reads two entries at most, where Spark's own map literal is searched from its first key on.
    """

    def __init__(self, entries: dict[str, object], value: str):
        size = 256
        while size * 2 < 5 * len(entries):
            size *= 2
        while (placed := _placed(entries, size)) is None:
            size *= 2
        self.mask = size - 1
        # A place without a key is short in text, as the driver keeps plans as text, with their literals.
        empty = [] if value.startswith("array") else None
        keys, values = [k or "" for k in placed], [empty if k is None else entries[k] for k in placed]
        self.keys, self.values = _literal(keys, "string"), _literal(values, value)

    def within(self, body: Callable[[Find], Column]) -> Column:
        """``body`` with a function from keys to values (null if absent); the literals stand in the plan once."""
        def find(keys: Column, values: Column, key: Column) -> Column:
            h = F.xxhash64(key)
            one, two = (x.bitwiseAND(F.lit(self.mask)).cast("int") for x in (h, F.shiftrightunsigned(h, 32)))
            return F.when(F.get(keys, one) == key, F.get(values, one)).when(F.get(keys, two) == key, F.get(values, two))
        return let(self.keys, lambda keys: let(self.values, lambda values: body(lambda key: find(keys, values, key))))


def _placed(entries: dict[str, object], size: int) -> list[str | None] | None:
    """Each key at one of its two places, moving others to their second one; None if that does not end."""
    at: list[str | None] = [None] * size
    for key in entries:
        place = None
        for _ in range(500):
            h = xxhash.xxh64_intdigest(key.encode(), seed=42)
            one, two = h & (size - 1), (h >> 32) & (size - 1)
            place = two if place == one or (place is None and at[one] is not None and at[two] is None) else one
            at[place], key = key, at[place]
            if key is None:
                break
            h = xxhash.xxh64_intdigest(key.encode(), seed=42)
        else:
            return None
    return at


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The last two pieces that merges in the order of their ranks make of a token, or more where they do not reach it."""
    pieces = [bytes([x]) for x in token]
    while len(pieces) > 2:
        rank, at = min((ranks.get(x + y, NEVER), i) for i, (x, y) in enumerate(zip(pieces, pieces[1:])))
        if rank == NEVER:
            break
        pieces[at:at + 2] = [pieces[at] + pieces[at + 1]]
    return pieces


@lru_cache(maxsize=4)
def _merges(path: str) -> tuple[dict[tuple[bytes, bytes], int], bool]:
    """Pairs of tokens that can meet and merge, with their union's rank, and whether the vocabulary was made by merges.

    Then merges reach every token, from one pair only, and a union has a higher rank than its parts: all places of
    the pair of the smallest rank can be merged at once. Else every cut of a token into two tokens is a pair.
    """
    ranks = read_ranks(path)
    made, pairs = True, {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = _parts(token, ranks)
            made = made and len(parts) == 2 and all(len(x) == 1 or ranks.get(x, NEVER) < rank for x in parts)
            if not made:
                break
            pairs[parts[0], parts[1]] = rank
    if not made:
        pairs = {(token[:i], token[i:]): rank for token, rank in ranks.items()
                 for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
    return pairs, made


def _mark(token: bytes, rank: int) -> str:
    """The character a token is written as: of one byte the character of that number, so that ISO 8859-1 writes bytes."""
    return token.decode("latin-1") if len(token) == 1 else chr(rank + 0x100 + (0x800 if rank + 0x100 >= 0xD800 else 0))


def _pairs(marks: Column) -> Column:
    """All neighbours in a string, two characters each; of a single character that one, which is no pair."""
    short = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(marks) - 1, F.lit(1))), lambda i: F.substring(marks, i, F.lit(2)))
    long = let(F.split(marks, ""), lambda c: F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda x, y: F.concat(x, y)))
    return F.when(F.char_length(marks) <= SHORT, short).otherwise(long)


class Ranks:
    """A rank file as literals, each made when it is first asked for: pairs of tokens to the rank (the id) of their
    union, and by id the hex bytes and the id's own bytes."""

    def __init__(self, path: str):
        self.path = path
        self.ranks = read_ranks(path)

    def _by_id(self, write: Callable[[bytes, int], str]) -> Column:
        entries: list[str | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            entries[rank] = write(token, rank)
        return _literal(entries, "string")

    @cached_property
    def made(self) -> bool:
        return _merges(self.path)[1]

    @cached_property
    def pairs(self) -> Lookup:
        return Lookup({"".join(_mark(x, self.ranks[x]) for x in pair): rank for pair, rank in _merges(self.path)[0].items()}, "int")

    @cached_property
    def whole(self) -> Lookup | None:
        """Whole words that are tokens, where merges need not reach them."""
        return None if self.made else Lookup({token.decode("latin-1"): rank for token, rank in self.ranks.items()}, "int")

    @cached_property
    def marks(self) -> Column:
        return self._by_id(_mark)

    @cached_property
    def ids(self) -> Column:
        places = {ord(_mark(token, rank)): rank for token, rank in self.ranks.items()}
        return _literal([places.get(i) for i in range(max(places) + 1)], "int")

    @cached_property
    def tokens(self) -> Column:
        return self._by_id(lambda token, _: token.hex())

    @cached_property
    def little(self) -> Column:
        return _literal([i.to_bytes(4, "little").hex() for i in range(max(self.ranks.values()) + 1)], "string")

    def _folded(self, word: Column, find: Find, marks: Column) -> Column:
        """A word's bytes, a character each, after all merges: the leftmost pair of the smallest rank is merged until
        no pair is a token.

        The state holds the pieces as one string, the ranks of all neighbours and the smallest of them, null at the end.
        """
        def state(pieces: Column) -> Column:
            return let(F.transform(_pairs(pieces), find), lambda ranks: F.struct(
                pieces.alias("pieces"), ranks.alias("ranks"), F.array_min(ranks).alias("least")))

        def merge(old: Column, _: Column) -> Column:
            pieces, made = old["pieces"], F.get(marks, old["least"])
            at = F.array_position(old["ranks"], old["least"]).cast("int")
            if self.made:
                after = F.replace(pieces, F.substring(pieces, at, F.lit(2)), made)
            else:
                after = F.concat(F.substring(pieces, F.lit(1), at - 1), made, F.substring(pieces, at + 2, F.char_length(pieces)))
            return F.when(old["least"].isNotNull(), let(after, state)).otherwise(old)

        return let(word, lambda w: F.aggregate(F.sequence(F.lit(1), F.char_length(w)), state(w), merge, lambda s: s["pieces"]))

    def encoder(self, body: Callable[[Find], Column]) -> Column:
        """``body`` with a function from a word to its ids, as an array: the word itself if it is a token, else its
        bytes after all merges."""
        def numbers(marks: Column, ids: Column, find: Find) -> Find:
            def of(word: Column) -> Column:
                folded = F.transform(F.split(self._folded(word, find, marks), ""), lambda mark: F.get(ids, F.ascii(mark)))
                if self.whole is None:
                    return folded
                return self.whole.within(lambda find: let(find(word), lambda id: F.when(id.isNotNull(), F.array(id)).otherwise(folded)))
            return lambda word: let(F.decode(word.cast("binary"), "ISO-8859-1"), of)
        return self.pairs.within(lambda find: let(self.marks, lambda marks: let(self.ids, lambda ids: body(numbers(marks, ids, find)))))

    def joined(self, ids: Column, entries: Column) -> Column:
        """The bytes that ``entries`` has for each id, one after another."""
        def of(held: Column) -> Column:
            return F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(held, i), F.raise_error(
                F.concat(F.lit("no token has the id "), F.coalesce(i.cast("string"), F.lit("null")))))), "")
        return F.unhex(F.coalesce(let(entries, of), F.lit("")))


def words_of(text: Column, pattern: str) -> Column:
    """All matches of the splitting pattern, with the Unicode classes of white space."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"(?U)({pattern})"), F.lit(0))


def byte_bpe_encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                    remembered: int = REMEMBERED) -> DataFrame:
    """Token ids of whole texts: doc_id, n_tokens, ids (array of int).

    Two passes over the texts: words are counted (an aggregate with a map-side
    part, so a frequent word is one row a task) and the ``remembered`` most
    frequent ones are encoded once; then every text is encoded without a shuffle.
    Which words are remembered changes the work, not the ids.

    Defined cases: a null or empty text has no ids; rows without an id and
    repeated rows are encoded too; other columns are ignored; no rows give no
    rows. Special tokens written out in a text are ordinary text. A very long
    text is one array of words; a very long word is one fold, in as many steps
    over its pieces as it has different merges (with a rank file not made by merges, as many as it has merges). Letters and digits are those of
    the Unicode version of the Java runtime.
    """
    vocabulary = Ranks(ranks)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    counted = texts.select(F.explode(words_of(F.col("text"), pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    frequent = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(remembered).select("word").repartition(partitions(docs))
    encoded = frequent.select("word", vocabulary.encoder(lambda ids: ids(F.col("word"))).alias("ids"))
    # One job: each job of an iterator over partitions would send the literals of the vocabulary again.
    known = Lookup({r.word: r.ids for r in encoded.collect()}, "array<int>")
    numbers = known.within(lambda find: vocabulary.encoder(lambda fold: F.flatten(
        F.transform(words_of(F.col("text"), pattern), lambda word: F.coalesce(find(word), fold(word))))))
    return texts.select("doc_id", numbers.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


def ids_bytes(ids: Column, ranks: str) -> Column:
    """Ids as little-endian unsigned 32-bit integers."""
    vocabulary = Ranks(ranks)
    return vocabulary.joined(ids, vocabulary.little)


def byte_bpe_decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids of column ``ids`` one after another.

    They need not be valid UTF-8. Null or no ids give no bytes; an id that no
    token has, and a null among the ids, fails.
    """
    vocabulary = Ranks(ranks)
    return encoded.withColumn("decoded", vocabulary.joined(F.col("ids"), vocabulary.tokens))
