"""Text assembly, cleaning, language detection and token filtering.

All steps are column expressions over the whole text; a row is never moved.
Rare blanks are turned into spaces first, so that the patterns can use the
short ASCII classes. Costly patterns run only on texts that hold the character
they look for.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.binding import let
from tidelex.functions.jsonfn import is_object, string_only, variant
from tidelex.functions.wordlists import LANGUAGE_WORDS, LEMMA_EXCEPTIONS, LEMMA_RULES, STOP_WORDS

# Workers get this module's functions and classes by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TARGET_LANGUAGE = "en"
UNKNOWN_LANGUAGE = "unknown"

# Payload keys that may hold text, in reading order.
TEXT_KEYS = ("text", "title", "selftext", "body", "message")

# Every blank Python's ``str.split`` knows, as a class body and as characters.
BLANK = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RARE_BLANK = r"\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RARE_BLANK_GATE = r"[\x1c-\x1f\x85\xa0\x{1680}-\x{3000}]"
BLANK_CHARS = "".join(chr(c) for c in [
    *range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
    0x2028, 0x2029, 0x202f, 0x205f, 0x3000])
WORD = r"\p{L}\p{N}_"
URL_PATTERN = r"(?:http|www)\S+"
EMAIL_PATTERN = r"(?<!\S)[^\s@]*@\S*\s?"
MENTION_PATTERN = f"@[{WORD}]+"
HASHTAG_PATTERN = f"#[{WORD}]+"
# Code points with the emoji property, without digits and signs of ASCII and Latin-1.
EMOJI_POINTS = """
203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE
2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660
2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5
26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721
2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C
2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A
1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD
1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8
1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5
1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945
1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8
"""
EMOJI_BLOCKS = tuple((int(part.split("-")[0], 16), int(part.split("-")[-1], 16)) for part in EMOJI_POINTS.split())
EMOJI_GATE = r"[\x{203C}-\x{1FAFF}]"
EMOJI_CLASS = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in EMOJI_BLOCKS) + "]"
PREVIEW_CHARS = 100
LENGTH_CAP = 5000


def has_only_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _replace_each(text: Column, chars: str) -> Column:
    """Literal replacements by a space; a search for one byte is far cheaper than a pattern."""
    for ch in chars:
        text = F.replace(text, F.lit(ch), F.lit(" "))
    return text


def plain_blanks(text: Column) -> Column:
    """Blanks outside ASCII (and separators) as plain spaces."""
    wide = ~has_only_ascii(text) & text.rlike(RARE_BLANK_GATE)
    return F.when(wide, F.regexp_replace(text, f"[{RARE_BLANK}]", " ")).otherwise(
        _replace_each(text, "\x1c\x1d\x1e\x1f"))


def strip_blank(text: Column) -> Column:
    """Remove blanks of any script from both ends."""
    return F.trim(text, F.lit(BLANK_CHARS))


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but blanks."""
    return ~F.coalesce(text.rlike(f"[^{BLANK}]"), F.lit(False))


def _assembled(parsed: Column) -> Column:
    parts = [let(string_only(parsed, key), lambda v: F.when(~is_blank(v), strip_blank(v))) for key in TEXT_KEYS]
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def assemble_text(payload: Column) -> Column:
    """The non-blank string values of the text keys, trimmed and joined with one space."""
    return let(variant(payload), _assembled)


def event_text(content: Column, payload: Column) -> Column:
    """The text to analyse of an event.

    The content, or, when it is blank, the text assembled from the payload. If
    that is a JSON object, its ``text``; if the outcome is blank, the payload's
    ``text``; at last the empty string. Only a text that opens a brace is parsed.
    """
    given = F.when(is_blank(content), F.coalesce(assemble_text(payload), content)).otherwise(content)

    def of_object(text: Column) -> Column:
        opens = F.coalesce(text.rlike(r"^\s*\{"), F.lit(False))
        return let(F.when(opens, variant(text)), lambda obj: F.when(
            is_object(obj), F.coalesce(string_only(obj, "text"), F.lit(""))).otherwise(text))

    def or_payload(text: Column) -> Column:
        return F.when(is_blank(text), F.coalesce(string_only(variant(payload), "text"), F.lit(""))).otherwise(text)

    return let(let(given, of_object), or_payload)


def strip_urls(text: Column) -> Column:
    return F.when(text.contains("http") | text.contains("www"),
                  F.regexp_replace(text, URL_PATTERN, "")).otherwise(text)


def strip_emails(text: Column) -> Column:
    """Drop each token with an at sign, and one blank after it."""
    return F.when(text.contains("@"), F.regexp_replace(text, EMAIL_PATTERN, "")).otherwise(text)


def strip_mentions(text: Column) -> Column:
    return F.when(text.contains("@"), F.regexp_replace(text, MENTION_PATTERN, "")).otherwise(text)


def strip_hashtags(text: Column) -> Column:
    return F.when(text.contains("#"), F.regexp_replace(text, HASHTAG_PATTERN, "")).otherwise(text)


@lru_cache(maxsize=1)
def emoji_names() -> dict[str, str]:
    """Symbol to Unicode name in lower case with underscores."""
    names = {}
    for first, last in EMOJI_BLOCKS:
        for code in range(first, min(last, sys.maxunicode) + 1):
            name = unicodedata.name(chr(code), "")
            if name:
                names[chr(code)] = name.lower().replace(" ", "_").replace("-", "_")
    return names


def emoji_to_name(text: Column) -> Column:
    """Write each emoji as `` :name: ``; texts without one are passed through."""
    # One literal that the optimizer turns into a constant map.
    table = F.str_to_map(F.lit("|".join(f"{ch}={name}" for ch, name in emoji_names().items())),
                         F.lit("[|]"), F.lit("="))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(EMOJI_CLASS), F.lit(0)))
    spaced = lambda ch: F.coalesce(F.concat(F.lit(" :"), F.try_element_at(table, ch), F.lit(": ")), ch)
    named = F.aggregate(found, text, lambda acc, ch: F.replace(acc, ch, spaced(ch)))
    wide = ~has_only_ascii(text) & text.rlike(EMOJI_GATE)
    return F.when(wide, named).otherwise(text)


def one_line(text: Column) -> Column:
    """Line breaks and tabs as spaces."""
    return _replace_each(text, "\t\n\x0b\f\r")


def single_spaces(text: Column) -> Column:
    """Runs of spaces to one, no space at the ends."""
    return F.trim(F.when(text.contains("  "), F.regexp_replace(text, "  +", " ")).otherwise(text))


CLEANING_STEPS = (plain_blanks, strip_urls, strip_emails, strip_mentions, strip_hashtags, emoji_to_name,
                  one_line, single_spaces)


def basic_clean(text: Column) -> Column:
    """URLs, e-mails, mentions and hashtags out, emoji to names, blanks squeezed."""
    for step in CLEANING_STEPS:
        text = let(text, step)
    return text


def letter_runs(text: Column) -> Column:
    """The lower-cased words of a text, a word being a run of letters."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def among(tokens: Column, words: list[str]) -> Column:
    """The tokens that are in a word list."""
    return F.filter(tokens, lambda t: t.isin(words))


def tokens_of(text: Column) -> Column:
    """Lower-cased tokens of a text whose blanks are single spaces."""
    return F.split(F.lower(text), " ")


def language(tokens: Column) -> Column:
    """Struct (code, confidence): the language with the most function words, and its share of all hits.

    ``tokens`` is an array of lower-cased words. Only the function words among
    them are compared with the list of each language.
    """
    codes = F.array(*[F.lit(code) for code in LANGUAGE_WORDS])
    every = sorted({w for words in LANGUAGE_WORDS.values() for w in words})

    def decide(counts: Column) -> Column:
        best = F.array_max(counts)
        total = F.aggregate(counts, F.lit(0), lambda acc, n: acc + n)
        code = F.when(best > 0, F.element_at(codes, F.array_position(counts, best).cast("int"))).otherwise(
            F.lit(UNKNOWN_LANGUAGE))
        return F.struct(code.alias("code"), F.when(best > 0, best / total).alias("confidence"))

    return let(among(tokens, every), lambda hits: let(
        F.array(*[F.size(among(hits, words)) for words in LANGUAGE_WORDS.values()]), decide))


def keep_words(tokens: Column) -> Column:
    """Tokens made of letters only, without stop words.

    A token with punctuation on it is dropped, not trimmed.
    """
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS) & t.rlike(r"^\p{L}++$"))


def filter_tokens(text: Column) -> Column:
    """The kept words of a text, joined with spaces."""
    return F.array_join(keep_words(tokens_of(text)), " ")


def lemma(token: Column) -> Column:
    """The base form of a lower-cased English word: by the list of exceptions, else by the first rule whose suffix it
    has and whose result has three letters or more; other words stay as they are."""
    listed = F.create_map(*[F.lit(x) for pair in LEMMA_EXCEPTIONS.items() for x in pair])
    found = F.lit(None).cast("string")
    for suffix, cut, added in reversed(LEMMA_RULES):
        stem = F.concat(F.left(token, F.length(token) - cut), F.lit(added)) if cut or added else token
        found = F.when(token.endswith(suffix) & (F.length(token) >= 3 + cut - len(added)), stem).otherwise(found)
    return F.coalesce(listed[token], found, token)


def rule_lemmas(text: Column) -> Column:
    """Base forms of the kept words of a text, joined with spaces; a ``lemmatize`` for ``preprocess``."""
    return F.array_join(F.transform(keep_words(tokens_of(text)), lemma), " ")


def preprocess(df: DataFrame, text: str, target: str = TARGET_LANGUAGE, words_as: str | None = None,
               detect: Callable[[Column], Column] | None = None, lemmatize: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add cleaned_text, detected_language_code, detected_language_confidence, is_target_language.

    A blank text counts as target and stays empty, and so does one whose language
    is not known: short texts often have no function word, and none is left out for
    that. Other languages are only lower-cased. ``words_as`` also keeps the cleaned
    words of target texts as an array, so that a scorer need not cut the text again.
    ``detect`` gives struct (code, confidence) for the basic-cleaned text, and
    ``lemmatize`` the cleaned form of a target text, in place of the word lists.
    """
    blank = is_blank(F.col(text))
    df = df.withColumn("_basic", basic_clean(F.when(blank, F.lit("")).otherwise(F.col(text))))
    df = df.withColumn("_tokens", tokens_of(F.col("_basic")))
    df = df.withColumn("_language", detect(F.col("_basic")) if detect else language(F.col("_tokens")))
    df = df.withColumns({"detected_language_code": F.col("_language.code"),
                         "detected_language_confidence": F.col("_language.confidence")})
    df = df.withColumn("is_target_language", blank | F.coalesce(F.col("detected_language_code").isin(target, UNKNOWN_LANGUAGE), F.lit(True)))
    words = words_as or "_words"
    kept = F.filter(tokens_of(lemmatize(F.col("_basic"))), lambda t: t != "") if lemmatize else keep_words(F.col("_tokens"))
    df = df.withColumn(words, F.when(F.col("is_target_language"), kept))
    df = df.withColumn("cleaned_text", F.coalesce(F.array_join(words, " "), F.lower("_basic")))
    return df.drop("_basic", "_tokens", "_language", *([] if words_as else ["_words"]))


def preview(text: Column) -> Column:
    """First 100 characters and dots when the text is longer; ``N/A`` for no text."""
    return (F.when(F.coalesce(text, F.lit("")) == "", F.lit("N/A"))
            .when(F.length(text) > PREVIEW_CHARS, F.concat(F.left(text, F.lit(PREVIEW_CHARS)), F.lit("...")))
            .otherwise(text))


def length_pieces(text: Column, cap: int = LENGTH_CAP) -> Column:
    """The whole text in pieces no longer than ``cap`` characters, for scorers with a limit."""
    count = F.greatest(F.lit(1), F.ceil(F.length(text) / cap)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1),
                       lambda i: F.substring(text, i * cap + 1, F.lit(cap)))


class LanguageDetector(Protocol):
    """A model: one row (code, confidence) per text."""

    def detect(self, texts: pd.Series) -> pd.DataFrame: ...


class Lemmatizer(Protocol):
    """A model: the cleaned form of each text."""

    def lemmatize(self, texts: pd.Series) -> pd.Series: ...


class WordFilter:
    """Sample lemmatizer: keeps words of letters that are no stop words, as they are."""

    stop_words = frozenset(STOP_WORDS)

    def lemmatize(self, texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(w for w in t.lower().split() if w not in self.stop_words and w.isalpha()))


def text_slices(texts: pd.Series, chars: int = 1 << 20) -> Iterator[pd.Series]:
    """A batch of texts (null: empty) in runs of about ``chars`` characters, a longer text on its own."""
    texts = texts.fillna("")
    run = texts.str.len().cumsum() // chars
    for _, part in texts.groupby(run.to_numpy(), sort=False):
        yield part.reset_index(drop=True)


def language_by_model(text: Column, make_detector: Callable[[], LanguageDetector]) -> Column:
    """Struct (code, confidence) from a plug-in detector, in Arrow batches, one detector per task."""

    @F.pandas_udf("code string, confidence double")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detector = make_detector()
        for texts in batches:
            for part in text_slices(texts):
                yield detector.detect(part)

    return detect(text)


def lemmas_by_model(text: Column, make_lemmatizer: Callable[[], Lemmatizer]) -> Column:
    """Cleaned text from a plug-in lemmatizer, in Arrow batches, one lemmatizer per task."""

    @F.pandas_udf("string")
    def lemmatize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lemmatizer = make_lemmatizer()
        for texts in batches:
            for part in text_slices(texts):
                yield lemmatizer.lemmatize(part)

    return lemmatize(text)
