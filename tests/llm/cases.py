"""Small awkward tables and plain re-computations of what the operators return."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None, pattern=SPACED, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    if lower:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return pattern.findall(raw)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta eins zwei drei größe été niño 日本 kappa la le de".split()) + str(rng.randrange(40))
                    for _ in range(n))


def awkward_texts() -> list[str | None]:
    """Nulls, empties, ties, repeats, long words, control bytes and characters of several bytes."""
    base, other = prose(1, 120), prose(2, 90)
    ws = base.split(" ")
    near = " ".join([*ws[:60], "changed", *ws[61:]])
    return [None, "", " \t\n", "one", "one two", "One TWO three", "one two three four", base, base, near, base.upper(), other,
            other + " " + base, "x" * 3000, "ab" * 900, "ab" * 901, "na " * 400, prose(3, 2000), "é" * 200, "日本語" * 60,
            "a\x00b " * 30, "tab\tand\nlines\r\n" * 5, "tab\tand\nlines\r\n" * 5, "😀 " * 40, "".join(chr(c) for c in range(1, 400)),
            base[:200], base[50:260], base[51:261], other[:49], other[:50], other[:51], prose(4, 12), prose(4, 13), prose(4, 14)]


def table(spark, rows=None):
    """Documents with clashing extra columns, an id that repeats, and rows without an id."""
    if rows is None:
        texts = awkward_texts()
        rows = [(i * 3, t) for i, t in enumerate(texts)]
        rows += [(3 * texts.index("one"), "another text under a known id"), (21, texts[7]), (None, texts[7]), (None, None), (-5, texts[11])]
    kinds = "doc_id long, text string, part int, lane string, told long, packed int, row string, row_key int, hits int, label int, score string"
    return spark.createDataFrame([(d, t, None, "x", 1, None, "r", 2, None, 3, None) for d, t in rows], kinds)


def pairs(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def first_owner(rows, strings) -> dict[bytes, int]:
    least: dict[bytes, int] = {}
    for doc, text in rows:
        if doc is not None:
            for s in strings(text):
                least[s] = min(doc, least.get(s, doc))
    return least


def brute_substring(rows, width: int = 13) -> list[tuple]:
    def windows(text):
        ws = words(text)
        return [b" ".join(ws[i:i + width]) for i in range(len(ws) - width + 1)]

    least, out = first_owner(rows, windows), []
    for doc, text in rows:
        ws = words(text)
        gone = set()
        if doc is not None:
            for i, w in enumerate(windows(text)):
                if least[w] < doc:
                    gone.update(range(i, i + width))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return ordered(out)


def brute_suffix(rows, length: int = 50) -> list[tuple]:
    def strings(text):
        raw = (text or "").encode()
        return [raw[i:i + length] for i in range(len(raw) - length + 1)]

    least, out = first_owner(rows, strings), []
    for doc, text in rows:
        raw, gone = (text or "").encode(), set()
        if doc is not None:
            for i, s in enumerate(strings(text)):
                if least[s] < doc:
                    gone.update(range(i, i + length))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((doc, len(raw), len(gone), spans, hashlib.sha256(bytes(b for i, b in enumerate(raw) if i not in gone)).hexdigest()))
    return ordered(out)


def shingles(text: str | None, width: int) -> frozenset:
    ws = words(text, lower=True)
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + width]) for i in range(max(len(ws) - width + 1, 1)))


def brute_near(rows, width: int, threshold: int = 80) -> list[tuple]:
    sets = [(d, shingles(t, width)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= threshold * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return ordered((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets)


def brute_benchmark(rows, items, width: int = 13, share: int = 20) -> list[tuple]:
    wanted = defaultdict(set)
    for item, text in items:
        ws = words(text, PLAIN, True)
        if ws and item is not None:
            k = min(width, len(ws))
            for i in range(len(ws) - k + 1):
                wanted[tuple(ws[i:i + k])].add(str(item))
    sizes, out = {len(w) for w in wanted}, []
    for doc, text in rows:
        ws, hit, found = words(text, PLAIN, True), set(), set()
        for k in sizes:
            for i in range(len(ws) - k + 1):
                if tuple(ws[i:i + k]) in wanted:
                    hit.update(range(i, i + k))
                    found |= wanted[tuple(ws[i:i + k])]
        out.append((doc, len(ws), len(hit), ",".join(sorted(found)), bool(hit) and share * len(hit) >= len(ws)))
    return ordered(out)


def brute_statistics(text: str | None) -> tuple:
    text = text or ""
    ws = [w.decode() for w in words(text)]
    lines = [line for line in text.split("\n") if words(line)]
    grams = defaultdict(list)
    for i in range(len(ws) - 2):
        grams[tuple(ws[i:i + 3])].append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
