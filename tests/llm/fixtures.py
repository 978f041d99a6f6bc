"""Small tables with odd rows, and plain definitions to hold results against."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size long, key string, label string, n int, hash string, score double, bucket int"
)
LONG = "word " * 30_000 + "x" * 70_000


def rows(texts, ids=None, sources=None):
    """Document rows with extra columns whose names clash with what operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return [
        (i, t, None, s, None, -1, "k", "l", 7, "h", 0.5, 3)
        for i, t, s in zip(ids, texts, sources, strict=True)
    ]


def odd_texts() -> list[str | None]:
    return [
        None,
        "",
        "   ",
        "one",
        "One TWO three four",
        "one two three four",
        "a b c d e f g h",
        "a b c d e f g h",
        "Ünïcode Ärger 日本語 ΣΑΣ \U0001f600 don't I'LL 'sample",
        "line\nbreak\ttab\x0bvt\x0cff\rcr\x1cfs\x85nel\xa0nbsp",
        "<|endoftext|>mid<|startoftext|> x<|endoftext|>",
        LONG,
    ]


def odd_docs(spark):
    texts = odd_texts()
    ids = [5, 6, 7, 8, 9, 10, None, None, 2**40, -3, 11, 12]
    sources = ["b", None, "a", "a", None, "Z", "z", "z", "é", "b", "b", "a"]
    extra = rows(["a b c d e f g h", "again"], [10, 11], ["Z", "b"])
    return spark.createDataFrame(rows(texts, ids, sources) + extra + extra, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def babble(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def near_copy(text: str, seed: int, edits: int) -> str:
    rng = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[bytes]:
    return ascii_lower(text or "").encode().split()


def shingles(text: str | None, width: int = 5) -> set[tuple[bytes, ...]]:
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
