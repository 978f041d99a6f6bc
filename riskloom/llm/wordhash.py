"""64-bit hashes of all words of many texts at once, by running sums over bytes.

A word's hash is a polynomial in its bytes (each byte a random 64-bit number),
taken as a difference of two running sums and then mixed. Equal words have equal
hashes everywhere; different ones collide with a chance near 2^-64 a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed together; bounds memory to about 50 times that.
SEGMENT = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_FOLDED = _RANDOM.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _RANDOM[ord("a") : ord("z") + 1]
#: Bytes between words: white space; or all ASCII but letters and digits.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BLANKS = [bytes([b]) for b in np.flatnonzero(BLANK)]
_ANY_BLANK = re.compile(rb"[ \t-\r]")
SIGNS = np.ones(256, bool)
SIGNS[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = False
SIGNS[0x80:] = False
# Classes of a word's shape: capitals, small letters and digits; other signs are their own.
_SHAPE = np.arange(256)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    up = powers(_BASE, 1 << 12)
    down = powers(pow(_BASE, -1, 1 << 64), 1 << 12)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)
        return cls.up, cls.down


def _polynomial(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    up, down = _Powers.of(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first])


def _words(data: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = np.concatenate([[True], between[data], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def segments(text: bytes) -> Iterator[bytes]:
    """Cut a long text between words; a word longer than a segment stays whole.

    A part may begin with the blank it was cut at, so cuts are searched behind that.
    """
    at = 0
    while len(text) - at > SEGMENT:
        cut = max(text.rfind(b, at + 1, at + SEGMENT) for b in _BLANKS)
        if cut < 0:
            found = _ANY_BLANK.search(text, at + SEGMENT)
            if found is None:
                break
            cut = found.start()
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(
    texts: list[bytes], fold_case: bool, shapes: bool = False, between: np.ndarray = BLANK
) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes of all words in order, where each text's words end, and their shapes' hashes.

    ``fold_case`` takes A-Z as a-z; ``between`` says which bytes part words (the blank
    among them). A shape is the sequence of byte classes without
    repeats, so that ``Word!!`` and ``Ab!`` are alike.
    """
    table = _FOLDED if fold_case else _RANDOM
    parts, forms = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    counts = np.zeros(len(texts), np.int64)
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        if not held:
            return
        data = np.frombuffer(b" ".join(p for _, p in held), np.uint8)
        first, last = _words(data, between)
        parts.append(_polynomial(table[data], first, last))
        # A segment's words lie before its end in the joined bytes.
        ends = np.cumsum([len(p) + 1 for _, p in held])
        upto = np.searchsorted(first, ends)
        np.add.at(counts, [i for i, _ in held], np.diff(upto, prepend=0))
        if shapes and len(first):
            kind = _SHAPE[data]
            change = np.concatenate([[True], kind[1:] != kind[:-1]])
            change[first] = True
            run = np.cumsum(change)  # number of runs up to and with each byte
            forms.append(
                _polynomial(_RANDOM[kind[change]], run[first] - 1, run[last - 1])
            )
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for part in segments(text):
            if held and size + len(part) > SEGMENT:
                flush()
                size = 0
            held.append((i, part))
            size += len(part) + 1
    flush()
    return np.concatenate(parts), np.cumsum(counts), np.concatenate(forms) if shapes else None


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += words[j : j + n] * np.uint64(pow(_BASE, 2 * j + 3, 1 << 64))
    return mix(out + np.uint64(width))
