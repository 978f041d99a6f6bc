"""Signature trees: hierarchical nodes with OR-combined token bitmaps and size ranges.

Two trees are walked together from the top. A pair of nodes is left out if no two
sets below them can overlap enough: they share at most the bits that both bitmaps
have, and their sizes lie in the nodes' ranges. What reaches the leaves is exact,
as each bit of a leaf stands for one token.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

FANOUT = 8
#: Bytes of bitmaps compared at once.
_CHUNK = 1 << 24


def bitmaps(tokens: list[np.ndarray]) -> np.ndarray:
    """One exact bitmap per sorted token array, over the tokens that two arrays hold."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[place] > 1
    row = np.repeat(np.arange(len(tokens)), sizes)[shared]
    bit = number[place[shared]]
    words = max(1, -(-int((count > 1).sum()) // 64))
    out = np.zeros((len(tokens), words), np.uint64)
    if len(row):
        # Tokens are sorted, so bits of one word of one row stand together.
        cell = row * words + (bit >> 6)
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out.ravel()[cell[start]] = np.bitwise_or.reduceat(
            np.uint64(1) << (bit & 63).astype(np.uint64), start
        )
    return out


@dataclass
class SignatureTree:
    """Levels from leaves to top: bitmaps, smallest and largest set size of each node."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, bits: np.ndarray, sizes: np.ndarray) -> SignatureTree:
        levels = [(bits, sizes, sizes)]
        while len(levels[-1][0]) > FANOUT:
            b, lo, hi = levels[-1]
            start = np.arange(0, len(b), FANOUT)
            levels.append(
                (
                    np.bitwise_or.reduceat(b, start, axis=0),
                    np.minimum.reduceat(lo, start),
                    np.maximum.reduceat(hi, start),
                )
            )
        return cls(levels)


Feasible = Callable[..., np.ndarray]


def linked_pairs(
    left: SignatureTree, right: SignatureTree, feasible: Feasible
) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs for which ``feasible(overlap, lo_a, hi_a, lo_b, hi_b)`` holds on the whole path.

    A tree walked with itself gives each pair of different leaves once.
    """
    same = left is right
    height = max(len(left.levels), len(right.levels))

    def level(tree: SignatureTree, h: int):
        return tree.levels[min(h, len(tree.levels) - 1)]

    a, b = (
        x.ravel()
        for x in np.meshgrid(
            np.arange(len(level(left, height)[0])),
            np.arange(len(level(right, height)[0])),
            indexing="ij",
        )
    )
    for h in range(height - 1, -1, -1):
        if h < height - 1:
            a = _children(a, left, h)
            b = _children(b, right, h)
            a, b = _crossed(a, b)
        if same:
            keep = a <= b if h else a < b
            a, b = a[keep], b[keep]
        (bits_a, lo_a, hi_a), (bits_b, lo_b, hi_b) = level(left, h), level(right, h)
        keep = np.zeros(len(a), bool)
        step = max(1, _CHUNK // (8 * bits_a.shape[1]))
        for at in range(0, len(a), step):
            i, j = a[at : at + step], b[at : at + step]
            overlap = np.bitwise_count(bits_a[i] & bits_b[j]).sum(1, dtype=np.int64)
            keep[at : at + step] = feasible(overlap, lo_a[i], hi_a[i], lo_b[j], hi_b[j])
        a, b = a[keep], b[keep]
    return a, b


def _children(nodes: np.ndarray, tree: SignatureTree, h: int) -> np.ndarray:
    """Children at level ``h`` of each node above, padded with -1; a low tree stays where it is."""
    if h >= len(tree.levels) - 1:
        return nodes[:, None]
    below = nodes[:, None] * FANOUT + np.arange(FANOUT)
    return np.where(below < len(tree.levels[h][0]), below, -1)


def _crossed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.repeat(a, b.shape[1], axis=1).ravel()
    j = np.tile(b, (1, a.shape[1])).ravel()
    keep = (i >= 0) & (j >= 0)
    return i[keep], j[keep]
