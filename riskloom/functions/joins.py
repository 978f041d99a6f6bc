"""Equi-joins that treat NULL keys as equal, as groupBy does."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on ``keys`` with ``<=>``; the key columns of ``left`` are kept.

    ``how`` is one of inner, left, left_semi, left_anti.
    """
    if not keys:
        return left.crossJoin(right)
    renamed = {k: f"__right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(renamed)
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]
    )
    joined = left.join(right, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())
