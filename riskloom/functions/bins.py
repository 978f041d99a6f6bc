"""Binning of values into a fixed list of edges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def even_edges(n_bins: int) -> list[float]:
    return [float(v) for v in np.linspace(0.0, 1.0, n_bins + 1)]


def count_edges_at_or_below(
    df: DataFrame, value_col: str, edges: Sequence[float], out_col: str
) -> DataFrame:
    """Add the number of ``edges`` that are ≤ the value (binary search in the JVM)."""
    ordered = sorted(set(float(e) for e in edges))
    splits = [float("-inf"), *ordered, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="__v", outputCol=out_col, handleInvalid="keep")
    out = bucketizer.transform(df.withColumn("__v", F.col(value_col).cast("double")))
    return out.withColumn(out_col, F.col(out_col).cast("int")).drop("__v")


def even_bin(df: DataFrame, p_col: str, n_bins: int, out_col: str = "bin") -> DataFrame:
    """Left-closed bins of [0, 1]; 1.0 belongs to the last bin."""
    inner = even_edges(n_bins)[1:-1]
    return count_edges_at_or_below(df, p_col, inner, out_col)
