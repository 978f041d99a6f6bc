"""Monotone regression by pooling adjacent violators, range by range.

Values are cut into ranges; each task pools its own range, and the blocks that are left
are pooled again over fewer, wider ranges until one holds them all. Pooling inside a
range never undoes what pooling over all values would do, so the result is that of one
pass over all values, while each task keeps only its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import checkpointed, ship_package

#: Scores that one task of the first level pools.
RANGE_SCORES = 100_000
#: Ranges whose blocks one task of the next level pools.
FAN_IN = 32
BLOCKS = "low double, high double, total double, weight double"


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbours of ordered blocks while an earlier mean is not below a later one."""
    low: list[float] = []
    high: list[float] = []
    total: list[float] = []
    weight: list[float] = []
    for batch in batches:
        for a, b, t, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while total and total[-1] * w >= t * weight[-1]:
                a, t, w = low.pop(), t + total.pop(), w + weight.pop()
                high.pop()
            low.append(a)
            high.append(b)
            total.append(t)
            weight.append(w)
    arrays = [pa.array(np.array(v, np.float64)) for v in (low, high, total, weight)]
    yield pa.RecordBatch.from_arrays(arrays, ["low", "high", "total", "weight"])


def isotonic_blocks(counts: DataFrame) -> DataFrame:
    """(low, high, total, weight) of the blocks of the rising fit of pos / (pos + neg).

    ``counts`` has one row per score with pos and neg, as ``score_counts`` gives them.
    A block spans the scores from low to high and has the fitted value total / weight;
    values rise strictly from block to block. No rows give no blocks.
    """
    spark = counts.sparkSession
    ship_package(spark)
    score = F.col("score").cast("double")
    blocks = counts.select(
        score.alias("low"),
        score.alias("high"),
        F.col("pos").cast("double").alias("total"),
        (F.col("pos") + F.col("neg")).cast("double").alias("weight"),
    ).where(F.col("weight") > 0)
    ranges = max(1, -(-counts.count() // RANGE_SCORES))
    while True:
        ordered = blocks.repartitionByRange(ranges, "low").sortWithinPartitions("low")
        blocks = checkpointed(ordered.mapInArrow(_pool, BLOCKS))
        if ranges == 1:
            return blocks
        ranges = -(-ranges // FAN_IN)


def block_ends(blocks: DataFrame) -> DataFrame:
    """(score, rate, n): both ends of each block, with its value and half of its weight."""
    ends = F.when(F.col("low") < F.col("high"), F.array("low", "high")).otherwise(F.array("low"))
    return blocks.select(
        F.explode(ends).alias("score"),
        (F.col("total") / F.col("weight")).alias("rate"),
        (F.col("weight") / F.size(ends)).alias("n"),
    )
