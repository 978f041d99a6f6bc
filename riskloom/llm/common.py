"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run without blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other letter as it is."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_batches(spark: SparkSession, rows: int) -> None:
    """Let Arrow batches hold at most ``rows`` rows, so that long texts stay few per batch.

    The setting is read when a plan is made, so it holds for the session's later plans too.
    Workers also get this package, which their functions refer to.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back, where it is read repeatedly."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start in sorted arrays."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def run_spans(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal keys in sorted arrays."""
    starts = run_starts(*keys).tolist()
    return list(zip(starts, [*starts[1:], len(keys[0])], strict=False))
