"""Reading cohort tables from CSV or Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskloom.operators.prepare import (
    EVENT_DATE,
    FEATURE_SUFFIX,
    NUMERIC_METADATA,
    keep_column,
    validate_cohort,
)

SMALLEST_PARQUET = 200
CODECS = ("snappy", "gzip", "brotli", "zstd", "none")


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def size_of(spark: SparkSession, path: str) -> int:
    fs, hadoop_path = _file_system(spark, path)
    return fs.getContentSummary(hadoop_path).getLength()


def file_format(path: str) -> str:
    lower = path.lower()
    for fmt in ("csv", "parquet"):
        if lower.endswith(f".{fmt}"):
            return fmt
    raise ValueError(f"unsupported file type: {path}")


def preferred_path(spark: SparkSession, path: str) -> str:
    """The Parquet sibling of a CSV file where there is one."""
    if file_format(path) == "csv":
        sibling = path[: -len(".csv")] + ".parquet"
        if exists(spark, sibling):
            return sibling
    return path


def available_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header or the Parquet footer; no data is read."""
    fmt = file_format(path)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    size = size_of(spark, path)
    if size == 0 or (fmt == "parquet" and size < SMALLEST_PARQUET):
        raise ValueError(f"empty file: {path}")
    if fmt == "parquet":
        return spark.read.parquet(path).columns
    return spark.read.option("header", True).csv(path).columns


def csv_schema(columns: Sequence[str], numeric: Sequence[str] = NUMERIC_METADATA) -> T.StructType:
    """Features and numeric metadata as doubles, all else as text."""
    is_number = lambda c: c in numeric or c.endswith(FEATURE_SUFFIX)
    return T.StructType(
        [T.StructField(c, T.DoubleType() if is_number(c) else T.StringType()) for c in columns]
    )


def read_cohort_csv(
    spark: SparkSession,
    path: str,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    validate: bool = True,
) -> DataFrame:
    """Header CSV, cohort columns only, with an explicit schema (no inference pass)."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    schema = csv_schema(
        available_columns(spark, path), NUMERIC_METADATA if numeric is None else numeric
    )
    df = spark.read.option("header", True).schema(schema).csv(path)
    return _project(df, numeric, categorical, validate)


def _project(df, numeric, categorical, validate) -> DataFrame:
    keep = keep_column(numeric, categorical)
    out = df.select(*[f"`{c}`" for c in df.columns if keep(c)])
    if validate:
        validate_cohort(out)
    return out


def read_cohort(
    spark: SparkSession,
    path: str,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    validate: bool = True,
) -> DataFrame:
    """CSV or Parquet by suffix; a CSV with a Parquet sibling is read from the sibling."""
    chosen = preferred_path(spark, path)
    if file_format(chosen) == "csv":
        return read_cohort_csv(spark, chosen, numeric, categorical, validate)
    if not exists(spark, chosen):
        raise FileNotFoundError(chosen)
    return _project(spark.read.parquet(chosen), numeric, categorical, validate)


def csv_to_parquet(
    spark: SparkSession,
    csv_path: str,
    parquet_path: str | None = None,
    compression: str = "snappy",
    validate: bool = True,
    **metadata,
) -> str:
    """Write the cohort columns of a CSV as Parquet; returns the path."""
    if compression not in CODECS:
        raise ValueError(f"unknown compression {compression!r}, one of {CODECS}")
    target = parquet_path or csv_path[: -len(".csv")] + ".parquet"
    df = read_cohort_csv(spark, csv_path, validate=validate, **metadata)
    df.write.mode("overwrite").option("compression", compression).parquet(target)
    return target


__all__ = [
    "EVENT_DATE",
    "available_columns",
    "csv_to_parquet",
    "preferred_path",
    "read_cohort",
    "read_cohort_csv",
]
