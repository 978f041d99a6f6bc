"""Run registered queries against their SQL at a scale factor and report mismatches.

Usage: python tests/oracle_check.py [sf] [name-part ...]
"""

from __future__ import annotations

import os
import sys
import time
import warnings

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns in name order."""
    columns = sorted(frame.columns)

    def text(v):
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return "[" + ",".join(text(x) for x in v) + "]"
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, bool) or type(v).__name__ == "bool_" or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return f"{float(v):.10g}"
        return str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[columns].itertuples(index=False))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None if equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    a, b = canonical(spark_frame), canonical(sql_frame)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else None


def type_notes(spark_df, sql_frame: pd.DataFrame) -> str:
    """Columns whose kind (integer, float, text, flag) differs between engines."""
    notes = []
    kinds = {"int": "i", "bigint": "i", "double": "f", "string": "O", "boolean": "b"}
    for name, dtype in spark_df.dtypes:
        if dtype.startswith("decimal"):
            notes.append(f"{name}: spark {dtype}")
        if name in sql_frame and dtype in kinds:
            kind = sql_frame[name].dtype.kind
            ok = {"i": "iuf", "f": "f", "O": "OTU", "b": "bO"}[kinds[dtype]]
            if kind not in ok and not (kind == "O" and sql_frame[name].isna().all()):
                notes.append(f"{name}: {dtype} vs {sql_frame[name].dtype}")
            if kinds[dtype] == "i" and kind == "f" and not sql_frame[name].isna().any():
                notes.append(f"{name}: {dtype} vs {sql_frame[name].dtype}")
    return "; ".join(notes)


def main() -> int:
    warnings.filterwarnings("ignore")
    import __spark_entry__ as contract
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, failed = contract.oracle_sql(), 0
    for name, run in contract.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            got = df.toPandas()
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            continue
        spent = time.time() - start
        if name not in oracle:
            print(f"rows  {name}: {len(got)} rows, {spent:.1f}s", flush=True)
            continue
        try:
            start = time.time()
            want = con.execute(oracle[name]).df()
            sql_spent = time.time() - start
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"SQL   {name}: {str(error)[:600]}", flush=True)
            continue
        problem = compare(got, want)
        notes = type_notes(df, want)
        failed += problem is not None
        print(
            f"{'FAIL ' if problem else 'ok   '} {name}: {problem or len(got)}, "
            f"{spent:.1f}s sql {sql_spent:.1f}s {'TYPES ' + notes if notes else ''}",
            flush=True,
        )
    print(f"failed: {failed}")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
