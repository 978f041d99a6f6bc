"""Queries beside their SQL on tables with odd values."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as contract
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"


def differs(spark, folder, name, **tables):
    """What the query and its SQL disagree on where the folder holds the given tables."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = contract.queries()[name](spark, str(folder)).toPandas()
    want = con.execute(contract.oracle_sql()[name]).df()
    assert len(got)
    return compare(got, want)


def test_scores_of_zero_are_clipped_by_case_type(spark, tmp_path):
    events = duckdb.sql(
        f"SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN 0.0 ELSE value END AS value) FROM '{SF}/events.parquet'"
    )
    assert differs(spark, tmp_path, "calibration_by_case_type", events=events.to_arrow_table()) is None


def test_all_features_are_kept_where_none_is_important_enough(spark, tmp_path):
    # Means shrink as rows grow: here no feature reaches the minimum.
    rows = [[(i * 7 + j * 13) % 31 * 1e-4 - 2e-3 for j in range(64)] for i in range(60)]
    embeddings = pa.table(
        {
            "vec_id": pa.array(range(60), pa.int64()),
            "embedding": pa.array(rows, pa.list_(pa.float32())),
            "label": pa.array([i % 10 for i in range(60)], pa.int32()),
        }
    )
    assert differs(spark, tmp_path, "importance_selection", embeddings=embeddings) is None
