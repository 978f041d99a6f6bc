"""The registry and the shared views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.operators.prepare import melt_array


class Tables:
    """Lazily read Parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def predictions(self) -> DataFrame:
        """Line items as predictions: y is 'returned', the score grows with the price."""
        return self.lineitem.select(
            F.col("l_linestatus").alias("model"),
            (F.col("l_suppkey") % 5).cast("int").alias("split_seed"),
            (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
            (F.col("l_extendedprice") / (F.col("l_extendedprice") + 60000.0)).alias("y_prob"),
        )

    def coarse_predictions(self) -> DataFrame:
        """As ``predictions`` with few distinct scores, so that ties abound."""
        return self.lineitem.select(
            F.col("l_linestatus").alias("model"),
            (F.col("l_suppkey") % 5).cast("int").alias("split_seed"),
            (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
            ((F.col("l_quantity") + F.col("l_linenumber")) / 64.0).alias("y_prob"),
        )

    def event_predictions(self) -> DataFrame:
        """Events as predictions with an id: y is 'purchase'."""
        return self.events.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
            (F.col("user_id") % 7).cast("int").alias("split_seed"),
            (F.col("event_type") == "purchase").cast("int").alias("y_true"),
            (F.col("value") / (F.col("value") + 50.0)).alias("y_prob"),
            F.when(F.col("event_type") == "purchase", "Incident")
            .when(F.col("event_type") == "signup", "Prevalent")
            .otherwise("Controls")
            .alias("category"),
        )

    def cohort(self) -> DataFrame:
        """Customers as a cohort: label by nation, age and BMI from the balance."""
        nation = F.col("c_nationkey")
        balance = F.col("c_acctbal")
        return self.customer.select(
            F.col("c_custkey").alias("id"),
            F.when(nation < 18, "Controls")
            .when(nation < 22, "Incident")
            .otherwise("Prevalent")
            .alias("target"),
            F.when(F.col("c_custkey") % 13 == 0, F.lit("2020-01-01")).alias("event_date"),
            F.when(balance >= 0, balance / 100.0).alias("age"),
            F.when(nation != 3, balance / 400.0).alias("bmi"),
            F.when(nation != 7, F.col("c_mktsegment")).alias("sex"),
        )

    def dated_cohort(self) -> DataFrame:
        """Orders as a dated cohort: label by status."""
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderdate").alias("event_time"),
            F.when(F.col("o_orderstatus") == "F", "Controls")
            .when(F.col("o_orderstatus") == "O", "Incident")
            .otherwise("Prevalent")
            .alias("target"),
        )

    def wide_cohort(self) -> DataFrame:
        """Embeddings as a cohort of 64 features: label 0 and 1 are the cases."""
        label = F.col("label")
        return self.embeddings.select(
            F.col("vec_id").alias("id"),
            F.when(label == 0, "Incident")
            .when(label == 1, "Prevalent")
            .otherwise("Controls")
            .alias("target"),
            (label < 2).cast("int").alias("y"),
            "embedding",
        )

    def features(self) -> DataFrame:
        """The wide cohort, melted: (id, target, y, feature, value)."""
        return melt_array(self.wide_cohort(), "embedding", ["id", "target", "y"])

    def measurements(self) -> DataFrame:
        """Line items as a melted cohort of four features, many rows each."""
        entries = [
            F.struct(F.lit(name).alias("feature"), F.col(name).alias("value"))
            for name in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        ]
        return self.lineitem.select(
            (F.col("l_returnflag") == "R").cast("int").alias("y"),
            F.inline(F.array(*entries)),
        )

    def selection_log(self) -> DataFrame:
        """Orders as outer folds: an order 'selects' the brands it contains."""
        key = F.col("l_orderkey")
        lines = self.lineitem.select("l_orderkey", "l_partkey")
        brands = self.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        return (
            lines.join(brands, "l_partkey")
            .groupBy("l_orderkey")
            .agg(F.array_sort(F.collect_set("p_brand")).alias("features"))
            .select(
                F.concat(F.lit("m"), (key % 2).cast("string")).alias("model"),
                (key % 10).cast("int").alias("split_seed"),
                (key % 3).cast("int").alias("repeat"),
                "features",
            )
        )

    def _brand_lines(self) -> DataFrame:
        brands = self.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        return self.lineitem.join(brands, "l_partkey")

    def brand_stability(self) -> DataFrame:
        """Share of returned lines per line status and brand, as a stability table."""
        return (
            self._brand_lines()
            .groupBy(F.col("l_linestatus").alias("model"), F.col("p_brand").alias("feature"))
            .agg(
                (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias(
                    "selection_fraction"
                )
            )
        )

    def brand_elimination(self) -> DataFrame:
        """Elimination order of brands by quantity, for one of the two models."""
        totals = (
            self._brand_lines()
            .where(F.col("l_linestatus") == "O")
            .groupBy(F.col("l_linestatus").alias("model"), F.col("p_brand").alias("feature"))
            .agg(F.sum("l_quantity").alias("q"))
        )
        order = F.row_number().over(W.partitionBy("model").orderBy("q", "feature")) - 1
        return totals.select("model", "feature", order.alias("elimination_order"))

    def brand_values(self) -> DataFrame:
        """Quantity per supplier and brand, melted: (id, feature, value)."""
        return (
            self._brand_lines()
            .groupBy(F.col("l_suppkey").alias("id"), F.col("p_brand").alias("feature"))
            .agg(F.sum("l_quantity").alias("value"))
        )

    def split_metrics(self) -> DataFrame:
        """A metric row per configuration, model and split."""
        config = F.element_at(
            F.array(*[F.lit(c) for c in ("0.5_1", "0.5_5", "1.0_1", "1.0_5")]),
            (F.col("l_linenumber") % 4 + 1).cast("int"),
        )
        y = (F.col("l_returnflag") == "R").cast("double")
        return self.lineitem.groupBy(
            config.alias("config"),
            F.col("l_linestatus").alias("model"),
            (F.col("l_suppkey") % 5).cast("int").alias("split_seed"),
        ).agg(
            F.avg(y).alias("auroc"),
            F.avg("l_discount").alias("brier"),
            (F.avg("l_tax") * 25.0).alias("calib_slope"),
        )


COHORT_SQL = """cohort AS (
  SELECT c_custkey AS id,
         CASE WHEN c_nationkey < 18 THEN 'Controls' WHEN c_nationkey < 22 THEN 'Incident'
              ELSE 'Prevalent' END AS target,
         CASE WHEN c_custkey % 13 = 0 THEN '2020-01-01' END AS event_date,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal / CAST(100 AS DOUBLE) END AS age,
         CASE WHEN c_nationkey <> 3 THEN c_acctbal / CAST(400 AS DOUBLE) END AS bmi,
         CASE WHEN c_nationkey <> 7 THEN c_mktsegment END AS sex
  FROM customer)"""

DATED_SQL = """dated AS (
  SELECT o_orderkey AS id, o_orderdate AS event_time,
         CASE o_orderstatus WHEN 'F' THEN 'Controls' WHEN 'O' THEN 'Incident'
              ELSE 'Prevalent' END AS target
  FROM orders)"""

FEATURES_SQL = """features AS (
  SELECT vec_id AS id, CASE label WHEN 0 THEN 'Incident' WHEN 1 THEN 'Prevalent'
         ELSE 'Controls' END AS target, CASE WHEN label < 2 THEN 1 ELSE 0 END AS y,
         'f' || LPAD(CAST(i - 1 AS VARCHAR), 4, '0') AS feature,
         CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, LATERAL (SELECT UNNEST(RANGE(1, LEN(embedding) + 1)) AS i))"""

MEASUREMENTS_SQL = """features AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, feature, value
  FROM lineitem, LATERAL (SELECT UNNEST(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])
         AS feature, UNNEST([l_quantity, l_extendedprice, l_discount, l_tax]) AS value))"""

SELECTIONS_SQL = """slog AS (
  SELECT l_orderkey, 'm' || CAST(l_orderkey % 2 AS VARCHAR) AS model,
         CAST(l_orderkey % 10 AS INTEGER) AS split_seed,
         CAST(l_orderkey % 3 AS INTEGER) AS repeat, LIST_SORT(LIST(DISTINCT p_brand)) AS features
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
named AS (SELECT *, UNNEST(features) AS feature FROM slog)"""

STABILITY_SQL = """stability AS (
  SELECT l_linestatus AS model, p_brand AS feature,
         CAST(COUNT(*) FILTER (l_returnflag = 'R') AS DOUBLE) / COUNT(*) AS selection_fraction
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
rfe AS (
  SELECT 'O' AS model, p_brand AS feature,
         ROW_NUMBER() OVER (ORDER BY SUM(l_quantity), p_brand) - 1 AS elimination_order
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY p_brand)"""

BRAND_VALUES_SQL = """features AS (
  SELECT l_suppkey AS id, p_brand AS feature, SUM(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""

METRICS_SQL = """metrics AS (
  SELECT ['0.5_1', '0.5_5', '1.0_1', '1.0_5'][CAST(l_linenumber % 4 + 1 AS INTEGER)] AS config,
         l_linestatus AS model, CAST(l_suppkey % 5 AS INTEGER) AS split_seed,
         AVG(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS auroc,
         AVG(l_discount) AS brier, AVG(l_tax) * 25 AS calib_slope
  FROM lineitem GROUP BY ALL)"""

PREDICTIONS_SQL = """pred AS (
  SELECT l_linestatus AS model, CAST(l_suppkey % 5 AS INTEGER) AS split_seed,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
         l_extendedprice / (l_extendedprice + CAST(60000 AS DOUBLE)) AS y_prob
  FROM lineitem)"""

COARSE_SQL = """pred AS (
  SELECT l_linestatus AS model, CAST(l_suppkey % 5 AS INTEGER) AS split_seed,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
         (l_quantity + l_linenumber) / CAST(64 AS DOUBLE) AS y_prob
  FROM lineitem)"""

EVENTS_SQL = """pred AS (
  SELECT event_id AS id, 'm' || CAST(user_id % 3 AS VARCHAR) AS model,
         CAST(user_id % 7 AS INTEGER) AS split_seed,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y_true,
         value / (value + CAST(50 AS DOUBLE)) AS y_prob,
         CASE event_type WHEN 'purchase' THEN 'Incident' WHEN 'signup' THEN 'Prevalent'
              ELSE 'Controls' END AS category
  FROM events)"""


def roc_sql(keys: str) -> str:
    """ROC rows of ``pred`` per key, the brute-force way: one window per group."""
    return f"""cnt AS (
  SELECT {keys}, y_prob AS score, SUM(y_true) AS pos, SUM(1 - y_true) AS neg
  FROM pred GROUP BY {keys}, y_prob),
cum AS (
  SELECT *, SUM(pos) OVER g AS n_pos, SUM(neg) OVER g AS n_neg,
         SUM(pos) OVER (PARTITION BY {keys} ORDER BY score DESC) AS tp,
         SUM(neg) OVER (PARTITION BY {keys} ORDER BY score DESC) AS fp,
         LAG(pos) OVER u AS lo_pos, LAG(neg) OVER u AS lo_neg, LEAD(pos) OVER u AS hi_pos
  FROM cnt WINDOW g AS (PARTITION BY {keys}), u AS (PARTITION BY {keys} ORDER BY score)),
roc AS (
  SELECT *, CAST(tp AS DOUBLE) / n_pos AS tpr, CAST(fp AS DOUBLE) / n_neg AS fpr,
         CAST(tp AS DOUBLE) / (tp + fp) AS prec,
         (lo_pos IS NULL OR hi_pos IS NULL OR lo_pos <> pos OR lo_neg <> neg) AS kept
  FROM cum)"""


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function from ``Tables`` to a DataFrame under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round double columns, because summation order differs between engines."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        # Adding 0.0 turns a negative zero into a plain zero.
        return (F.round(c, digits) + F.lit(0.0)).alias(name) if kind == "double" else c

    return df.select(*[one(n, k) for n, k in df.dtypes])
