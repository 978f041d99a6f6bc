"""Sources, sinks and the results catalog (family A)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.queries.registry import EVENTS_SQL, PREDICTIONS_SQL, SELECTIONS_SQL, Tables, query, rounded
from riskloom.session import ensure_checkpoint_dir
from riskloom.sources import catalog as G, cohort as Q


def fresh_folder(spark, name: str) -> str:
    """A new folder beside the session's checkpoints, visible to all executors."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _catalog(t: Tables) -> G.Catalog:
    return G.Catalog(t.spark, fresh_folder(t.spark, "catalog"))


_CSV_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS eid,
  CASE o_orderstatus WHEN 'F' THEN 'Controls' WHEN 'O' THEN 'Incident' ELSE 'Prevalent' END AS "CeD_comparison",
  o_totalprice / 1000 AS age, o_totalprice AS price_resid FROM orders"""


def _csv(t: Tables, with_extra: bool = True) -> str:
    """The orders as a cohort CSV with one column that is not part of a cohort."""
    label = F.when(F.col("o_orderstatus") == "F", "Controls").when(
        F.col("o_orderstatus") == "O", "Incident"
    )
    path = f"{fresh_folder(t.spark, 'cohort')}.csv"
    t.orders.select(
        F.col("o_orderkey").alias("eid"),
        label.otherwise("Prevalent").alias("CeD_comparison"),
        (F.col("o_totalprice") / 1000).alias("age"),
        F.col("o_totalprice").alias("price_resid"),
        F.col("o_orderpriority").alias("note"),
    ).write.option("header", True).csv(path)
    return path


@query("read_cohort_csv", _CSV_SQL)
def _read_csv(t: Tables):
    return Q.read_cohort_csv(t.spark, _csv(t))


@query("convert_csv_to_parquet", _CSV_SQL)
def _convert(t: Tables):
    path = _csv(t)
    Q.csv_to_parquet(t.spark, path, compression="zstd")
    return Q.read_cohort(t.spark, path)  # reads the Parquet sibling


def _stored(t: Tables) -> G.Catalog:
    catalog = _catalog(t)
    rows = t.predictions().withColumns(
        {"scenario": F.lit("IncidentOnly"), "split": F.lit("TEST")}
    )
    catalog.save_predictions(rows)
    return catalog


@query("prediction_catalog", f"""WITH {PREDICTIONS_SQL}
SELECT model, split_seed, COUNT(*) AS n, ROUND(SUM(y_prob), 6) AS total FROM pred WHERE model = 'O' GROUP BY ALL""")
def _predictions(t: Tables):
    rows = _stored(t).predictions(scenario="IncidentOnly", model="O")
    out = rows.groupBy("model", "split_seed").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_prob").alias("total")
    )
    return rounded(out, 6)


@query("split_catalog", """SELECT split_seed, split, COUNT(*) AS n FROM (
  SELECT CAST(o_orderkey % 3 AS INTEGER) AS split_seed,
    CASE WHEN o_orderkey % 2 = 0 THEN 'TRAIN' ELSE 'TEST' END AS split FROM orders) GROUP BY ALL""")
def _splits(t: Tables):
    catalog = _catalog(t)
    rows = t.orders.select(
        F.lit("IncidentOnly").alias("scenario"),
        (F.col("o_orderkey") % 3).cast("int").alias("split_seed"),
        F.when(F.col("o_orderkey") % 2 == 0, "TRAIN").otherwise("TEST").alias("split"),
        F.col("o_orderkey").alias("id"),
    )
    catalog.save_splits(rows)
    catalog.save_splits(rows)  # the same rows again are accepted and not rewritten
    return catalog.load_splits("IncidentOnly").groupBy("split_seed", "split").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("partition_discovery", f"""WITH {PREDICTIONS_SQL} SELECT DISTINCT split_seed FROM pred""")
def _partitions(t: Tables):
    seeds = _stored(t).partitions("predictions", "split_seed")
    return t.spark.createDataFrame([(s,) for s in seeds], "split_seed int")


@query("collect_prediction_files", f"""WITH {PREDICTIONS_SQL}
SELECT split_seed, 'LR_EN' AS model, COUNT(*) AS n, ROUND(SUM(y_prob), 6) AS total, CAST(SUM(y_true) AS DOUBLE) AS cases
FROM pred GROUP BY ALL""")
def _files(t: Tables):
    folder = fresh_folder(t.spark, "runs")
    rows = t.predictions().withColumn("folder", F.concat(F.lit("s"), F.col("split_seed").cast("string")))
    for seed in range(5):
        part = rows.where(F.col("split_seed") == seed).select("y_true", "y_prob")
        part.write.option("header", True).csv(f"{folder}/split_seed{seed}/preds/test__LR_EN.csv")
    out = G.collect_prediction_files(t.spark, f"{folder}/split_seed*/preds/*", "LR_EN")
    out = out.groupBy("split_seed", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_prob").alias("total"), F.sum("y_true").alias("cases")
    )
    return rounded(out, 6)


@query("collect_metric_files", """SELECT CAST(l_suppkey % 2 AS INTEGER) AS split_seed,
  ROUND(AVG(l_discount), 6) AS auroc, CASE WHEN l_suppkey % 2 = 1 THEN ROUND(AVG(l_tax), 6) END AS brier
FROM lineitem GROUP BY l_suppkey % 2""")
def _metric_files(t: Tables):
    folder = fresh_folder(t.spark, "metrics")
    paths = []
    for seed in (0, 1):
        part = t.lineitem.where(F.col("l_suppkey") % 2 == seed)
        aggs = [F.avg("l_discount").alias("auroc")]
        aggs += [F.avg("l_tax").alias("brier")] if seed else []
        paths.append(f"{folder}/split_seed{seed}/metrics")
        part.agg(*aggs).write.option("header", True).csv(paths[-1])
    out = G.collect_metric_files(t.spark, paths)
    return out.select(
        "split_seed",
        F.round(F.col("auroc").try_cast("double"), 6).alias("auroc"),
        F.round(F.col("brier").try_cast("double"), 6).alias("brier"),
    )


@query("collect_ensemble_metric_files", """SELECT 3 AS split_seed, ROUND(AVG(l_discount), 6) AS "test_AUROC",
  ROUND(AVG(l_tax), 6) AS "val_AUROC", 'ENSEMBLE' AS model FROM lineitem""")
def _ensemble_files(t: Tables):
    folder = fresh_folder(t.spark, "ensemble")
    t.lineitem.agg(
        F.struct(F.avg("l_discount").alias("AUROC")).alias("test"),
        F.struct(F.avg("l_tax").alias("AUROC")).alias("val"),
    ).write.json(f"{folder}/split_seed3/metrics")
    return rounded(G.collect_ensemble_metric_files(t.spark, f"{folder}/split_seed3/metrics"), 6)


@query("export_predictions", f"""WITH {EVENTS_SQL}
SELECT id, y_true, ROUND(y_prob, 9) AS risk_raw, ROUND(y_prob * 100, 9) AS risk_raw_pct,
  ROUND(y_prob * 0.5, 9) AS risk_adjusted, ROUND(y_prob * 0.5 * 100, 9) AS risk_adjusted_pct,
  ROUND(y_prob * 0.5, 9) AS risk, ROUND(y_prob * 0.5 * 100, 9) AS risk_pct FROM pred""")
def _export(t: Tables):
    rows = t.event_predictions().withColumn("half", F.col("y_prob") * 0.5)
    return rounded(G.export_table(rows, {"raw": "y_prob", "adjusted": "half"}))


@query("export_holdout", f"""WITH {EVENTS_SQL}
SELECT id, category AS target, y_true, ROUND(y_prob, 9) AS risk_raw, ROUND(y_prob * 0.5, 9) AS risk_adjusted FROM pred""")
def _export_holdout(t: Tables):
    rows = t.event_predictions().withColumn("y_prob_adjusted", F.col("y_prob") * 0.5)
    return rounded(G.holdout_export(rows, "category"))


@query("pooled_prediction_catalog", f"""WITH {EVENTS_SQL},
w AS (SELECT model, CASE WHEN id % 3 <> 0 THEN y_prob END AS a, CASE WHEN id % 5 <> 0 THEN y_prob * 0.5 END AS b FROM pred)
SELECT model, COUNT(*) AS n, ROUND(SUM(LIST_AVG(LIST_FILTER([a, b], lambda v: v IS NOT NULL))), 6) AS total FROM w GROUP BY model""")
def _pooled(t: Tables):
    catalog = _catalog(t)
    rows = t.event_predictions().select(
        "id",
        "model",
        F.when(F.col("id") % 3 != 0, F.col("y_prob")).alias("y_prob_repeat0"),
        F.when(F.col("id") % 5 != 0, F.col("y_prob") * 0.5).alias("y_prob_repeat1"),
    )
    catalog.save_pooled(rows)
    out = catalog.read("pooled_predictions").groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_prob").alias("total")
    )
    return rounded(out, 6)


@query("stability_catalog", f"""WITH {SELECTIONS_SQL}, n AS (SELECT model, COUNT(*) AS n FROM slog GROUP BY model)
SELECT model, feature, ROUND(CAST(COUNT(*) AS DOUBLE) / MAX(n), 9) AS selection_fraction
FROM named JOIN n USING (model) GROUP BY model, feature HAVING CAST(COUNT(*) AS DOUBLE) / MAX(n) >= 0.15""")
def _stability(t: Tables):
    from riskloom.operators.panels import selection_frequencies

    catalog = _catalog(t)
    freq = selection_frequencies(t.selection_log(), ["model"])
    catalog.write("stability", freq.withColumnRenamed("selection_freq", "selection_fraction"), ["model"])
    return rounded(catalog.stability(0.15)).select("model", "feature", "selection_fraction")


@query("model_round_trip")
def _model(t: Tables):
    from riskloom.operators import train as M
    from riskloom.session import checkpointed

    rows = checkpointed(M.vectors(t.wide_cohort(), "embedding"))
    catalog = _catalog(t)
    catalog.save_model(M.fit_model(rows, "LR_EN", {"C": 0.1}), "IncidentOnly", "LR_EN", 0, {"k": 1})
    fitted, _, _ = catalog.load_model("IncidentOnly", "LR_EN", 0)
    return M.predict(fitted, rows)
