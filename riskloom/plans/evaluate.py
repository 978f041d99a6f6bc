"""Evaluation of scored splits, grouped by model, split and seed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.joins import join_on_keys
from riskloom.operators import curves as C, thresholds as T
from riskloom.operators.calibrate import (
    adjust_for_prevalence,
    calibration_intercept_slope,
    expected_calibration_error,
)
from riskloom.operators.discrimination import brier_of_counts, discrimination_aggregates
from riskloom.operators.thresholds import confusion_columns


def evaluate_predictions(
    predictions: DataFrame,
    group_cols: Sequence[str] = ("model", "split", "split_seed"),
    objective: str = "youden",
    thresholds: DataFrame | None = None,
    train_prev: float | None = None,
    target_prev: float | None = None,
    **objective_args,
) -> DataFrame:
    """One metric row per group: discrimination, Brier, calibration, operating point.

    The threshold is chosen per group, or taken from ``thresholds`` (group
    columns it shares, ``threshold``), as when a validation choice is reused.
    """
    groups = list(group_cols)
    if train_prev is not None and target_prev is not None:
        adjusted = adjust_for_prevalence(predictions, train_prev, target_prev, out_col="__adj")
        predictions = adjusted.withColumn("y_prob", F.col("__adj")).drop("__adj")
    roc = C.roc_table(predictions, groups)
    name, choice = T.objective_of_roc(objective, **objective_args)
    rows = roc.groupBy(*groups).agg(
        *discrimination_aggregates(),
        brier_of_counts().alias("brier"),
        F.max("n_pos").alias("n_pos"),
        F.max(F.col("n_pos") + F.col("n_neg")).alias("n"),
        choice.alias("__chosen"),
    )
    if thresholds is not None:
        shared = [c for c in thresholds.columns if c in groups]
        given = thresholds.select(*shared, F.col("threshold").alias("__given"))
        rows = join_on_keys(rows, given, shared, "left").withColumn(
            "threshold", F.coalesce("__given", "__chosen")
        ).drop("__given")
    else:
        rows = rows.withColumn("threshold", F.col("__chosen"))
    rows = rows.drop("__chosen").withColumn("objective", F.lit(name))
    at = T.metrics_at_thresholds(roc, rows.select(*groups, "threshold"), groups)
    rows = join_on_keys(rows, at.drop("threshold"), groups)
    rows = join_on_keys(rows, expected_calibration_error(predictions, groups), groups)
    return join_on_keys(rows, calibration_intercept_slope(predictions, groups), groups)


def evaluate_validation_then_test(
    predictions: DataFrame, objective: str = "youden", **objective_args
) -> DataFrame:
    """Choose each model's threshold on VAL and use it on VAL and TEST alike.

    ``objective_args`` (as ``fixed_spec``) belong to the objective.
    """
    keys = ["model", "split_seed"]
    on_val = predictions.where(F.col("split") == "VAL")
    chosen = T.choose_threshold(on_val, keys, objective, **objective_args)
    return evaluate_predictions(
        predictions,
        [*keys, "split"],
        objective,
        chosen.select(*keys, "threshold"),
        **objective_args,
    )


def operating_rates(
    predictions: DataFrame, points: Mapping[str, float], group_cols: Sequence[str] = ("model",)
) -> DataFrame:
    """Confusion rates of named fixed thresholds, one aggregation over the rows."""
    entries = [F.struct(F.lit(k).alias("kind"), F.lit(float(v)).alias("threshold")) for k, v in points.items()]
    rows = predictions.withColumn("__t", F.explode(F.array(*entries))).select("*", "__t.*").drop("__t")
    hit, y = F.col("y_prob") >= F.col("threshold"), F.col("y_true") == 1
    table = rows.groupBy(*group_cols, "kind", "threshold").agg(
        F.count_if(hit & y).alias("tp"),
        F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & ~y).alias("tn"),
        F.count_if(~hit & y).alias("fn"),
    )
    return table.withColumns(confusion_columns(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))))
