"""Summaries over repeated splits: metrics, parameters, coefficients, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.joins import join_on_keys
from riskloom.functions.prob import clip, finite, safe_div
from riskloom.operators import curves as C, dca, thresholds as T
from riskloom.operators.calibrate import (
    calibration_band,
    calibration_intercept_slope,
    expected_calibration_error,
)
from riskloom.operators.discrimination import (
    brier_of_counts,
    curve_band,
    discrimination_aggregates,
    distribution_stats,
)

ENSEMBLE = "ENSEMBLE"
SCORE_WEIGHTS = {"auroc": 0.5, "brier": 0.3, "slope": 0.2}


def _long(df: DataFrame, keep: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in metric_cols
    ]
    return df.select(*keep, F.inline(F.array(*entries)))


def summary_stats(
    metrics: DataFrame,
    metric_cols: Sequence[str],
    group_cols: Sequence[str] = ("scenario", "model"),
) -> DataFrame:
    """Long summary: mean, sample SD, normal 95% interval, range and runs per metric."""
    groups = [g for g in group_cols if g in metrics.columns]
    n = F.count("value")
    mean, sd = F.avg("value"), F.stddev_samp("value")
    half = F.lit(1.96) * sd / F.sqrt(n.cast("double"))
    return (
        _long(metrics, groups, metric_cols)
        .where(F.col("value").isNotNull())
        .groupBy(*groups, "metric")
        .agg(
            mean.alias("mean"),
            sd.alias("sd"),
            (mean - half).alias("ci95_lo"),
            (mean + half).alias("ci95_hi"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            n.alias("n"),
        )
    )


def pooled_metrics(
    pooled: DataFrame,
    group_cols: Sequence[str] = ("model",),
    y_col: str = "y_true",
    p_col: str = "y_prob",
) -> DataFrame:
    """All metrics on rows pooled over splits, one row per group, one ROC table."""
    groups = list(group_cols)
    roc = C.roc_table(pooled, groups, y_col, p_col)
    n = F.max(F.col("n_pos") + F.col("n_neg"))
    return roc.groupBy(*groups).agg(
        *discrimination_aggregates(),
        brier_of_counts().alias("brier"),
        n.alias("n_samples"),
        F.max("n_pos").alias("n_positive"),
        safe_div(F.max("n_pos"), n).alias("prevalence"),
    )


def pooled_specificity_metrics(
    pooled: DataFrame, spec_targets: Sequence[float], group_cols: Sequence[str] = ("model",)
) -> DataFrame:
    return T.multi_target_specificity(pooled, group_cols, spec_targets)


def pooled_thresholds(
    pooled: DataFrame,
    group_cols: Sequence[str] = ("model",),
    target_spec: float = 0.95,
    dca_grid: Sequence[float] | None = None,
) -> DataFrame:
    """Youden, specificity-target and zero-crossing thresholds of pooled rows."""
    crossing = dca.zero_crossing_of_predictions(pooled, group_cols, dca_grid)
    return T.threshold_bundle(pooled, group_cols, target_spec, crossing)


def long_parameters(log: DataFrame, keep: Sequence[str], params_col: str = "params") -> DataFrame:
    """(keep…, param, value) from a map column, or from JSON text of one."""
    col = F.col(params_col)
    if dict(log.dtypes)[params_col] == "string":
        col = F.from_json(col, "map<string,string>")
    return log.select(*keep, F.explode(col).alias("param", "value"))


def summarize_parameters(
    params: DataFrame, group_cols: Sequence[str] = ("model",)
) -> DataFrame:
    """Numbers: mean, SD, range. Other values: mode, distinct count, the values.

    A parameter is numeric if all its values parse. The mode's ties go to the
    smallest value.
    """
    keys = [*group_cols, "param"]
    rows = params.where(F.col("value").isNotNull()).withColumn(
        "number", F.col("value").try_cast("double")
    )
    numeric = F.count_if(F.col("number").isNull()) == 0
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.when(numeric, F.avg("number")).alias("mean"),
        F.when(numeric, F.stddev_samp("number")).alias("sd"),
        F.when(numeric, F.min("number")).alias("min"),
        F.when(numeric, F.max("number")).alias("max"),
        F.when(~numeric, F.mode("value", True)).alias("mode"),
        F.when(~numeric, F.count_distinct("value")).alias("n_unique"),
        F.when(~numeric, F.array_join(F.array_sort(F.collect_set("value")), ", ")).alias("values"),
    )


def coefficient_summary(coefficients: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean, population SD, range, median and runs of every ensemble coefficient."""
    return coefficients.groupBy(*group_cols, "base_model").agg(
        F.avg("coefficient").alias("mean"),
        F.stddev_pop("coefficient").alias("sd"),
        F.min("coefficient").alias("min"),
        F.max("coefficient").alias("max"),
        F.percentile("coefficient", F.lit(0.5)).alias("median"),
        F.count("coefficient").alias("n_splits"),
    )


def ensemble_gain(metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """Ensemble against the best base model, one row."""
    is_ensemble = F.col(model_col) == ENSEMBLE
    agg = metrics.agg(
        F.max(F.when(is_ensemble, F.col("auroc"))).alias("ensemble_auroc"),
        F.max(F.when(~is_ensemble, F.col("auroc"))).alias("best_base_auroc"),
        F.max(F.when(is_ensemble, F.col("prauc"))).alias("ensemble_prauc"),
        F.max(F.when(is_ensemble, F.col("brier"))).alias("ensemble_brier"),
    )
    gain = F.col("ensemble_auroc") - F.col("best_base_auroc")
    percent = F.when(F.col("best_base_auroc") > 0, 100.0 * gain / F.col("best_base_auroc"))
    return agg.withColumns(
        {"auroc_gain": gain, "auroc_gain_percent": F.coalesce(percent, F.lit(0.0))}
    )


def ensemble_metadata(coefficients: DataFrame, metrics: DataFrame) -> DataFrame:
    """Signs and range of the mean coefficients next to the gain, one row."""
    stats = coefficient_summary(coefficients)
    signs = stats.agg(
        F.count(F.lit(1)).alias("n_coefficients"),
        F.count_if(F.col("mean") >= 0).alias("positive_count"),
        F.count_if(F.col("mean") < 0).alias("negative_count"),
        F.min("mean").alias("mean_min"),
        F.max("mean").alias("mean_max"),
        F.max("n_splits").alias("n_splits"),
    )
    return signs.crossJoin(ensemble_gain(metrics))  # one row each


def _ordinary(c: Column) -> Column:
    return F.when(finite(c.cast("double")), c.cast("double"))


def selection_score(
    auroc: Column, brier: Column, slope: Column, weights: Mapping[str, float] | None = None
) -> Column:
    """Weighted mix of AUROC, 1 − Brier and closeness of the slope to one.

    Undefined parts count as 0.5, 0.25 and 1; weights are scaled to sum to one.
    """
    w = dict(weights) if weights else dict(SCORE_WEIGHTS)
    total = sum(w.values())
    if total <= 0:
        w, total = dict(SCORE_WEIGHTS), 1.0
    a = clip(F.coalesce(_ordinary(auroc), F.lit(0.5)), 0.0, 1.0)
    b = F.lit(1.0) - clip(F.coalesce(_ordinary(brier), F.lit(0.25)), 0.0, 1.0)
    off = F.least(F.abs(F.coalesce(_ordinary(slope), F.lit(1.0)) - 1.0), F.lit(1.0))
    part = lambda k: w.get(k, 0.0) / total
    return a * part("auroc") + b * part("brier") + (F.lit(1.0) - off) * part("slope")


def with_selection_scores(
    metrics: DataFrame, weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Add ``selection_score`` to a table with auroc, brier and calib_slope."""
    have = lambda c: F.col(c) if c in metrics.columns else F.lit(None).cast("double")
    score = selection_score(have("auroc"), have("brier"), have("calib_slope"), weights)
    return metrics.withColumn("selection_score", score)


def rank_models(metrics: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Models by selection score, best first, ties by name."""
    scored = with_selection_scores(metrics, weights)
    order = W.partitionBy(F.lit(1)).orderBy(
        F.round("selection_score", 12).desc(), F.col("model")
    )
    return scored.withColumn("rank", F.row_number().over(order))


def model_comparison(
    test: DataFrame, validation: DataFrame, thresholds: DataFrame
) -> DataFrame:
    """Test and validation metrics with thresholds per model, best test AUROC first."""
    prefix = lambda df, p: df.select(
        "model", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "model"]
    )
    wide = thresholds.groupBy("model").agg(
        *[
            F.max(F.when(F.col("kind") == k, F.col("threshold"))).alias(f"{k}_threshold")
            for k in ("youden", "spec_target", "dca")
        ]
    )
    rows = prefix(test, "test").join(prefix(validation, "val"), "model", "left")
    rows = rows.join(wide, "model", "left")
    return rows.withColumn("is_ensemble", F.col("model") == ENSEMBLE).orderBy(
        F.col("test_auroc").desc_nulls_last(), "model"
    )


def base_model_metrics(
    predictions: DataFrame, base_models: Sequence[str], split_seed: int | None = None
) -> DataFrame:
    """AUROC, PR-AUC and Brier per base model and seed."""
    rows = predictions.where(F.col("model").isin(*base_models))
    if split_seed is not None:
        rows = rows.where(F.col("split_seed") == split_seed)
    return pooled_metrics(rows, ["model", "split_seed"]).select(
        "model", "split_seed", "auroc", "prauc", "brier"
    )


def combine_learning_curves(
    points: DataFrame, group_cols: Sequence[str] = (), run_col: str = "run"
) -> DataFrame:
    """Mean per run and training size, then mean, SD and percentiles over runs."""
    per_run = points.groupBy(*group_cols, run_col, "train_size").agg(
        F.avg("train_score").alias("train"), F.avg("val_score").alias("val")
    )
    aggs = []
    several = F.count(F.lit(1)) > 1
    for c in ("train", "val"):
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_sd"),
            F.when(several, F.percentile(c, F.lit(0.025))).alias(f"{c}_ci_lo"),
            F.when(several, F.percentile(c, F.lit(0.975))).alias(f"{c}_ci_hi"),
        ]
    return per_run.groupBy(*group_cols, "train_size").agg(
        *aggs, F.count_distinct(run_col).alias("n_runs")
    )


def combine_trials(
    trials: DataFrame, split_col: str = "split_seed", maximize: bool = True
) -> DataFrame:
    """Best value per split, then its mean and SD, and trials per split."""
    best = F.max("value") if maximize else F.min("value")
    per_split = trials.groupBy(split_col).agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    return per_split.agg(
        F.count(F.lit(1)).alias("n_splits"),
        F.sum("n").alias("total_trials"),
        F.avg("best").alias("mean_best_value"),
        F.stddev_samp("best").alias("std_best_value"),
        F.avg("n").alias("trials_per_split"),
    )


def holdout_metrics(
    predictions: DataFrame,
    thresholds: Mapping[str, float],
    group_cols: Sequence[str] = (),
    clinical_points: Sequence[float] = (),
) -> tuple[DataFrame, DataFrame]:
    """Metric row per group, and confusion metrics at stored and clinical thresholds."""
    groups = list(group_cols)
    row = pooled_metrics(predictions, groups)
    row = join_on_keys(row, calibration_intercept_slope(predictions, groups), groups)
    row = join_on_keys(row, expected_calibration_error(predictions, groups), groups)
    named = [(k, float(v)) for k, v in thresholds.items()]
    named += [(f"clin_{p}".replace(".", "p"), float(p)) for p in clinical_points if 0 < p < 1]
    roc = C.roc_table(predictions, groups)
    entries = [
        F.struct(F.lit(k).alias("kind"), F.lit(v).alias("threshold")) for k, v in named
    ]
    wanted = roc.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).select(
        *groups, F.inline(F.array(*entries))
    )
    return row, T.metrics_at_thresholds(roc, wanted, groups)


def stack_repeats(
    oof: DataFrame, keep: Sequence[str], prefix: str = "y_prob_repeat"
) -> DataFrame:
    """Long out-of-fold rows (keep…, repeat, y_prob) from one column per repeat."""
    columns = [c for c in oof.columns if c.startswith(prefix)]
    if not columns:
        raise ValueError(f"no columns named {prefix}*")
    entries = [
        F.struct(
            F.lit(int(c[len(prefix) :])).alias("repeat"), F.col(c).cast("double").alias("y_prob")
        )
        for c in columns
    ]
    rows = oof.select(*keep, F.inline(F.array(*entries)))
    return rows.where(finite(F.col("y_prob")))


def fill_from_repeats(oof: DataFrame, prefix: str = "y_prob_repeat") -> DataFrame:
    """``y_prob``, or where it is missing the mean over the repeat columns present."""
    columns = [F.col(c).cast("double") for c in oof.columns if c.startswith(prefix)]
    present = F.filter(F.array(*columns), lambda v: v.isNotNull() & ~F.isnan(v))
    mean = F.try_divide(
        F.aggregate(present, F.lit(0.0), lambda a, v: a + v), F.size(present).cast("double")
    )
    own = F.col("y_prob").cast("double") if "y_prob" in oof.columns else F.lit(None).cast("double")
    return oof.withColumn("y_prob", F.coalesce(F.when(~F.isnan(own), own), mean))


def oof_tables(
    oof_long: DataFrame, group_cols: Sequence[str] = ("model",), target_spec: float = 0.95
) -> dict[str, DataFrame]:
    """Thresholds and ROC, PR and calibration bands over the repeats."""
    return {
        "thresholds": T.threshold_bundle(oof_long, group_cols, target_spec),
        "roc": curve_band(oof_long, group_cols, "repeat", "roc"),
        "pr": curve_band(oof_long, group_cols, "repeat", "pr"),
        "calibration": calibration_band(oof_long, group_cols, "repeat"),
    }


def risk_histogram(
    predictions: DataFrame,
    group_cols: Sequence[str] = (),
    category_col: str = "category",
    p_col: str = "y_prob",
) -> DataFrame:
    """Scores per category in min(60, max(10, √n)) even bins of the group's range."""
    groups = list(group_cols)
    p = F.col(p_col).cast("double")
    rows = predictions.where(finite(p))
    size = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__n"), F.min(p).alias("__lo"), F.max(p).alias("__hi")
    ).withColumn(
        "n_bins",
        F.least(
            F.lit(60), F.greatest(F.lit(10), F.floor(F.sqrt(F.col("__n").cast("double"))))
        ).cast("int"),
    )
    width = F.col("__hi") - F.col("__lo")
    place = F.floor(F.try_divide(p - F.col("__lo"), width) * F.col("n_bins"))
    index = F.coalesce(F.least(place, F.col("n_bins") - 1), F.lit(0)).cast("int")
    binned = join_on_keys(rows, size, groups).withColumn("bin", index)
    out = binned.groupBy(*groups, category_col, "n_bins", "__lo", "__hi", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )
    step = (F.col("__hi") - F.col("__lo")) / F.col("n_bins")
    return out.select(
        *groups,
        category_col,
        "bin",
        (F.col("__lo") + F.col("bin") * step).alias("bin_start"),
        (F.col("__lo") + (F.col("bin") + 1) * step).alias("bin_end"),
        "n",
    )


def risk_distribution(
    predictions: DataFrame,
    group_cols: Sequence[str] = ("model",),
    category_col: str = "category",
    target_spec: float = 0.95,
) -> dict[str, DataFrame]:
    """Histogram, score statistics by category, thresholds with their metrics."""
    return {
        "histogram": risk_histogram(predictions, group_cols, category_col),
        "statistics": distribution_stats(predictions, [*group_cols, category_col]),
        "thresholds": T.threshold_bundle(predictions, group_cols, target_spec),
    }


def aggregation_metadata(
    stability: DataFrame, reports: DataFrame, predictions: DataFrame, top: int = 10
) -> DataFrame:
    """One row: models, splits, and the most stable and most frequent features."""
    models = predictions.agg(
        F.array_sort(F.collect_set("model")).alias("models"),
        F.array_sort(F.collect_set("split_seed")).alias("split_seeds"),
    )
    first = lambda df, key, out: (
        df.orderBy(F.col(key).desc(), "feature")
        .limit(top)
        .agg(F.collect_list(F.struct(F.col(key).alias("k"), "feature")).alias("__l"))
        .select(
            F.transform(
                F.array_sort(
                    "__l",
                    lambda a, b: F.when(a["k"] > b["k"], -1)
                    .when(a["k"] < b["k"], 1)
                    .when(a["feature"] < b["feature"], -1)
                    .otherwise(1),
                ),
                lambda e: e["feature"],
            ).alias(out)
        )
    )
    # One row each.
    return models.crossJoin(first(stability, "selection_fraction", "top_stable")).crossJoin(
        first(reports, "selection_freq_mean", "top_frequent")
    )
