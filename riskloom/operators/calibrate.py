"""Calibration measures, calibrators and prevalence adjustment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.bins import even_bin
from riskloom.functions.joins import join_on_keys
from riskloom.functions.ordered import exact_quantiles
from riskloom.functions.prob import clip, finite, inv_logit, logit, safe_div, shift_prevalence
from riskloom.operators.curves import score_counts
from riskloom.operators.discrimination import band_over_splits
from riskloom.operators.isotonic import block_ends, isotonic_blocks
from riskloom.session import checkpointed

MAX_NEWTON_STEPS = 25
GRADIENT_TOLERANCE = 1e-10
MAX_STEP = 5.0


def calibration_intercept_slope(
    df: DataFrame, group_cols: Sequence[str], y_col: str = "y_true", p_col: str = "y_prob"
) -> DataFrame:
    """Unpenalised logistic fit of y on logit(p), all groups at once.

    Newton's method: every step is one aggregation of five sums per group, so
    the driver sees one row per group. Rows are first counted per score, and
    that table (checkpointed) is what the steps read. A single class, or a
    fit that does not converge, gives NULL.
    """
    from riskloom.session import checkpointed

    groups = list(group_cols)
    spark = df.sparkSession
    counts = score_counts(df, groups, y_col, p_col).select(
        *groups, logit(F.col("score")).alias("x"), "pos", "neg"
    )
    counts = checkpointed(counts)
    totals = counts.groupBy(*groups).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    ).toPandas()
    state = totals[groups].copy()
    state["a"] = np.where(
        (totals.n_pos > 0) & (totals.n_neg > 0), 0.0, np.nan
    )
    state["b"] = np.where(np.isnan(state["a"]), np.nan, 1.0)
    state["done"] = np.isnan(state["a"])
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*groups).schema)]
        + ["a double", "b double"]
    )
    x, p = F.col("x"), F.col("__p")
    n = (F.col("pos") + F.col("neg")).cast("double")
    weight, residual = n * p * (F.lit(1.0) - p), F.col("pos") - n * p
    for _ in range(MAX_NEWTON_STEPS):
        active = state.loc[~state["done"], [*groups, "a", "b"]]
        if active.empty:
            break
        params = spark.createDataFrame(active, schema)
        sums = (
            join_on_keys(counts, params, groups)
            .withColumn("__p", inv_logit(F.col("a") + F.col("b") * x))
            .groupBy(*groups)
            .agg(
                F.sum(weight).alias("w"),
                F.sum(weight * x).alias("wx"),
                F.sum(weight * x * x).alias("wxx"),
                F.sum(residual).alias("r"),
                F.sum(residual * x).alias("rx"),
                F.sum(n).alias("n"),
            )
            .toPandas()
        )
        if groups:
            at = state[groups].merge(sums, how="left", on=groups)
        else:
            at = sums
        det = at.w * at.wxx - at.wx * at.wx
        open_rows = ~state["done"].to_numpy()
        singular = (det.abs() < 1e-300).to_numpy() | det.isna().to_numpy()
        with np.errstate(all="ignore"):
            da = ((at.wxx * at.r - at.wx * at.rx) / det).clip(-MAX_STEP, MAX_STEP).to_numpy()
            db = ((at.w * at.rx - at.wx * at.r) / det).clip(-MAX_STEP, MAX_STEP).to_numpy()
        step = open_rows & ~singular
        state.loc[step, "a"] += da[step]
        state.loc[step, "b"] += db[step]
        state.loc[open_rows & singular, ["a", "b"]] = np.nan
        small = (np.abs(da) + np.abs(db)) < GRADIENT_TOLERANCE
        state["done"] = state["done"] | (open_rows & (small | singular))
    state.loc[~state["done"], ["a", "b"]] = np.nan
    out = state[[*groups, "a", "b"]]
    frame = spark.createDataFrame(out, schema)
    return frame.select(
        *groups,
        F.nanvl("a", F.lit(None).cast("double")).alias("calib_intercept"),
        F.nanvl("b", F.lit(None).cast("double")).alias("calib_slope"),
    )


def expected_calibration_error(
    df: DataFrame,
    group_cols: Sequence[str],
    n_bins: int = 10,
    y_col: str = "y_true",
    p_col: str = "y_prob",
) -> DataFrame:
    """Share-weighted gap between mean score and event rate over even bins."""
    per_bin = binned_means(df, group_cols, n_bins, y_col, p_col)
    gap = F.abs(F.col("mean_pred") - F.col("event_rate")) * F.col("n")
    return per_bin.groupBy(*group_cols).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def binned_means(
    df: DataFrame,
    group_cols: Sequence[str],
    n_bins: int = 10,
    y_col: str = "y_true",
    p_col: str = "y_prob",
) -> DataFrame:
    rows = df.where(finite(F.col(p_col)) & F.col(y_col).isNotNull())
    return even_bin(rows, p_col, n_bins).groupBy(*group_cols, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p_col).alias("mean_pred"),
        F.avg(F.col(y_col).cast("double")).alias("event_rate"),
    )


def calibration_curve(
    df: DataFrame, group_cols: Sequence[str], n_bins: int = 10, **cols
) -> DataFrame:
    """Mean score and observed rate per even bin; groups with one class drop out."""
    per_bin = binned_means(df, group_cols, n_bins, **cols)
    classes = per_bin.groupBy(*group_cols).agg(
        (F.sum(F.col("event_rate") * F.col("n")) / F.sum("n")).alias("__rate")
    )
    mixed = classes.where((F.col("__rate") > 0) & (F.col("__rate") < 1)).drop("__rate")
    return join_on_keys(per_bin, mixed, group_cols, "left_semi").select(
        *group_cols,
        "bin",
        F.col("mean_pred").alias("bin_center"),
        F.col("event_rate").alias("observed_freq"),
    )


def calibration_band(
    df: DataFrame, group_cols: Sequence[str], split_col: str, n_bins: int = 10, **cols
) -> DataFrame:
    """Observed rate per bin and split, then mean, SD and 2.5 / 97.5 percentiles."""
    per_bin = binned_means(df, [*group_cols, split_col], n_bins, **cols)
    band = band_over_splits(per_bin, group_cols, "bin", "event_rate")
    sizes = per_bin.groupBy(*group_cols, "bin").agg(F.sum("n").alias("n_rows"))
    return join_on_keys(band, sizes, [*group_cols, "bin"])


def quantile_bins(
    df: DataFrame,
    group_cols: Sequence[str],
    n_bins: int = 10,
    y_col: str = "y_true",
    p_col: str = "y_prob",
    strategy: str = "quantile",
) -> DataFrame:
    """Rows, events and mean score per bin with per-group edges.

    Quantile edges that coincide merge; fewer than two bins left means even bins.
    """
    groups = list(group_cols)
    rows = df.where(finite(F.col(p_col)) & F.col(y_col).isNotNull()).select(
        *groups, F.col(y_col).cast("int").alias("__y"), F.col(p_col).cast("double").alias("__p")
    )
    even = F.array(*[F.lit(float(e)) for e in np.linspace(0, 1, n_bins + 1)])
    if strategy == "quantile":
        probs = [i / n_bins for i in range(n_bins + 1)]
        q = exact_quantiles(rows, groups, "__p", probs, probabilities=True)
        edges = q.select(
            *groups,
            F.array_sort(F.array_distinct(F.array(*[F.col(f"q_{i}") for i in range(n_bins + 1)])))
            .alias("edges"),
        ).withColumn("edges", F.when(F.size("edges") < 3, even).otherwise(F.col("edges")))
        rows = join_on_keys(rows, edges, groups)
    else:
        rows = rows.withColumn("edges", even)
    at_or_below = F.size(F.filter("edges", lambda e: e <= F.col("__p")))
    index = F.greatest(F.lit(0), F.least(at_or_below - 1, F.size("edges") - 2))
    return rows.withColumn("bin", index).groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__y").alias("k"), F.avg("__p").alias("mean_pred")
    )


def binned_logits(
    df: DataFrame,
    group_cols: Sequence[str],
    n_bins: int = 10,
    strategy: str = "quantile",
    min_bin_size: int = 1,
    merge_tail: bool = False,
    n_boot: int = 500,
    seed: int = 42,
    **cols,
) -> DataFrame:
    """Predicted and observed log-odds per bin with in-bin bootstrap bounds.

    Resampling n rows of a 0/1 column and summing is a Binomial(n, k/n) draw,
    so a bin's replicates are binomial variates: the bootstrap works on one row
    per bin, never on people.
    """
    bins = quantile_bins(df, group_cols, n_bins, strategy=strategy, **cols)
    if merge_tail:
        bins = bins.where(F.col("n") >= min_bin_size)
    smoothed = (F.col("k") + 0.5) / (F.col("n") + 1)
    bins = bins.select(
        *group_cols,
        "bin",
        "n",
        "k",
        logit(F.col("mean_pred")).alias("logit_pred"),
        logit(smoothed).alias("logit_obs"),
        F.xxhash64(F.lit(seed), *group_cols, F.col("bin")).alias("__seed"),
    )

    def bounds(n: pd.Series, k: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        rows = []
        for size, events, s in zip(n, k, seeds, strict=True):
            rng = np.random.default_rng(int(s) & 0xFFFFFFFFFFFFFFFF)
            draws = rng.binomial(int(size), events / size, n_boot)
            prop = np.clip((draws + 0.5) / (size + 1), 1e-7, 1 - 1e-7)
            values = np.log(prop / (1 - prop))
            low, high = np.percentile(values, [2.5, 97.5])
            rows.append((low, high, values.std()))
        return pd.DataFrame(rows, columns=["lower", "upper", "sd"])

    draw = F.pandas_udf(bounds, "lower double, upper double, sd double")
    out = bins.withColumn("__b", draw("n", "k", "__seed"))
    return out.select(
        *group_cols, "bin", "n", "logit_pred", "logit_obs", "__b.lower", "__b.upper", "__b.sd"
    )


class OOFCalibrator:
    """Isotonic or sigmoid map fitted on out-of-fold predictions."""

    def __init__(self, method: str = "isotonic"):
        if method not in ("isotonic", "sigmoid"):
            raise ValueError(f"unknown calibration method: {method}")
        self.method = method
        self.model: IsotonicRegressionModel | None = None
        self.intercept: float | None = None
        self.slope: float | None = None

    def fit(self, oof: DataFrame, p_col: str = "y_prob", y_col: str = "y_true") -> OOFCalibrator:
        """Fit on rows that have a score and a label; needs 10 rows and two classes."""
        counts = checkpointed(score_counts(oof, [], y_col, p_col))
        n_pos, n_neg = counts.agg(F.sum("pos"), F.sum("neg")).first()
        n_pos, n_neg = n_pos or 0, n_neg or 0
        if n_pos + n_neg < 10:
            raise ValueError(f"calibration needs at least 10 rows, got {n_pos + n_neg}")
        if not n_pos or not n_neg:
            raise ValueError("calibration needs both classes")
        if self.method == "isotonic":
            # The driver's fit sees only the ends of blocks that tasks have pooled.
            rows = block_ends(isotonic_blocks(counts))
            self.model = IsotonicRegression(
                featuresCol="score", labelCol="rate", weightCol="n", isotonic=True
            ).fit(rows)
        else:
            fit = calibration_intercept_slope(oof, [], y_col, p_col).first()
            if fit["calib_slope"] is None:
                raise ValueError("sigmoid calibration did not converge")
            self.intercept, self.slope = fit["calib_intercept"], fit["calib_slope"]
        return self

    def transform(self, df: DataFrame, p_col: str = "y_prob", out_col: str | None = None) -> DataFrame:
        """Replace or add the calibrated probability, clipped to [0, 1]."""
        out = out_col or p_col
        if self.method == "sigmoid":
            if self.slope is None:
                raise RuntimeError("fit the calibrator first")
            value = inv_logit(F.lit(self.intercept) + F.lit(self.slope) * logit(F.col(p_col)))
            return df.withColumn(out, clip(value, 0.0, 1.0))
        if self.model is None:
            raise RuntimeError("fit the calibrator first")
        model = self.model.setFeaturesCol("__score").setPredictionCol("__iso")
        scored = model.transform(df.withColumn("__score", F.col(p_col).cast("double")))
        return scored.withColumn(out, clip(F.col("__iso"), 0.0, 1.0)).drop("__score", "__iso")


def apply_base_calibration(
    predictions: DataFrame,
    calibrators: dict[str, OOFCalibrator],
    model_col: str = "model",
    p_col: str = "y_prob",
) -> DataFrame:
    """Calibrate the rows of models that have a post-hoc calibrator, once.

    Rows already marked ``calibrated`` are left as they are.
    """
    flagged = predictions
    if "calibrated" not in flagged.columns:
        flagged = flagged.withColumn("calibrated", F.lit(False))
    todo = F.col(model_col).isin(list(calibrators)) & ~F.col("calibrated")
    out = flagged.where(~F.coalesce(todo, F.lit(False)))
    for name, calibrator in calibrators.items():
        rows = flagged.where((F.col(model_col) == name) & ~F.col("calibrated"))
        out = out.unionByName(
            calibrator.transform(rows, p_col).withColumn("calibrated", F.lit(True))
        )
    return out


def fold_calibration(
    scored: DataFrame, fold_col: str, method: str = "sigmoid", strategy: str = "per_fold", **cols
) -> DataFrame:
    """Calibrate every fold's scores with a map fitted on the other folds' scores.

    Strategies ``none`` and ``oof_posthoc`` leave the scores as they are.
    """
    if strategy in ("none", "oof_posthoc"):
        return scored
    folds = [r[0] for r in scored.select(fold_col).distinct().orderBy(fold_col).collect()]
    parts = [
        OOFCalibrator(method)
        .fit(scored.where(F.col(fold_col) != f), **cols)
        .transform(scored.where(F.col(fold_col) == f))
        for f in folds
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def adjust_for_prevalence(
    df: DataFrame,
    sample_prev: float | Column,
    target_prev: float | Column,
    p_col: str = "y_prob",
    out_col: str = "y_prob_adjusted",
) -> DataFrame:
    """Add scores shifted from the sample's to the target's prevalence."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v).cast("double")
    return df.withColumn(
        out_col, shift_prevalence(F.col(p_col), as_col(sample_prev), as_col(target_prev))
    )


class PrevalenceShift(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Pipeline stage that shifts a probability column to a target prevalence."""

    samplePrevalence = Param(
        Params._dummy(), "samplePrevalence", "training prevalence", TypeConverters.toFloat
    )
    targetPrevalence = Param(
        Params._dummy(), "targetPrevalence", "deployment prevalence", TypeConverters.toFloat
    )

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str = "y_prob",
        outputCol: str = "y_prob_adjusted",
        samplePrevalence: float = 0.5,
        targetPrevalence: float = 0.5,
    ):
        super().__init__()
        self._setDefault(inputCol="y_prob", outputCol="y_prob_adjusted")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return adjust_for_prevalence(
            dataset,
            self.getOrDefault(self.samplePrevalence),
            self.getOrDefault(self.targetPrevalence),
            self.getInputCol(),
            self.getOutputCol(),
        )


def positive_probability(probability_col: str = "probability") -> Column:
    """Second entry of a Spark ML probability vector, clipped to [0, 1]."""
    return clip(vector_to_array(F.col(probability_col))[1], 0.0, 1.0)


def score_rows(model, df: DataFrame, out_col: str = "y_prob") -> DataFrame:
    """Apply a fitted pipeline and keep the input columns plus the probability."""
    scored = model.transform(df)
    return scored.select(*df.columns, positive_probability().alias(out_col))


def score_with_adjustment(
    model, df: DataFrame, train_prevalence: float, target_prevalence: float
) -> DataFrame:
    """Raw and prevalence-adjusted probability columns."""
    return adjust_for_prevalence(score_rows(model, df), train_prevalence, target_prevalence)


def prediction_summary(
    predictions: DataFrame, group_cols: Sequence[str], y_col: str = "y_true"
) -> DataFrame:
    """Rows, positives and prevalence of scored rows."""
    n, k = F.count(F.lit(1)), F.sum(F.col(y_col)).cast("bigint")
    return predictions.groupBy(*group_cols).agg(
        n.alias("n"), k.alias("n_pos"), safe_div(k, n).alias("prevalence")
    )
