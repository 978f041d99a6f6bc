"""Discrimination and probability metrics, one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.joins import join_on_keys
from riskloom.functions.ordered import exact_quantiles
from riskloom.functions.prob import clip, finite, safe_div
from riskloom.operators import curves as C


def auroc(df: DataFrame, group_cols: Sequence[str], strict: bool = False, **cols) -> DataFrame:
    """Area under the ROC curve, ties half; NULL for a single class."""
    roc = C.roc_table(df, group_cols, **cols)
    return roc.groupBy(*group_cols).agg(
        C.only_two_class(C.auroc_of_roc(), strict, "auroc").alias("auroc")
    )


def prauc(df: DataFrame, group_cols: Sequence[str], strict: bool = False, **cols) -> DataFrame:
    """Average precision."""
    roc = C.roc_table(df, group_cols, **cols)
    return roc.groupBy(*group_cols).agg(
        C.only_two_class(C.average_precision_of_roc(), strict, "prauc").alias("prauc")
    )


def youden_j(df: DataFrame, group_cols: Sequence[str], strict: bool = False, **cols) -> DataFrame:
    """Largest TPR − FPR."""
    roc = C.roc_table(df, group_cols, **cols)
    return roc.groupBy(*group_cols).agg(
        C.only_two_class(C.youden_of_roc(), strict, "youden").alias("youden")
    )


def sensitivity_at_specificity(
    df: DataFrame,
    group_cols: Sequence[str],
    target_specificity: float = 0.95,
    strict: bool = False,
    **cols,
) -> DataFrame:
    if not 0 < target_specificity < 1:
        raise ValueError("target_specificity must lie in (0, 1)")
    roc = C.roc_table(df, group_cols, **cols)
    value = C.sensitivity_at_specificity_of_roc(target_specificity)
    return roc.groupBy(*group_cols).agg(
        C.only_two_class(value, strict, "sensitivity").alias("alpha")
    )


def tpr_at_fpr(
    df: DataFrame, group_cols: Sequence[str], target_fpr: float = 0.05, **cols
) -> DataFrame:
    roc = C.roc_table(df, group_cols, **cols)
    return roc.groupBy(*group_cols).agg(
        C.only_two_class(C.tpr_at_fpr_of_roc(target_fpr)).alias("tpr_at_fpr")
    )


def discrimination_metrics(
    df: DataFrame,
    group_cols: Sequence[str],
    include_youden: bool = True,
    include_alpha: bool = True,
    alpha_target_specificity: float = 0.95,
    strict: bool = False,
    **cols,
) -> DataFrame:
    """AUROC, PR-AUC, Youden J and sensitivity at a specificity from one ROC table."""
    roc = C.roc_table(df, group_cols, **cols)
    return roc.groupBy(*group_cols).agg(
        *discrimination_aggregates(include_youden, include_alpha, alpha_target_specificity, strict)
    )


def discrimination_aggregates(
    include_youden: bool = True,
    include_alpha: bool = True,
    alpha_target_specificity: float = 0.95,
    strict: bool = False,
) -> list[Column]:
    """The aggregates of ``discrimination_metrics`` over a ROC table."""
    out = [
        C.only_two_class(C.auroc_of_roc(), strict).alias("auroc"),
        C.only_two_class(C.average_precision_of_roc(), strict).alias("prauc"),
    ]
    if include_youden:
        out.append(C.only_two_class(C.youden_of_roc(), strict).alias("youden"))
    if include_alpha:
        value = C.sensitivity_at_specificity_of_roc(alpha_target_specificity)
        out.append(C.only_two_class(value, strict).alias("sensitivity_at_spec"))
    return out


def brier_of(y: Column, p: Column) -> Column:
    d = y.cast("double") - p
    return F.avg(d * d)


def log_loss_of(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.avg(-F.when(y == 1, F.log(q)).otherwise(F.log(F.lit(1.0) - q)))


def brier_score(
    df: DataFrame, group_cols: Sequence[str], y_col: str = "y_true", p_col: str = "y_prob"
) -> DataFrame:
    return df.groupBy(*group_cols).agg(brier_of(F.col(y_col), F.col(p_col)).alias("brier"))


def log_loss(
    df: DataFrame,
    group_cols: Sequence[str],
    y_col: str = "y_true",
    p_col: str = "y_prob",
    eps: float = 1e-15,
) -> DataFrame:
    return df.groupBy(*group_cols).agg(
        log_loss_of(F.col(y_col), F.col(p_col), eps).alias("log_loss")
    )


def brier_of_counts() -> Column:
    """Brier score over score-level counts or ROC rows."""
    s = F.col("score")
    total = F.sum(F.col("pos") * (F.lit(1.0) - s) * (F.lit(1.0) - s) + F.col("neg") * s * s)
    return total / F.sum(F.col("pos") + F.col("neg"))


def ensemble_metrics(df: DataFrame, group_cols: Sequence[str], **cols) -> DataFrame:
    """AUROC, PR-AUC, Brier, rows, positives and prevalence per group."""
    roc = C.roc_table(df, group_cols, **cols)
    return roc.groupBy(*group_cols).agg(
        C.only_two_class(C.auroc_of_roc()).alias("auroc"),
        C.only_two_class(C.average_precision_of_roc()).alias("prauc"),
        brier_of_counts().alias("brier"),
        F.max(F.col("n_pos") + F.col("n_neg")).alias("n_samples"),
        F.max("n_pos").alias("n_positive"),
        F.max(safe_div(F.col("n_pos"), F.col("n_pos") + F.col("n_neg"))).alias("prevalence"),
    )


def cv_repeat_metrics(
    oof: DataFrame, group_cols: Sequence[str] = ("model", "split_seed"), repeat_col: str = "repeat"
) -> DataFrame:
    """AUROC, PR-AUC and Brier of every repeat of out-of-fold predictions."""
    return ensemble_metrics(oof, [*group_cols, repeat_col]).select(
        *group_cols, repeat_col, "auroc", "prauc", "brier"
    )


def distribution_stats(
    df: DataFrame, group_cols: Sequence[str], value_col: str = "y_prob"
) -> DataFrame:
    """Mean, median, inter-quartile range and population SD of scores."""
    rows = df.where(finite(F.col(value_col)))
    moments = rows.groupBy(*group_cols).agg(
        F.avg(value_col).alias("mean"), F.stddev_pop(value_col).alias("sd")
    )
    quartiles = exact_quantiles(rows, group_cols, value_col, [0.25, 0.5, 0.75], True)
    return join_on_keys(moments, quartiles, group_cols).select(
        *group_cols,
        "mean",
        F.col("q_1").alias("median"),
        (F.col("q_2") - F.col("q_0")).alias("iqr"),
        "sd",
    )


def curve_band(
    df: DataFrame,
    group_cols: Sequence[str],
    split_col: str,
    curve: str = "roc",
    n_points: int = 120,
    **cols,
) -> DataFrame:
    """Mean, SD and 2.5 / 97.5 percentiles of a curve over splits.

    Each split's curve is read at ``n_points`` evenly spaced x values by linear
    interpolation: TPR at FPR for ``roc``, precision at recall for ``pr``. The
    x grid is placed by arithmetic on each curve segment, so a segment emits
    only the grid points it covers.
    """
    keys = [*group_cols, split_col]
    return band_over_splits(
        interpolated_curve(df, keys, curve, n_points, **cols), group_cols, "x", "y"
    )


def band_over_splits(
    points: DataFrame, group_cols: Sequence[str], x_col: str, y_col: str
) -> DataFrame:
    """Mean, population SD and 2.5 / 97.5 percentiles of y per x over splits."""
    y = F.col(y_col)
    return points.groupBy(*group_cols, x_col).agg(
        F.avg(y).alias("mean"),
        F.stddev_pop(y).alias("sd"),
        F.percentile(y, F.lit(0.025)).alias("lower"),
        F.percentile(y, F.lit(0.975)).alias("upper"),
        F.count(y).alias("n_splits"),
    )


def interpolated_curve(
    df: DataFrame, keys: Sequence[str], curve: str = "roc", n_points: int = 120, **cols
) -> DataFrame:
    """Curve of every key read at an even x grid (see ``curve_band``)."""
    roc = C.roc_table(df, keys, **cols).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    last = n_points - 1
    # A segment runs from the point before a score to the score's own point and
    # owns x in [x0, x1). Where several points share an x, it starts at the last
    # of them, the one linear interpolation reads there.
    if curve == "roc":
        x0 = safe_div(F.col("fp") - F.col("neg"), F.col("n_neg"))
        y0 = safe_div(F.col("tp") - F.col("pos"), F.col("n_pos"))
        x1, y1, end = F.col("fpr"), F.col("tpr"), F.lit(1.0)
    elif curve == "pr":
        before = F.col("tp") - F.col("pos") + F.col("fp") - F.col("neg")
        x0 = safe_div(F.col("tp") - F.col("pos"), F.col("n_pos"))
        y0 = F.coalesce(safe_div(F.col("tp") - F.col("pos"), before), F.lit(1.0))
        x1, y1 = F.col("tpr"), F.col("precision")
        end = F.max(safe_div(F.col("n_pos"), F.col("n_pos") + F.col("n_neg")))
    else:
        raise ValueError(f"unknown curve: {curve}")
    segments = roc.select(*keys, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    low = F.ceil(F.col("x0") * last)
    high = F.ceil(F.col("x1") * last) - 1
    x = F.col("i") / F.lit(float(last))
    inner = (
        segments.where((F.col("x1") > F.col("x0")) & (high >= low))
        .withColumn("i", F.explode(F.sequence(low, high)))
        .select(
            *keys,
            "i",
            (
                F.col("y0")
                + (F.col("y1") - F.col("y0"))
                * (x - F.col("x0"))
                / (F.col("x1") - F.col("x0"))
            ).alias("y"),
        )
    )
    if curve == "roc":  # the drawn curve is pinned to the origin
        inner = inner.withColumn("y", F.when(F.col("i") == 0, F.lit(0.0)).otherwise(F.col("y")))
    final = roc.groupBy(*keys).agg(end.alias("y")).select(
        *keys, F.lit(last).cast("bigint").alias("i"), "y"
    )
    return inner.unionByName(final).withColumn("x", x)
