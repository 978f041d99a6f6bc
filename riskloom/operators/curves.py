"""The grouped ROC / precision-recall table that the metric families share.

Rows are first counted per (group, score), so equal scores meet in one row and
the shuffle carries counts, not people. Running totals then give the confusion
counts at every distinct score without sorting a group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordered import CELL, probability_cell, running_totals, with_value_cells
from riskloom.functions.prob import finite, safe_div


def score_counts(
    df: DataFrame,
    group_cols: Sequence[str],
    y_col: str = "y_true",
    p_col: str = "y_prob",
    weight_col: str | None = None,
) -> DataFrame:
    """Positives and negatives per (group, score); rows without a score drop out."""
    weight = F.col(weight_col) if weight_col else F.lit(1).cast("bigint")
    y, p = F.col(y_col), F.col(p_col).cast("double")
    return (
        df.where(finite(p) & y.isNotNull())
        .groupBy(*group_cols, p.alias("score"))
        .agg(
            F.sum(F.when(y == 1, weight).otherwise(F.lit(0))).cast("bigint").alias("pos"),
            F.sum(F.when(y == 1, F.lit(0)).otherwise(weight)).cast("bigint").alias("neg"),
        )
    )


def roc_from_counts(
    counts: DataFrame, group_cols: Sequence[str], probabilities: bool = True
) -> DataFrame:
    """Confusion counts at each score, from a ``score_counts`` table.

    ``tp``/``fp`` count rows with a score at or above the row's score.
    ``kept`` marks the points that remain when collinear ones are dropped: the
    highest and lowest score, and every point whose step differs from the next.
    """
    groups = list(group_cols)
    counts = counts.where((F.col("pos") > 0) | (F.col("neg") > 0))
    if probabilities:
        celled = counts.withColumn(CELL, probability_cell(F.col("score")))
    else:
        celled = with_value_cells(counts, groups, "score")
    cum = running_totals(celled, groups, ["score"], ["pos", "neg"], carry_cols=["pos", "neg"])
    n_pos, n_neg = F.col("total_pos"), F.col("total_neg")
    tp = n_pos - F.col("cum_pos") + F.col("pos")
    fp = n_neg - F.col("cum_neg") + F.col("neg")
    highest = (F.col("cum_pos") == n_pos) & (F.col("cum_neg") == n_neg)
    lowest = F.col("prev_pos").isNull()
    bend = (F.col("prev_pos") != F.col("pos")) | (F.col("prev_neg") != F.col("neg"))
    return cum.select(
        *groups,
        "score",
        "pos",
        "neg",
        "cum_pos",
        "cum_neg",
        n_pos.alias("n_pos"),
        n_neg.alias("n_neg"),
        tp.alias("tp"),
        fp.alias("fp"),
        (n_neg - fp).alias("tn"),
        (n_pos - tp).alias("fn"),
        safe_div(tp, n_pos).alias("tpr"),
        safe_div(fp, n_neg).alias("fpr"),
        safe_div(tp, tp + fp).alias("precision"),
        (highest | lowest | bend).alias("kept"),
    )


def roc_table(
    df: DataFrame,
    group_cols: Sequence[str],
    y_col: str = "y_true",
    p_col: str = "y_prob",
    probabilities: bool = True,
) -> DataFrame:
    """ROC and precision-recall points of every group (see ``roc_from_counts``)."""
    return roc_from_counts(score_counts(df, group_cols, y_col, p_col), group_cols, probabilities)


def both_classes() -> Column:
    return (F.max("n_pos") > 0) & (F.max("n_neg") > 0)


def only_two_class(value: Column, strict: bool = False, name: str = "metric") -> Column:
    """NULL (or an error, if ``strict``) for a group with a single class."""
    if not strict:
        return F.when(both_classes(), value)
    return F.when(both_classes(), value).otherwise(
        F.raise_error(F.lit(f"{name} needs both classes")).cast("double")
    )


def auroc_of_roc() -> Column:
    """Aggregate over ROC rows: pairs won, ties half, over all pairs."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    won = F.sum(pos * (F.col("cum_neg").cast("double") - neg / 2))
    return F.try_divide(won, F.max("n_pos").cast("double") * F.max("n_neg").cast("double"))


def average_precision_of_roc() -> Column:
    """Aggregate over ROC rows: recall steps times precision (no trapezoid)."""
    return F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("n_pos").cast("double"))


def youden_of_roc() -> Column:
    return F.greatest(F.max(F.col("tpr") - F.col("fpr")), F.lit(0.0))


def sensitivity_at_specificity_of_roc(target: float) -> Column:
    """Best TPR among kept points with specificity at or above the target.

    The origin of the curve has specificity 1, so one point always qualifies.
    """
    ok = F.col("kept") & (F.lit(1.0) - F.col("fpr") >= target)
    return F.coalesce(F.max(F.when(ok, F.col("tpr"))), F.lit(0.0))


def tpr_at_fpr_of_roc(target: float) -> Column:
    ok = F.col("kept") & (F.col("fpr") <= target)
    return F.coalesce(F.max(F.when(ok, F.col("tpr"))), F.lit(0.0))
