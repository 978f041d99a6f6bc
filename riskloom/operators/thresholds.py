"""Operating thresholds and metrics at thresholds, one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.joins import join_on_keys
from riskloom.functions.ordered import running_totals, with_id_cells
from riskloom.functions.prob import finite, ratio_or_zero, safe_div
from riskloom.operators import curves as C

DEFAULT_THRESHOLD = 0.5
ABOVE_MAX = 1e-12


def _f_beta(beta: float) -> Column:
    b2 = beta * beta if beta > 0 else 1.0
    precision, recall = F.col("precision"), F.coalesce(F.col("tpr"), F.lit(0.0))
    return F.coalesce(
        F.try_divide((1.0 + b2) * precision * recall, b2 * precision + recall), F.lit(0.0)
    )


def max_fbeta_of_roc(beta: float = 1.0) -> Column:
    """Score with the largest F-beta, the lowest such score on a tie."""
    return F.max_by(F.col("score"), F.struct(_f_beta(beta), -F.col("score")))


def youden_threshold_of_roc() -> Column:
    """Score with the largest J; 0.5 when no score beats the origin."""
    j = F.col("tpr") - F.col("fpr")
    best = F.max_by(F.col("score"), F.struct(j, F.col("score")))
    return F.when(C.both_classes() & (F.max(j) > 0), best).otherwise(F.lit(DEFAULT_THRESHOLD))


def specificity_threshold_of_roc(target: float) -> Column:
    """Score with the best TPR among kept points that reach the specificity."""
    ok = F.col("kept") & (F.lit(1.0) - F.col("fpr") >= target) & (F.col("tp") > 0)
    best = F.max_by(
        F.when(ok, F.col("score")), F.when(ok, F.struct(F.col("tp"), F.col("score")))
    )
    above = F.max("score") + ABOVE_MAX
    return F.when(C.both_classes(), F.coalesce(best, above)).otherwise(above)


def precision_threshold_of_roc(target: float) -> Column:
    """Largest score with enough precision, else the F1 threshold."""
    fallback = max_fbeta_of_roc(1.0)
    if not 0 < target <= 1:
        return fallback
    return F.coalesce(F.max(F.when(F.col("precision") >= target, F.col("score"))), fallback)


def controls_quantile_of_roc(target: float) -> Column:
    """Smallest control score whose rank reaches ceil(q (n − 1)) + 1."""
    rank = F.ceil(F.lit(float(target)) * (F.col("n_neg") - 1)) + 1
    found = F.min(F.when((F.col("neg") > 0) & (F.col("cum_neg") >= rank), F.col("score")))
    return F.coalesce(found, F.lit(DEFAULT_THRESHOLD))


def objective_of_roc(
    objective: str | None, fbeta: float = 1.0, fixed_spec: float = 0.9, fixed_ppv: float = 0.5
) -> tuple[str, Column]:
    """Name and aggregate of a threshold objective; None is youden, unknown max_f1."""
    name = (objective or "youden").strip().lower()
    if name == "max_fbeta":
        return name, max_fbeta_of_roc(fbeta)
    if name == "youden":
        return name, youden_threshold_of_roc()
    if name == "fixed_spec":
        return name, specificity_threshold_of_roc(fixed_spec)
    if name == "fixed_ppv":
        return name, precision_threshold_of_roc(fixed_ppv)
    return "max_f1", max_fbeta_of_roc(1.0)


def choose_threshold(
    df: DataFrame,
    group_cols: Sequence[str],
    objective: str | None = None,
    fbeta: float = 1.0,
    fixed_spec: float = 0.9,
    fixed_ppv: float = 0.5,
    **cols,
) -> DataFrame:
    """One threshold per group for the objective."""
    name, value = objective_of_roc(objective, fbeta, fixed_spec, fixed_ppv)
    roc = C.roc_table(df, group_cols, **cols)
    return roc.groupBy(*group_cols).agg(F.lit(name).alias("objective"), value.alias("threshold"))


def threshold_from_controls(
    df: DataFrame, group_cols: Sequence[str], target_spec: float, **cols
) -> DataFrame:
    roc = C.roc_table(df, group_cols, **cols)
    return roc.groupBy(*group_cols).agg(controls_quantile_of_roc(target_spec).alias("threshold"))


def confusion_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Rates of a confusion table; a missing class gives NULL specificity."""
    specificity = safe_div(tn, tn + fp)
    return {
        "precision": ratio_or_zero(tp, tp + fp),
        "sensitivity": ratio_or_zero(tp, tp + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "specificity": specificity,
        "fpr": F.lit(1.0) - specificity,
    }


def metrics_at_thresholds(
    roc: DataFrame, thresholds: DataFrame, group_cols: Sequence[str]
) -> DataFrame:
    """Confusion counts and rates at given thresholds.

    ``thresholds`` has the group columns, ``threshold`` and any naming columns;
    a group has few of them. They are joined to the group's score-level rows,
    which hold everything needed, so people are not read again.
    """
    groups = list(group_cols)
    names = [c for c in thresholds.columns if c not in groups and c != "threshold"]
    counts = roc.select(*groups, "score", "pos", "neg")
    hit = F.col("score") >= F.col("threshold")
    joined = join_on_keys(counts, thresholds, groups)
    table = joined.groupBy(*groups, *names, "threshold").agg(
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~hit, F.col("neg"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(~hit, F.col("pos"))), F.lit(0)).alias("fn"),
    )
    return table.withColumns(
        confusion_columns(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    )


def metrics_at_threshold(
    df: DataFrame,
    group_cols: Sequence[str],
    threshold: float,
    y_col: str = "y_true",
    p_col: str = "y_prob",
) -> DataFrame:
    """Confusion counts and rates at one fixed threshold, in one aggregation."""
    y, hit = F.col(y_col) == 1, F.col(p_col) >= threshold
    table = df.groupBy(*group_cols).agg(
        F.lit(float(threshold)).alias("threshold"),
        F.count_if(hit & y).alias("tp"),
        F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & ~y).alias("tn"),
        F.count_if(~hit & y).alias("fn"),
    )
    return table.withColumns(
        confusion_columns(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    )


def multi_target_specificity(
    df: DataFrame, group_cols: Sequence[str], spec_targets: Sequence[float], **cols
) -> DataFrame:
    """Threshold, sensitivity, precision and specificity per specificity target."""
    roc = C.roc_table(df, group_cols, **cols)
    return multi_target_from_roc(roc, group_cols, spec_targets)


def multi_target_from_roc(
    roc: DataFrame, group_cols: Sequence[str], spec_targets: Sequence[float]
) -> DataFrame:
    two_class = roc.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    entries = [
        F.struct(
            F.lit(float(t)).alias("target_spec"), specificity_threshold_of_roc(t).alias("threshold")
        )
        for t in sorted(spec_targets)
    ]
    picked = two_class.groupBy(*group_cols).agg(F.array(*entries).alias("e"))
    thresholds = picked.select(*group_cols, F.inline("e"))
    return metrics_at_thresholds(two_class, thresholds, group_cols).select(
        *group_cols, "target_spec", "threshold", "sensitivity", "precision", "specificity"
    )


def threshold_bundle(
    df: DataFrame,
    group_cols: Sequence[str],
    target_spec: float = 0.95,
    dca_thresholds: DataFrame | None = None,
    **cols,
) -> DataFrame:
    """Youden, specificity-target and (if given) decision-curve thresholds as rows."""
    roc = C.roc_table(df, group_cols, **cols)
    return bundle_from_roc(roc, group_cols, target_spec, dca_thresholds)


def bundle_from_roc(
    roc: DataFrame,
    group_cols: Sequence[str],
    target_spec: float = 0.95,
    dca_thresholds: DataFrame | None = None,
) -> DataFrame:
    groups = list(group_cols)
    named = [
        ("youden", youden_threshold_of_roc()),
        ("spec_target", specificity_threshold_of_roc(target_spec)),
    ]
    entries = [F.struct(F.lit(n).alias("kind"), v.alias("threshold")) for n, v in named]
    thresholds = (
        roc.groupBy(*groups).agg(F.array(*entries).alias("e")).select(*groups, F.inline("e"))
    )
    if dca_thresholds is not None:
        thresholds = thresholds.unionByName(
            dca_thresholds.where(F.col("threshold").isNotNull()).select(
                *groups, F.lit("dca").alias("kind"), "threshold"
            )
        )
    return metrics_at_thresholds(roc, thresholds, groups)


def top_risk_capture(
    df: DataFrame,
    group_cols: Sequence[str],
    fractions: Sequence[float] = (0.01,),
    id_col: str = "id",
    y_col: str = "y_true",
    p_col: str = "y_prob",
) -> DataFrame:
    """Share of the cases among the ceil(frac · n) highest scores.

    Ties at the cut are taken in ascending id. Only the rows that share the
    score at a cut are ranked by id, through the same celled running totals.
    """
    groups = list(group_cols)
    roc = C.roc_table(df, groups, y_col, p_col)
    n = F.col("n_pos") + F.col("n_neg")
    cuts = roc.groupBy(*groups).agg(
        F.max(n).alias("n"), F.max("n_pos").alias("n_pos")
    ).select(
        *groups,
        "n",
        "n_pos",
        F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("frac"),
    )
    cuts = cuts.withColumn(
        "n_top", F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("frac") * F.col("n"))))
    )
    keys = [*groups, "frac"]
    rows = roc.select(
        *groups, "score", "pos", (F.col("pos") + F.col("neg")).alias("__n"),
        (F.col("tp") + F.col("fp")).alias("__through"),
    )
    placed = join_on_keys(rows, cuts, groups)
    # Scores wholly inside the cut, and the one score the cut runs through.
    at_cut = (F.col("__through") >= F.col("n_top")) & (
        F.col("__through") - F.col("__n") < F.col("n_top")
    )
    summary = placed.groupBy(*keys, "n_top", F.col("n_pos").alias("__cases")).agg(
        F.coalesce(
            F.sum(F.when(F.col("__through") < F.col("n_top"), F.col("pos"))), F.lit(0)
        ).alias("__above"),
        F.max(F.when(at_cut, F.col("score"))).alias("__cut"),
        F.max(
            F.when(at_cut, F.col("n_top") - (F.col("__through") - F.col("__n")))
        ).alias("__take"),
    )
    at_score = df.where(finite(F.col(p_col)) & F.col(y_col).isNotNull()).select(
        *groups, F.col(id_col).alias("__id"), F.col(y_col).alias("__y"), F.col(p_col).alias("__p")
    )
    cut_rows = join_on_keys(
        at_score,
        summary.select(*keys, F.col("__cut").alias("__p"), "__take"),
        [*groups, "__p"],
    )
    celled, order = with_id_cells(cut_rows, keys, "__id")
    ranked = running_totals(
        celled.withColumn("__one", F.lit(1).cast("bigint")), keys, order, ["__one"]
    )
    tied = ranked.groupBy(*keys).agg(
        F.sum(
            F.when((F.col("cum___one") <= F.col("__take")) & (F.col("__y") == 1), 1).otherwise(0)
        ).alias("__tied")
    )
    cases = F.col("__above") + F.coalesce(F.col("__tied"), F.lit(0))
    return join_on_keys(summary, tied, keys, "left").select(
        *keys,
        "n_top",
        cases.alias("cases_in_top"),
        (F.col("n_top") - cases).alias("controls_in_top"),
        safe_div(cases, F.col("__cases")).alias("case_capture"),
    )
