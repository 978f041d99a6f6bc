"""Feature statistics and screening on a melted frame (…, y, feature, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsWritable,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.joins import join_on_keys
from riskloom.functions.ordered import exact_quantiles, running_totals, with_value_cells
from riskloom.functions.prob import safe_div
from riskloom.functions.tails import f_p, normal_p, t_p


def rank_statistics(
    melted: DataFrame,
    group_cols: Sequence[str] = ("feature",),
    y_col: str = "y",
    value_col: str = "value",
) -> DataFrame:
    """Sums behind the Mann–Whitney test and the AUC of every feature.

    Values are counted per (feature, value, class) first. ``u`` counts pairs in
    which the case is larger, ties half; ``tie_term`` is Σ(t³ − t).
    """
    groups = list(group_cols)
    y, x = F.col(y_col), F.col(value_col)
    counts = (
        melted.where(x.isNotNull() & y.isNotNull())
        .groupBy(*groups, x.alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    )
    cum = running_totals(
        with_value_cells(counts, groups, "score"), groups, ["score"], ["pos", "neg"]
    )
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    t = pos + neg
    return cum.groupBy(*groups).agg(
        F.max("total_pos").alias("n1"),
        F.max("total_neg").alias("n0"),
        F.sum(pos * (F.col("cum_neg") - neg / 2)).alias("u"),
        F.sum(t * t * t - t).alias("tie_term"),
        safe_div(F.sum(pos * F.col("score")), F.max("total_pos")).alias("mean1"),
        safe_div(F.sum(neg * F.col("score")), F.max("total_neg")).alias("mean0"),
    )


def mann_whitney(
    melted: DataFrame,
    group_cols: Sequence[str] = ("feature",),
    min_per_group: int = 10,
    min_values: int | None = None,
    y_col: str = "y",
    value_col: str = "value",
) -> DataFrame:
    """Two-sided asymptotic U test with tie and continuity correction.

    Features with too few values in a class drop out. ``p_value`` is NULL where
    all values are equal.
    """
    groups = list(group_cols)
    stats = rank_statistics(melted, groups, y_col, value_col)
    sizes = melted.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rows"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    enough = (F.col("n1") >= min_per_group) & (F.col("n0") >= min_per_group)
    if min_values is not None:
        enough = enough & (F.col("n1") + F.col("n0") >= min_values)
    larger = F.greatest(F.col("u"), n1 * n0 - F.col("u"))
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1.0) - F.col("tie_term") / (n * (n - 1.0))))
    z = F.try_divide(larger - n1 * n0 / 2.0 - 0.5, sd)
    rows = join_on_keys(stats.where(enough), sizes, groups)
    rows = rows.select(
        *groups,
        "n1",
        "n0",
        "u",
        z.alias("z"),
        F.abs(F.col("mean1") - F.col("mean0")).alias("effect_size"),
        safe_div(F.col("n1") + F.col("n0"), F.col("__rows")).alias("nonmissing_frac"),
    )
    # The upper tail beyond the larger U, doubled and capped at one.
    two_sided = F.when(F.col("z") >= 0, normal_p(F.col("z"))).when(
        F.col("z") < 0, F.lit(1.0)
    )
    return rows.withColumn("p_value", two_sided)


def mann_whitney_screen(
    melted: DataFrame, top_n: int = 0, min_per_group: int = 10, **cols
) -> DataFrame:
    """Features by p ascending, then effect descending; the first ``top_n`` if positive."""
    ranked = mann_whitney(melted, ["feature"], min_per_group, **cols).orderBy(
        F.col("p_value").asc_nulls_last(), F.col("effect_size").desc(), "feature"
    )
    return ranked.limit(top_n) if top_n > 0 else ranked


def univariate_strength(melted: DataFrame, **cols) -> DataFrame:
    """p and absolute mean difference; needs 30 values and 5 per class."""
    return mann_whitney(melted, ["feature"], 5, 30, **cols).select(
        "feature", "p_value", "effect_size"
    )


def impute(
    melted: DataFrame,
    strategy: str = "median",
    group_cols: Sequence[str] = ("feature",),
    value_col: str = "value",
) -> DataFrame:
    """Fill missing values with the feature's exact median or its mean."""
    groups = list(group_cols)
    if strategy == "median":
        fill = exact_quantiles(melted, groups, value_col, [0.5]).withColumnRenamed("q_0", "__fill")
    elif strategy == "mean":
        fill = melted.groupBy(*groups).agg(F.avg(value_col).alias("__fill"))
    else:
        raise ValueError(f"unknown imputation strategy: {strategy}")
    return (
        join_on_keys(melted, fill, groups, "left")
        .withColumn(value_col, F.coalesce(F.col(value_col), F.col("__fill")))
        .drop("__fill")
    )


def class_moments(
    melted: DataFrame,
    group_cols: Sequence[str] = ("feature",),
    y_col: str = "y",
    value_col: str = "value",
) -> DataFrame:
    """Count, mean and centred sum of squares per class, one row per feature."""
    y, x = F.col(y_col), F.col(value_col)
    case, control = F.when(y == 1, x), F.when(y == 0, x)
    return melted.groupBy(*group_cols).agg(
        F.count(case).alias("n1"),
        F.count(control).alias("n0"),
        F.avg(case).alias("mean1"),
        F.avg(control).alias("mean0"),
        (F.var_pop(case) * F.count(case)).alias("ss1"),
        (F.var_pop(control) * F.count(control)).alias("ss0"),
    )


def f_scores(melted: DataFrame, group_cols: Sequence[str] = ("feature",), **cols) -> DataFrame:
    """One-way ANOVA F of two classes and its p-value; NULL unless both occur."""
    moments = class_moments(melted, group_cols, **cols)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    gap = F.col("mean1") - F.col("mean0")
    between = F.try_divide(n1 * n0, n1 + n0) * gap * gap
    within = F.try_divide(F.col("ss1") + F.col("ss0"), n1 + n0 - 2.0)
    rows = moments.select(
        *group_cols,
        "n1",
        "n0",
        F.when((n1 > 0) & (n0 > 0), F.try_divide(between, within)).alias("f_score"),
    )
    return rows.withColumn("p_value", f_p(F.col("f_score"), F.lit(1.0), n1 + n0 - 2.0))


def nonmissing(melted: DataFrame, group_cols: Sequence[str] = ("feature",)) -> DataFrame:
    return melted.groupBy(*group_cols).agg(
        (F.count("value") / F.count(F.lit(1))).alias("nonmissing_frac")
    )


def f_statistic_screen(melted: DataFrame, top_n: int = 0, strategy: str = "median") -> DataFrame:
    """Impute, then features by F descending; features without a finite F drop out."""
    scores = f_scores(impute(melted, strategy)).where(F.col("f_score").isNotNull())
    ranked = join_on_keys(scores, nonmissing(melted), ["feature"]).orderBy(
        F.col("f_score").desc(), "feature"
    )
    return ranked.limit(top_n) if top_n > 0 else ranked


def select_k_best(
    melted: DataFrame, k: int, strategy: str = "median", fallback_to_variance: bool = True
) -> DataFrame:
    """The ``k`` features with the largest F.

    Where no feature has an F (one class only), the largest variance decides.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    filled = impute(melted, strategy)
    scores = f_scores(filled).select("feature", F.col("f_score").alias("score"))
    best = scores.where(F.col("score").isNotNull())
    if fallback_to_variance and best.limit(1).first() is None:
        best = filled.groupBy("feature").agg(F.var_pop("value").alias("score"))
    return best.orderBy(F.col("score").desc_nulls_last(), "feature").limit(k)


def variance_missingness_filter(
    melted: DataFrame,
    min_nonmissing: float = 0.95,
    min_variance: float = 1e-6,
    strict: bool = False,
) -> DataFrame:
    """Report per feature: share present, population variance, and both verdicts.

    Variance is judged only where enough values are present. ``strict`` raises
    if a filter leaves no feature; otherwise the last non-empty stage is kept,
    which the caller sees from the flags.
    """
    base = melted.groupBy("feature").agg(
        (F.count("value") / F.count(F.lit(1))).alias("nonmissing_frac"),
        F.var_pop("value").alias("__var"),
    )
    passed = F.col("nonmissing_frac") >= min_nonmissing
    report = base.select(
        "feature",
        "nonmissing_frac",
        passed.alias("passed_nonmissing"),
        F.when(passed, F.col("__var")).alias("variance"),
        (passed & F.coalesce(F.col("__var") >= min_variance, F.lit(False))).alias(
            "passed_variance"
        ),
    )
    if strict:
        row = report.agg(
            F.count_if("passed_nonmissing").alias("a"), F.count_if("passed_variance").alias("b")
        ).first()
        if not row["a"] or not row["b"]:
            raise ValueError("no feature passed the missingness and variance filters")
    return report


def two_group_statistics(
    melted: DataFrame, group_cols: Sequence[str] = ("feature",), **cols
) -> DataFrame:
    """Counts, means, sample SDs, pooled SD, Cohen's d and Welch's t test."""
    m = class_moments(melted, group_cols, **cols)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    v1 = F.try_divide(F.col("ss1"), n1 - 1.0)
    v0 = F.try_divide(F.col("ss0"), n0 - 1.0)
    pooled = F.sqrt(F.try_divide(F.col("ss1") + F.col("ss0"), n1 + n0 - 2.0))
    gap = F.col("mean1") - F.col("mean0")
    a, b = F.try_divide(v1, n1), F.try_divide(v0, n0)
    welch_df = F.try_divide(
        (a + b) * (a + b), F.try_divide(a * a, n1 - 1.0) + F.try_divide(b * b, n0 - 1.0)
    )
    rows = m.select(
        *group_cols,
        "n1",
        "n0",
        "mean1",
        "mean0",
        F.sqrt(v1).alias("sd1"),
        F.sqrt(v0).alias("sd0"),
        pooled.alias("pooled_sd"),
        F.try_divide(gap, pooled).alias("cohens_d"),
        F.try_divide(gap, F.sqrt(a + b)).alias("t_stat"),
        welch_df.alias("t_df"),
    )
    return rows.withColumn("p_value", t_p(F.col("t_stat"), F.col("t_df")))


def univariate_auc(
    melted: DataFrame, top_k: int = 0, group_cols: Sequence[str] = ("feature",), **cols
) -> DataFrame:
    """AUC of each feature as a score, ranked by distance from 0.5."""
    stats = rank_statistics(melted, group_cols, **cols)
    auc = F.try_divide(F.col("u"), F.col("n1").cast("double") * F.col("n0"))
    rows = stats.select(*group_cols, auc.alias("auc")).withColumn(
        "strength", F.abs(F.col("auc") - 0.5)
    )
    ranked = rows.orderBy(F.col("strength").desc_nulls_last(), *group_cols)
    return ranked.limit(top_k) if top_k > 0 else ranked


def feature_bias(
    melted: DataFrame, target_col: str = "target", margin: float = 0.05
) -> DataFrame:
    """AUC of each feature for incident and for prevalent cases against controls.

    Controls join both comparisons. ``side`` says which case type the feature
    favours by more than ``margin``.
    """
    comparison = F.when(F.col(target_col) == "Incident", F.array(F.lit("incident")))
    comparison = comparison.when(F.col(target_col) == "Prevalent", F.array(F.lit("prevalent")))
    both = F.array(F.lit("incident"), F.lit("prevalent"))
    rows = melted.select(
        "feature",
        "value",
        (F.col(target_col) != "Controls").cast("int").alias("y"),
        F.explode(comparison.otherwise(both)).alias("case_type"),
    )
    auc = univariate_auc(rows, 0, ["feature", "case_type"])
    wide = auc.groupBy("feature").agg(
        F.max(F.when(F.col("case_type") == "incident", F.col("auc"))).alias("incident_auc"),
        F.max(F.when(F.col("case_type") == "prevalent", F.col("auc"))).alias("prevalent_auc"),
    )
    bias = F.col("incident_auc") - F.col("prevalent_auc")
    return wide.withColumn("bias", bias).withColumn(
        "side",
        F.when(F.col("bias") > margin, "incident")
        .when(F.col("bias") < -margin, "prevalent")
        .otherwise("balanced"),
    )


def feature_bias_summary(bias: DataFrame) -> DataFrame:
    """Number and share of features on each side, mean AUCs."""
    n = F.count(F.lit(1))
    return bias.agg(
        n.alias("n_features"),
        F.count_if(F.col("side") == "incident").alias("n_incident_biased"),
        F.count_if(F.col("side") == "prevalent").alias("n_prevalent_biased"),
        F.count_if(F.col("side") == "balanced").alias("n_balanced"),
        (100.0 * F.count_if(F.col("side") == "incident") / n).alias("pct_incident_biased"),
        (100.0 * F.count_if(F.col("side") == "prevalent") / n).alias("pct_prevalent_biased"),
        F.avg("incident_auc").alias("mean_incident_auc"),
        F.avg("prevalent_auc").alias("mean_prevalent_auc"),
        F.avg("bias").alias("mean_bias"),
    )


def screening_over_splits(screening: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    """Mean and sample SD of screening statistics per feature over splits."""
    aggs = []
    for c in value_cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    return screening.groupBy("feature").agg(F.count(F.lit(1)).alias("n_splits"), *aggs)


def screen(melted: DataFrame, method: str, top_n: int = 0, **kw) -> DataFrame:
    """Screening by name: ``mannwhitney`` or ``f_classif``."""
    if method == "mannwhitney":
        return mann_whitney_screen(melted, top_n, **kw)
    if method == "f_classif":
        return f_statistic_screen(melted, top_n, **kw)
    raise ValueError(f"unknown screening method: {method}")


class _ScreeningParams(Params):
    method = Param(Params._dummy(), "method", "screening method", TypeConverters.toString)
    topN = Param(Params._dummy(), "topN", "features to keep, 0 for all", TypeConverters.toInt)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label column", TypeConverters.toString)
    suffix = Param(Params._dummy(), "suffix", "suffix of feature columns", TypeConverters.toString)


class Screening(Estimator, _ScreeningParams, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline step: learn the features to keep from wide feature columns."""

    @keyword_only
    def __init__(self, *, method="mannwhitney", topN=0, labelCol="y", suffix="_resid"):
        super().__init__()
        self._setDefault(method="mannwhitney", topN=0, labelCol="y", suffix="_resid")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ScreeningModel:
        from riskloom.operators.prepare import melt_columns

        suffix = self.getOrDefault(self.suffix)
        names = [c for c in dataset.columns if c.endswith(suffix)]
        label = self.getOrDefault(self.labelCol)
        long = melt_columns(dataset.withColumn("y", F.col(label).cast("int")), names, ["y"])
        best = screen(long, self.getOrDefault(self.method), self.getOrDefault(self.topN))
        chosen = [r["feature"] for r in best.select("feature").collect()]
        return self._copyValues(ScreeningModel(selected=chosen))


class ScreeningModel(Model, _ScreeningParams, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the selected features and all columns that are not features."""

    selected = Param(
        Params._dummy(), "selected", "selected features", TypeConverters.toListString
    )

    @keyword_only
    def __init__(self, *, selected=None):
        super().__init__()
        self._setDefault(suffix="_resid")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        suffix, chosen = self.getOrDefault(self.suffix), self.getOrDefault(self.selected)
        keep = [c for c in dataset.columns if not c.endswith(suffix)]
        return dataset.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`") for c in chosen])
