"""Feature stability, frequency panels, rankings and cross-model consensus.

A selection log has one row per outer fold with an array of feature names.
Tables of features are small (thousands of rows) however large the cohort is,
so a rank over all features of a model fits one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.joins import join_on_keys
from riskloom.operators import corr
from riskloom.session import checkpointed

RANK_METHODS = ("geometric_mean", "borda", "median")


def parse_selections(log: DataFrame, json_col: str, out_col: str = "features") -> DataFrame:
    """Decode a JSON list of names; unreadable text is an empty list."""
    parsed = F.from_json(F.col(json_col), "array<string>")
    return log.withColumn(out_col, F.coalesce(parsed, F.array().cast("array<string>")))


def _rank(order: Sequence[Column], group_cols: Sequence[str] = ()) -> Column:
    keys = [F.col(c) for c in group_cols] or [F.lit(1)]
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order))


def selection_frequencies(
    log: DataFrame, group_cols: Sequence[str] = (), features_col: str = "features"
) -> DataFrame:
    """Share of log rows that name each feature; a row counts a feature once."""
    groups = list(group_cols)
    # NULL and empty lists still count as rows, hence the outer explode.
    named = log.select(*groups, F.explode_outer(F.array_distinct(features_col)).alias("feature"))
    counts = (
        named.where(F.col("feature").isNotNull())
        .groupBy(*groups, "feature")
        .agg(F.count(F.lit(1)).alias("__k"))
    )
    totals = log.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    return join_on_keys(counts, totals, groups).select(
        *groups, "feature", (F.col("__k") / F.col("__n")).alias("selection_freq")
    )


def rank_by_frequency(freq: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Add ``rank``: frequency descending, then name."""
    return freq.withColumn(
        "rank", _rank([F.col("selection_freq").desc(), F.col("feature")], group_cols)
    )


def frequency_panel(
    freq: DataFrame,
    rule: str = "topN",
    top_n: int = 100,
    freq_threshold: float = 0.75,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """The first ``top_n`` features, or those with enough frequency."""
    ranked = rank_by_frequency(freq, group_cols)
    if rule == "topN":
        if top_n <= 0:
            raise ValueError("top_n must be positive")
        return ranked.where(F.col("rank") <= top_n)
    if rule == "freq_ge_tau":
        if not 0 <= freq_threshold <= 1:
            raise ValueError("freq_threshold must lie in [0, 1]")
        return ranked.where(F.col("selection_freq") >= freq_threshold)
    raise ValueError(f"unknown panel rule: {rule}")


def stable_panel(
    log: DataFrame,
    n_repeats: int,
    threshold: float = 0.75,
    fallback_top_n: int = 20,
    group_cols: Sequence[str] = (),
    features_col: str = "features",
) -> DataFrame:
    """Share of repeats in which some fold chose the feature, and whether it is kept.

    Where nothing reaches the threshold, the ``fallback_top_n`` most frequent
    features are kept.
    """
    groups = list(group_cols)
    inside = log.where((F.col("repeat") >= 0) & (F.col("repeat") < n_repeats))
    per_repeat = inside.select(*groups, "repeat", F.explode(features_col).alias("feature"))
    freq = per_repeat.groupBy(*groups, "feature").agg(
        (F.count_distinct("repeat") / F.lit(n_repeats)).alias("selection_freq")
    )
    keys = [F.col(c) for c in groups] or [F.lit(1)]
    any_kept = F.max((F.col("selection_freq") >= threshold).cast("int")).over(W.partitionBy(*keys))
    ranked = rank_by_frequency(freq, groups).withColumn("__any", any_kept)
    kept = F.when(F.col("__any") == 1, F.col("selection_freq") >= threshold).otherwise(
        F.col("rank") <= fallback_top_n
    )
    return ranked.select(*groups, "feature", "selection_freq", kept.alias("kept"))


def stability_over_splits(
    log: DataFrame,
    group_cols: Sequence[str] = ("model",),
    split_col: str = "split_seed",
    features_col: str = "features",
) -> DataFrame:
    """Distinct splits that chose the feature over all splits of the group."""
    groups = list(group_cols)
    chosen = (
        log.select(*groups, split_col, F.explode(features_col).alias("feature"))
        .where(F.col("feature") != "")
        .groupBy(*groups, "feature")
        .agg(F.count_distinct(split_col).alias("n_splits_selected"))
    )
    totals = log.groupBy(*groups).agg(F.count_distinct(split_col).alias("__n"))
    return join_on_keys(chosen, totals, groups).select(
        *groups,
        "feature",
        "n_splits_selected",
        (F.col("n_splits_selected") / F.col("__n")).alias("selection_fraction"),
    )


def stable_features(stability: DataFrame, threshold: float = 0.75) -> DataFrame:
    return stability.where(F.col("selection_fraction") >= threshold)


def feature_report(freq: DataFrame, screening: DataFrame) -> DataFrame:
    """Frequencies with screening p and effect, ranked."""
    joined = freq.join(
        screening.select("feature", "p_value", "effect_size"), "feature", "left"
    )
    return rank_by_frequency(joined)


def aggregate_feature_reports(
    reports: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Mean, SD and range of report columns over splits, ranked by mean frequency."""
    aggs = [
        F.avg("selection_freq").alias("selection_freq_mean"),
        F.stddev_samp("selection_freq").alias("selection_freq_std"),
        F.min("selection_freq").alias("selection_freq_min"),
        F.max("selection_freq").alias("selection_freq_max"),
        F.count("selection_freq").alias("n_splits"),
    ]
    for c in ("effect_size", "p_value"):
        if c in reports.columns:
            aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    out = reports.groupBy(*group_cols, "feature").agg(*aggs)
    order = [F.col("selection_freq_mean").desc(), F.col("feature")]
    return out.withColumn("rank", _rank(order, group_cols))


def consensus_panels_by_size(
    panels: DataFrame,
    threshold: float = 0.75,
    group_cols: Sequence[str] = (),
    split_col: str = "split_seed",
) -> DataFrame:
    """Features in at least ceil(threshold × splits) of the split panels per size."""
    keys = [*group_cols, "panel_size"]
    totals = panels.groupBy(*keys).agg(F.count_distinct(split_col).alias("n_splits"))
    counts = panels.groupBy(*keys, "feature").agg(
        F.count_distinct(split_col).alias("n_splits_selected")
    )
    needed = F.ceil(F.lit(float(threshold)) * F.col("n_splits"))
    return (
        join_on_keys(counts, totals, keys)
        .withColumn("min_splits", needed)
        .where(F.col("n_splits_selected") >= F.col("min_splits"))
    )


def fold_consensus(
    log: DataFrame, threshold: float = 0.8, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Share of folds that chose each feature, with consensus flag and rank."""
    freq = selection_frequencies(log, group_cols)
    return rank_by_frequency(freq, group_cols).withColumn(
        "in_consensus", F.col("selection_freq") >= threshold
    )


def fold_summary(
    folds: DataFrame, group_cols: Sequence[str] = (), features_col: str = "features"
) -> DataFrame:
    """Mean and population SD of the chosen size and of the fold AUROC."""
    size = F.size(features_col)
    return folds.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg(size).alias("mean_optimal_size"),
        F.stddev_pop(size).alias("sd_optimal_size"),
        F.avg("val_auroc").alias("mean_val_auroc"),
        F.stddev_pop("val_auroc").alias("sd_val_auroc"),
    )


def per_model_ranking(
    stability: DataFrame,
    rfe_ranking: DataFrame | None = None,
    rfe_weight: float = 0.5,
) -> DataFrame:
    """Composite rank of every model's features from stability and elimination.

    Both ranks are scaled to (n − rank + 1) / n and mixed; a feature without an
    elimination order counts by stability alone. Ties go to the name.
    """
    by_model = W.partitionBy("model")
    rows = stability.select(
        "model", "feature", F.col("selection_fraction").alias("stability_freq")
    ).withColumn(
        "stability_rank", _rank([F.col("stability_freq").desc(), F.col("feature")], ["model"])
    )
    n = F.count(F.lit(1)).over(by_model)
    rows = rows.withColumn("__stab", (n - F.col("stability_rank") + 1) / n)
    if rfe_ranking is None:
        rows = rows.withColumn("__order", F.lit(None).cast("int")).withColumn(
            "__max", F.lit(None).cast("int")
        )
    else:
        limits = rfe_ranking.groupBy("model").agg(F.max("elimination_order").alias("__max"))
        orders = rfe_ranking.select("model", "feature", F.col("elimination_order").alias("__order"))
        rows = rows.join(orders, ["model", "feature"], "left").join(limits, "model", "left")
    importance = F.when(
        F.col("__order").isNotNull(), (F.col("__order") + 1) / (F.col("__max") + 1)
    )
    rows = rows.withColumn("rfe_importance", importance.cast("double"))
    present = F.col("rfe_importance").isNotNull()
    rank = _rank([F.col("rfe_importance").desc_nulls_last(), F.col("feature")], ["model"])
    rows = rows.withColumn("rfe_rank", F.when(present, rank)).withColumn(
        "__n_rfe", F.count("rfe_importance").over(by_model)
    )
    rfe = (F.col("__n_rfe") - F.col("rfe_rank") + 1) / F.nullif("__n_rfe", F.lit(0))
    composite = F.coalesce(
        F.lit(rfe_weight) * rfe + F.lit(1.0 - rfe_weight) * F.col("__stab"), F.col("__stab")
    )
    rows = rows.withColumn("composite_score", composite)
    return rows.select(
        "model",
        "feature",
        "stability_freq",
        "stability_rank",
        "rfe_importance",
        "rfe_rank",
        "composite_score",
        # Scores equal but for rounding are a tie, broken by name.
        _rank([F.round("composite_score", 12).desc(), F.col("feature")], ["model"]).alias(
            "final_rank"
        ),
    )


def aggregate_ranks(rankings: DataFrame, method: str = "geometric_mean") -> DataFrame:
    """Consensus score and rank of every feature over the models' final ranks.

    A model that lacks a feature contributes its largest rank plus one. The list
    of models is short and known after one small aggregation, so ranks become
    one column per model without pairing features with models.
    """
    if method not in RANK_METHODS:
        raise ValueError(f"unknown rank aggregation {method!r}, one of {RANK_METHODS}")
    models = [
        (r["model"], int(r["worst"]))
        for r in rankings.groupBy("model").agg(F.max("final_rank").alias("worst"))
        .orderBy("model").collect()
    ]
    if not models:
        raise ValueError("no rankings to aggregate")
    given = F.map_from_entries(F.collect_list(F.struct("model", "final_rank")))
    rows = rankings.groupBy("feature").agg(
        given.alias("__r"),
        F.count(F.lit(1)).alias("n_models_present"),
        F.avg("final_rank").alias("__mean"),
        F.coalesce(F.stddev_samp("final_rank"), F.lit(0.0)).alias("rank_std"),
    )
    ranks = [
        F.coalesce(F.col("__r")[m], F.lit(worst + 1)).cast("double") for m, worst in models
    ]
    total = lambda cols: sum(cols[1:], cols[0])
    k = float(len(models))
    if method == "geometric_mean":
        score = F.exp(-total([F.log(r) for r in ranks]) / k)
    elif method == "borda":
        score = total([F.lit(w + 2.0) - r for r, (_, w) in zip(ranks, models, strict=True)]) / k
    else:
        ordered = F.array_sort(F.array(*ranks))
        low, high = (len(models) - 1) // 2 + 1, len(models) // 2 + 1
        median = (F.element_at(ordered, low) + F.element_at(ordered, high)) / 2.0
        score = F.lit(max(w for _, w in models) + 1.0) - median
    named = [r.alias(f"{m}_rank") for r, (m, _) in zip(ranks, models, strict=True)]
    out = rows.select(
        "feature",
        score.alias("consensus_score"),
        "n_models_present",
        (F.col("n_models_present") / F.lit(k)).alias("agreement_strength"),
        "rank_std",
        F.try_divide("rank_std", "__mean").alias("rank_cv"),
        *named,
    )
    # Equal ranks in another order may differ in the last bit of the score.
    order = [F.round("consensus_score", 12).desc(), F.col("feature")]
    return out.withColumn("consensus_rank", _rank(order))


def consensus_panel(
    stability: DataFrame,
    pairs: DataFrame,
    rfe_ranking: DataFrame | None = None,
    stability_threshold: float = 0.75,
    corr_threshold: float = 0.85,
    target_size: int = 25,
    rfe_weight: float = 0.5,
    method: str = "geometric_mean",
) -> dict[str, DataFrame]:
    """Stable features per model → composite ranks → consensus → one per cluster.

    Clustering looks at the best 3 × target features. Returns ``panel``,
    ``ranking``, ``per_model`` and ``clusters``.
    """
    per_model = checkpointed(
        per_model_ranking(stable_features(stability, stability_threshold), rfe_ranking, rfe_weight)
    )
    if per_model.select("model").distinct().count() < 2:
        raise ValueError("consensus needs stable features from at least two models")
    ranking = checkpointed(aggregate_ranks(per_model, method))
    candidates = ranking.where(F.col("consensus_rank") <= 3 * target_size)
    clusters = corr.cluster_by_score(candidates, pairs, corr_threshold)
    kept = clusters.where("kept").select("feature", "consensus_score")
    order = [F.round("consensus_score", 12).desc(), F.col("feature")]
    panel = kept.withColumn("rank", _rank(order)).where(F.col("rank") <= target_size)
    return {"panel": panel, "ranking": ranking, "per_model": per_model, "clusters": clusters}


def panel_uncertainty(panel: DataFrame, ranking: DataFrame) -> DataFrame:
    """One-row summary of rank agreement over the panel."""
    rows = panel.select("feature").join(ranking, "feature")
    return rows.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.avg("rank_std").alias("rank_std_mean"),
        F.avg("rank_cv").alias("rank_cv_mean"),
        F.avg("agreement_strength").alias("agreement_mean"),
        F.min("agreement_strength").alias("agreement_min"),
        F.max("agreement_strength").alias("agreement_max"),
        F.count_if(F.col("agreement_strength") == 1.0).alias("n_full_agreement"),
    )


def coefficient_selection(
    coefficients: DataFrame, threshold: float = 0.0, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Features whose (mean over folds) coefficient exceeds a threshold in size."""
    mean = coefficients.groupBy(*group_cols, "feature").agg(F.avg("coefficient").alias("coefficient"))
    return mean.where(F.abs("coefficient") > threshold)


def importance_selection(
    drops: DataFrame, min_importance: float = 0.0, top_n: int | None = None, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Features by mean score drop over repeats, at least the minimum; the top n if given.

    Where none reaches the minimum, all are kept.
    """
    groups = list(group_cols)
    mean = drops.groupBy(*groups, "feature").agg(F.avg("drop").alias("importance"))
    keys = [F.col(c) for c in groups] or [F.lit(1)]
    enough = F.col("importance") >= min_importance
    any_enough = F.max(enough.cast("int")).over(W.partitionBy(*keys))
    flagged = mean.withColumn("__any", any_enough)
    rows = flagged.where((F.col("__any") == 0) | enough).drop("__any")
    ranked = rows.withColumn(
        "rank", _rank([F.col("importance").desc(), F.col("feature")], groups)
    )
    return ranked if top_n is None else ranked.where(F.col("rank") <= top_n)


def union_of_selections(*selections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct features that any of the selections names."""
    out = selections[0].select(*keys, "feature")
    for s in selections[1:]:
        out = out.unionByName(s.select(*keys, "feature"))
    return out.distinct()
