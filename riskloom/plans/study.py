"""Jobs: splits, training, ensemble, aggregation, panels, consensus, holdout.

Every job reads and writes tables of a ``Catalog``. A cohort has ``id``,
``target``, metadata and an array column of feature values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import corr, dca, panels, prepare as P, splits as S, summarize as L
from riskloom.operators import stacking, thresholds as T, train as M
from riskloom.operators.calibrate import (
    adjust_for_prevalence,
    apply_base_calibration,
    calibration_band,
    calibration_curve,
)
from riskloom.operators.covariates import Covariates, fit_covariates, with_covariates
from riskloom.operators.discrimination import curve_band, cv_repeat_metrics
from riskloom.operators.resample import test_set_intervals
from riskloom.operators.screen import mann_whitney, screening_over_splits
from riskloom.plans.evaluate import evaluate_predictions, evaluate_validation_then_test
from riskloom.session import checkpointed, ensure_checkpoint_dir, in_order
from riskloom.sources.catalog import Catalog


#: Setting of stored splits that names the numbers whose absence removed rows.
NUMBERS = "numeric_metadata"
#: Tables that are computed side by side: each is a chain of small jobs.
TABLES_AT_ONCE = 6


@dataclass(frozen=True)
class StudyConfig:
    """Settings of a study; the defaults are those of the command line it replaces."""

    scenario: str = "IncidentOnly"
    models: tuple[str, ...] = ("LR_EN", "RF", "LinSVM_cal", "XGBoost")
    seeds: tuple[int, ...] = (0,)
    val_size: float = 0.25
    test_size: float = 0.25
    holdout_size: float = 0.0
    temporal_col: str | None = None
    prevalent_train_only: bool = False
    prevalent_fraction: float = 1.0
    train_controls_per_case: float | None = None
    eval_controls_per_case: float | None = None
    folds: int = 5
    repeats: int = 3
    inner_folds: int = 3
    params: Mapping[str, Mapping] = field(default_factory=dict)
    choices: Mapping[str, Sequence[Mapping]] = field(default_factory=dict)
    strategy: M.FeatureStrategy = field(default_factory=M.FeatureStrategy)
    calibration: str = "oof_posthoc"
    calibration_method: str = "isotonic"
    objective: str = "fixed_spec"
    target_specificity: float = 0.95
    target_prevalence: float | None = None
    stability_threshold: float = 0.75
    corr_threshold: float = 0.85
    panel_size: int = 25
    panel_sizes: tuple[int, ...] = (10, 25, 50)
    min_panel: int = 5
    row_filters: bool = True
    numeric_metadata: tuple[str, ...] = ()
    categorical_metadata: tuple[str, ...] = ()
    learning_points: int = 0
    #: Models, seeds and scenarios that run at a time; see the README before raising it.
    branches: int = 1
    n_boot: int = 1000


def side_by_side(spark: SparkSession, jobs: Mapping[str, Callable[[], object]], at_once: int) -> dict:
    """Results of independent jobs by name, ``at_once`` of them running at a time.

    Each job runs in a scheduler pool of its own name: with ``spark.scheduler.mode``
    FAIR, small fits do not wait for the tasks of large ones. A failed job leaves the
    others running; when all have ended, the failures are raised together.
    """
    def branch(name: str, job: Callable[[], object]) -> object:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    results, failed = {}, []
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        # Each call copies the properties: one copy for all would share the pool.
        running = {n: pool.submit(inheritable_thread_target(spark)(branch), n, j) for n, j in jobs.items()}
        for name, future in running.items():
            try:
                results[name] = future.result()
            except Exception as error:
                error.add_note(f"in {name}")
                failed.append(error)
    if failed:
        raise ExceptionGroup(f"{len(failed)} of {len(jobs)} jobs failed", failed)
    return results


def make_scenario_splits(
    cohort: DataFrame, catalog: Catalog, config: StudyConfig, scenarios: Sequence[str], overwrite: bool = False
) -> dict[str, DataFrame]:
    """``make_splits`` of several scenarios in one call, by scenario."""
    ensure_checkpoint_dir(catalog.spark)
    return side_by_side(
        catalog.spark,
        {s: lambda s=s: make_splits(cohort, catalog, replace(config, scenario=s), overwrite) for s in scenarios},
        config.branches,
    )


def make_splits(cohort: DataFrame, catalog: Catalog, config: StudyConfig, overwrite: bool = False) -> DataFrame:
    """Holdout and repeated splits of one scenario, written with their metadata."""
    rows = P.scenario_rows(cohort, config.scenario, "target")
    positives = P.scenario_positives(config.scenario)
    names = {"target_col": "target"}
    extra = {
        "scheme": "", "temporal": str(config.temporal_col), NUMBERS: ",".join(config.numeric_metadata),
    }
    if config.row_filters:
        # What is filtered here is in no split, so no later job sees it.
        known = {
            "drop_uncertain_controls": P.EVENT_DATE in rows.columns,
            "target_col": "target",
            "numeric": config.numeric_metadata or None,
        }
        extra |= P.filter_audit(rows, **known).first().asDict()
        rows = P.filter_rows(rows, **known)
    if config.temporal_col:
        ends = rows.agg(F.min(config.temporal_col), F.max(config.temporal_col)).first()
        extra |= {"temporal_start": ends[0], "temporal_end": ends[1]}
    if config.holdout_size > 0:
        parts = checkpointed(
            S.carve_holdout(rows, config.holdout_size, config.temporal_col, **names)
        )
        held = parts.where(F.col("part") == S.HOLDOUT)
        if catalog.save_holdout(held, config.scenario, overwrite):
            held = P.with_outcome(held.drop("y"), positives, "target")
            held = held.withColumn("split", F.lit(S.HOLDOUT))
            catalog.save_holdout_metadata(
                S.summarize_splits(held, ["split"]), config.scenario, extra
            )
        rows = parts.where(F.col("part") == "dev").drop("part")
    table, scheme = S.repeated_splits(
        rows,
        positives,
        config.seeds,
        config.val_size,
        config.test_size,
        config.prevalent_train_only,
        config.prevalent_fraction,
        config.train_controls_per_case,
        config.eval_controls_per_case,
        config.temporal_col,
        **names,
    )
    table = checkpointed(table.withColumn("scenario", F.lit(config.scenario)))
    S.validate_splits(table, rows)
    S.require_both_classes(table, "y")
    if catalog.save_splits(table, overwrite):
        extra["scheme"] = scheme
        summary = S.summarize_splits(table, ["split_seed", "split"])
        catalog.save_split_metadata(summary, config.scenario, extra)
    return table


def _rows(cohort: DataFrame, splits: DataFrame, seed: int, split: str) -> DataFrame:
    ids = splits.where((F.col("split_seed") == seed) & (F.col("split") == split)).select("id", "y")
    return cohort.drop("y").join(ids, "id")


def _assembled(
    cohort: DataFrame, splits: DataFrame, seed: int, split: str, feature_col: str, covariates: Covariates
) -> DataFrame:
    rows = with_covariates(_rows(cohort, splits, seed, split), covariates, feature_col)
    weights = "balanced" if split == S.TRAIN else None
    return M.vectors(rows, feature_col, ["id", "y", "target"], weights)


def _covariates(cohort: DataFrame, splits: DataFrame, seed: int, config: StudyConfig) -> Covariates:
    """Metadata of a seed's TRAIN rows, as every model of that seed uses it."""
    train = _rows(cohort, splits, seed, S.TRAIN)
    return fit_covariates(train, config.numeric_metadata, config.categorical_metadata)


def _same_numbers(catalog: Catalog, config: StudyConfig) -> None:
    """Splits were filtered by the numbers that the models use, or it is an error."""
    stored = catalog.load_split_metadata(config.scenario)
    used = None if stored is None else stored.select(F.col("settings")[NUMBERS]).first()[0]
    if used is not None and set(filter(None, used.split(","))) != set(config.numeric_metadata):
        raise ValueError(f"splits were filtered by numbers [{used}], models use {list(config.numeric_metadata)}")


def train_model(
    cohort: DataFrame,
    splits: DataFrame,
    names: Sequence[str],
    catalog: Catalog,
    config: StudyConfig,
    model: str,
    seed: int,
    feature_col: str = "features_array",
) -> DataFrame:
    """Nested cross-validation, final fit, threshold on VAL, scores of VAL and TEST.

    The configured metadata stand behind the features in every model: they pass the
    screen and fixed panels, compete for the k best, and enter no selection log or panel.
    """
    key = {"scenario": F.lit(config.scenario), "model": F.lit(model), "split_seed": F.lit(seed)}
    keys = ["scenario", "model", "split_seed"]
    _same_numbers(catalog, config)
    covariates = _covariates(cohort, splits, seed, config)
    columns = [*names, *covariates.names]
    strategy = replace(config.strategy, covariates=tuple(covariates.names))
    frame = checkpointed(_assembled(cohort, splits, seed, S.TRAIN, feature_col, covariates))
    nested = M.nested_cv(
        frame,
        columns,
        model,
        config.folds,
        config.repeats,
        config.inner_folds,
        config.choices.get(model),
        strategy,
        config.calibration,
        config.calibration_method,
        seed=seed,
    )
    if covariates.names:
        measured = F.array_except("features", F.lit(covariates.names))
        nested.selection_log = nested.selection_log.withColumn("features", measured)
    catalog.write("selection_log", nested.selection_log.drop("model").withColumns(key), keys)
    catalog.write("param_log", nested.param_log.drop("model").withColumns(key), keys)
    if nested.coefficients is not None:
        catalog.write("coefficient_log", nested.coefficients.drop("model").withColumns(key), keys)
    category = frame.select("id", F.col("target").alias("category"))
    catalog.write("oof", nested.oof.join(category, "id").withColumns(key), keys)
    catalog.append_cv_metrics(cv_repeat_metrics(nested.oof.withColumns(key), keys))

    chosen = M.fold_features(frame, columns, model, strategy, seed)
    position = {n: i for i, n in enumerate(columns)}
    params = config.params.get(model, {})
    if config.choices.get(model):
        params, _, _ = M.search(
            frame, model, config.choices[model], config.inner_folds, seed=seed,
            indices=[position[n] for n in chosen],
        )
    if params.get("k"):
        chosen = M.fold_features(frame, chosen, model, M.FeatureStrategy(k_best=params["k"]), seed, columns)
    weighted = frame
    if "class_weight" in params:
        weighted = M.with_class_weights(frame, params["class_weight"])
    fitted = M.fit_model(weighted, model, params, [position[n] for n in chosen], seed=seed)
    prevalence = frame.agg(F.avg("y")).first()[0]
    target_prevalence = config.target_prevalence or prevalence
    scored = None
    for split in (S.VAL, S.TEST):
        rows = _assembled(cohort, splits, seed, split, feature_col, covariates)
        part = M.predict(fitted, rows, ["id", "y", "target"])
        if nested.calibrator is not None:
            part = nested.calibrator.transform(part)
        part = part.withColumnRenamed("target", "category").withColumn("split", F.lit(split))
        scored = part if scored is None else scored.unionByName(part)
    scored = adjust_for_prevalence(scored, prevalence, target_prevalence)
    scored = checkpointed(
        scored.withColumns({**key, "calibrated": F.lit(nested.calibrator is not None)})
    )
    catalog.save_predictions(scored)
    # Thresholds and metrics are on the scale that the holdout is scored on.
    active = scored.withColumn("y_prob", F.col("y_prob_adjusted"))
    aim = {"fixed_spec": config.target_specificity}
    metrics = evaluate_validation_then_test(active, config.objective, **aim).withColumn(
        "scenario", F.lit(config.scenario)
    )
    catalog.write("metrics", metrics, keys)
    on_val = active.where(F.col("split") == S.VAL)
    threshold = T.choose_threshold(on_val, [], config.objective, **aim).first()["threshold"]
    catalog.save_model(
        fitted,
        config.scenario,
        model,
        seed,
        {
            "threshold": threshold,
            "objective": config.objective,
            "train_prevalence": prevalence,
            "target_prevalence": target_prevalence,
            "n_features": len(chosen),
            "features": ",".join(chosen),
            "covariates": covariates.to_json(),
        },
        nested.calibrator,
    )
    extra_tables(frame, names, nested, scored, catalog, config, model, seed)
    if config.learning_points:
        own = M.VectorSlicer(inputCol="features", outputCol="own", indices=[position[n] for n in chosen])
        rows = own.transform(frame).drop("features").withColumnRenamed("own", "features")
        curve = M.learning_curve(rows, model, params, config.folds, n_points=config.learning_points, seed=seed)
        catalog.write("learning_curve", curve.withColumns(key), keys)
    return scored


def extra_tables(frame, names, nested, scored, catalog, config, model, seed) -> None:
    """Feature report, panels, calibration and decision curves, test intervals."""
    from pyspark.ml.functions import vector_to_array

    key = {"scenario": F.lit(config.scenario), "model": F.lit(model), "split_seed": F.lit(seed)}
    keys = ["scenario", "model", "split_seed"]
    measured = F.slice(vector_to_array("features"), 1, len(names))  # without the metadata
    values = frame.select("id", "y", measured.alias("a"))
    long = P.melt_array(values, "a", ["id", "y"], names=names)

    def features() -> None:
        screening = checkpointed(mann_whitney(long))
        catalog.write("screening", screening.withColumns(key), keys)
        freq = checkpointed(panels.selection_frequencies(nested.selection_log))
        catalog.write("feature_reports", panels.feature_report(freq, screening).withColumns(key), keys)
        sizes = F.explode(F.array(*[F.lit(s) for s in config.panel_sizes]))
        by_size = panels.rank_by_frequency(freq).withColumn("panel_size", sizes)
        by_size = by_size.where(F.col("rank") <= F.col("panel_size"))
        catalog.write("panels", by_size.withColumns(key), keys)

    def stable() -> None:
        kept = panels.stable_panel(nested.selection_log, config.repeats, config.stability_threshold)
        catalog.write("stable_panel", kept.withColumns(key), keys)

    def curves() -> None:
        catalog.write("calibration", calibration_curve(scored, [*keys, "split"]), keys)
        catalog.write("decision_curve", dca.decision_curve(scored, [*keys, "split"]), keys)

    def intervals() -> None:
        test = scored.where(F.col("split") == S.TEST)
        found = test_set_intervals(test, keys, n_boot=config.n_boot, seed=seed)
        catalog.write("test_intervals", found, keys)

    in_order(catalog.spark, [features, stable, curves, intervals], TABLES_AT_ONCE)


def train_ensemble(catalog: Catalog, config: StudyConfig, seed: int) -> DataFrame:
    """Stack the base models of one seed and score VAL and TEST."""
    models = [m for m in config.models]
    where = {"scenario": config.scenario, "split_seed": seed}
    oof = catalog.read("oof", **where)
    rows = catalog.predictions(**where).where(F.col("model").isin(models))
    category = rows.select("id", "split", "category").distinct()
    # Out-of-fold scores are raw and get the map here; written scores have it.
    calibrators = {}
    for m in models:
        _, calibrator, _ = catalog.load_model(config.scenario, m, seed)
        if calibrator is not None:
            calibrators[m] = calibrator
    adjusted = apply_base_calibration(oof, calibrators) if calibrators else oof
    stacker, scored = stacking.stack_from_run(adjusted, rows, models, seed=seed)
    out = scored.join(category, ["id", "split"]).withColumns(
        {
            "scenario": F.lit(config.scenario),
            "split_seed": F.lit(seed),
            "calibrated": F.lit(stacker.calibrator is not None),
        }
    )
    # The seed's models share TRAIN; the ensemble is judged on their scale.
    _, _, settings = catalog.load_model(config.scenario, models[0], seed)
    out = adjust_for_prevalence(
        out, float(settings["train_prevalence"]), float(settings["target_prevalence"])
    )
    out = checkpointed(out)
    catalog.save_predictions(out)
    metrics = evaluate_validation_then_test(
        out.withColumn("y_prob", F.col("y_prob_adjusted")), config.objective, fixed_spec=config.target_specificity
    )
    keys = ["scenario", "model", "split_seed"]
    catalog.write("metrics", metrics.withColumn("scenario", F.lit(config.scenario)), keys)
    coefficients = stacker.coefficients(catalog.spark).withColumns(
        {"scenario": F.lit(config.scenario), "split_seed": F.lit(seed)}
    )
    catalog.write("ensemble_coefficients", coefficients, ["scenario", "split_seed"])
    catalog.save_model(
        stacker.pipeline,
        config.scenario,
        L.ENSEMBLE,
        seed,
        {"base_models": ",".join(models), "penalty": "l2", "C": 1.0},
        stacker.calibrator,
    )
    return out


def aggregate_splits(catalog: Catalog, config: StudyConfig) -> dict[str, DataFrame]:
    """Tables over all splits and models of a scenario, grouped by model.

    All scores are those after the adjustment to the target prevalence, as in the
    metrics of the single splits.
    """
    where = {"scenario": config.scenario}
    predictions = catalog.predictions(**where).withColumn("y_prob", F.col("y_prob_adjusted"))
    test = predictions.where(F.col("split") == S.TEST)
    val = predictions.where(F.col("split") == S.VAL)
    log = catalog.read("selection_log", **where)
    metrics = catalog.metrics(**where).where(F.col("split") == S.TEST)
    pooled_test, pooled_val, bundles, stability, reports, slopes = in_order(
        catalog.spark,
        [
            lambda: checkpointed(L.pooled_metrics(test)),
            lambda: checkpointed(L.pooled_metrics(val)),
            lambda: checkpointed(L.pooled_thresholds(test, target_spec=config.target_specificity)),
            lambda: checkpointed(panels.stability_over_splits(log)),
            lambda: checkpointed(panels.aggregate_feature_reports(catalog.feature_reports(**where), ["model"])),
            lambda: evaluate_predictions(test, ["model"]).select("model", "calib_slope", "ece"),
        ],
        TABLES_AT_ONCE,
    )
    out = {
        "pooled_test": pooled_test,
        "pooled_val": pooled_val,
        "specificity": L.pooled_specificity_metrics(test, [0.90, 0.95, 0.99]),
        "thresholds": bundles,
        "selection_scores": L.rank_models(pooled_test.join(slopes, "model")),
        "summary": L.summary_stats(metrics, ["auroc", "prauc", "brier", "calib_slope"]),
        "comparison": L.model_comparison(pooled_test, pooled_val, bundles),
        "stability": stability,
        "feature_reports_pooled": reports,
        "parameters": L.summarize_parameters(catalog.best_parameters(**where)),
        "consensus_by_size": panels.consensus_panels_by_size(
            catalog.read("panels", **where), config.stability_threshold, ["model"]
        ),
        "categories": P.category_counts(predictions, ["split"]),
        "calibration_pooled": calibration_curve(test, ["model"]),
        "decision_curve_pooled": dca.decision_curve(test, ["model"]),
        "metadata": L.aggregation_metadata(
            panels.stability_over_splits(log, []),
            panels.aggregate_feature_reports(catalog.feature_reports(**where)),
            predictions,
        ),
    }
    screening = catalog.read("screening", **where).dropDuplicates(["split_seed", "feature"])
    out |= {
        "roc_band": curve_band(test, ["model"], "split_seed", "roc"),
        "pr_band": curve_band(test, ["model"], "split_seed", "pr"),
        "calibration_band": calibration_band(test, ["model"], "split_seed"),
        "decision_curve_band": dca.decision_curve_band(test, ["model"], "split_seed"),
        "screening": screening_over_splits(screening, ["p_value", "effect_size", "nonmissing_frac"]),
    }
    for name, table in L.risk_distribution(test, ["model"], target_spec=config.target_specificity).items():
        out[f"risk_{name}"] = table
    repeats = L.oof_tables(catalog.read("oof", **where), ["model", "split_seed"], config.target_specificity)
    for name, table in repeats.items():
        out[f"oof_{name}"] = table
    if catalog.has("learning_curve"):
        out["learning_curve"] = L.combine_learning_curves(
            catalog.read("learning_curve", **where), ["model"], "split_seed"
        )
    if catalog.has("ensemble_coefficients"):
        coefficients = catalog.read("ensemble_coefficients", **where)
        out["ensemble_metadata"] = L.ensemble_metadata(coefficients, pooled_test)

    def store(name: str) -> None:
        keyed = out[name].withColumn("scenario", F.lit(config.scenario))
        if name == "stability":
            catalog.write(name, keyed, ["scenario", "model"])
        else:
            catalog.write(f"aggregated_{name}", keyed, ["scenario"])

    in_order(catalog.spark, [partial(store, name) for name in out], TABLES_AT_ONCE)
    return out


def optimize_panel(
    cohort: DataFrame,
    splits: DataFrame,
    names: Sequence[str],
    catalog: Catalog,
    config: StudyConfig,
    model: str,
    seed: int,
    from_aggregated: bool = False,
    start_size: int | None = None,
    feature_col: str = "features_array",
    **kw,
) -> M.Elimination:
    """Recursive elimination from a model's stable features, or the first ``start_size``."""
    where = {"scenario": config.scenario, "model": model}
    if from_aggregated:
        rows = catalog.stability(config.stability_threshold, **where)
        ordered = rows.orderBy(F.col("selection_fraction").desc(), "feature")
    else:
        rows = catalog.read("stable_panel", split_seed=seed, **where).where("kept")
        ordered = rows.orderBy(F.col("selection_freq").desc(), "feature")
    ordered = ordered.select("feature")
    ordered = ordered if start_size is None else ordered.limit(start_size)
    start = [r["feature"] for r in ordered.collect()]
    if len(start) < config.min_panel:
        raise ValueError(f"only {len(start)} stable features for {model}")
    covariates = _covariates(cohort, splits, seed, config)
    train = checkpointed(_assembled(cohort, splits, seed, S.TRAIN, feature_col, covariates))
    val = checkpointed(_assembled(cohort, splits, seed, S.VAL, feature_col, covariates))
    result = M.recursive_elimination(
        train, val, [*names, *covariates.names], start, model, config.params.get(model), config.min_panel,
        seed=seed, always=covariates.names, **kw
    )
    catalog.save_elimination(result, seed, config.scenario)
    return result


def make_consensus(
    cohort_long: DataFrame, catalog: Catalog, config: StudyConfig, **kw
) -> dict[str, DataFrame]:
    """Cross-model consensus panel from one scenario's stability and elimination tables."""
    models = catalog.models_with_results(scenario=config.scenario)
    if len(models) < 2:
        raise ValueError("consensus needs results of at least two models")
    stability = catalog.read("stability", scenario=config.scenario).where(
        F.col("model").isin(models)
    )
    stable = panels.stable_features(stability, config.stability_threshold)
    names = [r[0] for r in stable.select("feature").distinct().orderBy("feature").collect()]
    pairs = checkpointed(corr.correlation(cohort_long, names, "spearman"))
    result = panels.consensus_panel(
        stability,
        pairs,
        catalog.elimination_ranking(scenario=config.scenario),
        config.stability_threshold,
        config.corr_threshold,
        config.panel_size,
        **kw,
    )
    catalog.save_consensus(result, config.scenario)
    return result


def evaluate_holdout(
    cohort: DataFrame,
    catalog: Catalog,
    config: StudyConfig,
    model: str,
    seed: int,
    fractions: Sequence[float] = (0.01,),
    clinical_points: Sequence[float] = (),
    feature_col: str = "features_array",
) -> dict[str, DataFrame]:
    """Score the holdout with a stored model and measure it once."""
    fitted, calibrator, settings = catalog.load_model(config.scenario, model, seed)
    ids = catalog.load_holdout(config.scenario).withColumn("split", F.lit(S.HOLDOUT))
    rows = P.split_rows(cohort, ids, S.HOLDOUT)
    rows = P.with_outcome(rows.drop("y"), P.scenario_positives(config.scenario), "target")
    rows = with_covariates(rows, Covariates.from_json(settings.get("covariates")), feature_col)
    frame = M.vectors(rows, feature_col, ["id", "y", "target"], None)
    scored = M.predict(fitted, frame, ["id", "y", "target"])
    if calibrator is not None:
        scored = calibrator.transform(scored)
    adjusted = adjust_for_prevalence(
        scored, float(settings["train_prevalence"]), float(settings["target_prevalence"])
    )
    adjusted = checkpointed(adjusted)
    active = adjusted.withColumn("y_prob", F.col("y_prob_adjusted"))
    row, at = L.holdout_metrics(
        active, {"primary": float(settings["threshold"])}, [], clinical_points
    )
    out = {
        "predictions": adjusted,
        "metrics": row,
        "thresholds": at,
        "top_risk": T.top_risk_capture(active, [], fractions),
        "decision_curve": dca.decision_curve(active, []),
    }
    keys = {"scenario": F.lit(config.scenario), "model": F.lit(model), "split_seed": F.lit(seed)}
    for name, table in out.items():
        catalog.write(f"holdout_{name}", table.withColumns(keys), list(keys))
    return out


def run_study(
    cohort: DataFrame,
    names: Sequence[str],
    catalog: Catalog,
    config: StudyConfig,
    feature_col: str = "features_array",
    with_ensemble: bool = True,
    with_consensus: bool = True,
    with_panels: bool = False,
) -> dict[str, DataFrame]:
    """Splits → every model and seed → ensemble → aggregation → panels → consensus."""
    make_splits(cohort, catalog, config)
    base = P.scenario_rows(cohort, config.scenario, "target")
    table = catalog.load_splits(config.scenario, base=base)
    target = F.col("target")
    positives = P.scenario_positives(config.scenario)
    labelled = table.join(cohort.select("id", "target"), "id").withColumn(
        "y", target.isin(*positives).cast("int")
    )
    splits = checkpointed(labelled.select("id", "split", "split_seed", "y"))
    # Every branch writes its own partitions, and what others wrote outlives a failed one.
    side_by_side(
        catalog.spark,
        {
            f"{model}, seed {seed}": lambda model=model, seed=seed: train_model(
                cohort, splits, names, catalog, config, model, seed, feature_col
            )
            for seed in config.seeds
            for model in config.models
        },
        config.branches,
    )
    if with_ensemble and len(config.models) > 1:
        side_by_side(
            catalog.spark,
            {f"ensemble, seed {s}": lambda s=s: train_ensemble(catalog, config, s) for s in config.seeds},
            config.branches,
        )
    out = aggregate_splits(catalog, config)
    if with_panels:
        for model in config.models:
            optimize_panel(
                cohort, splits, names, catalog, config, model, config.seeds[0], True,
                feature_col=feature_col,
            )
    if with_consensus and len(config.models) > 1:
        long = P.melt_array(cohort, feature_col, ["id"], names=names)
        # One seed's TRAIN: the union over seeds would hold every seed's TEST rows.
        first = (F.col("split") == S.TRAIN) & (F.col("split_seed") == config.seeds[0])
        train_ids = splits.where(first).select("id").distinct()
        out.update(make_consensus(long.join(train_ids, "id", "left_semi"), catalog, config))
    return out
