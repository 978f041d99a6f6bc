"""Training, selection by models, stacking and evaluation (family O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import calibrate, fits as B, stacking as K, train as M
from riskloom.operators.splits import fold_column
from riskloom.plans import evaluate as E
from riskloom.queries.metrics import AP, AUROC, SENS95, YOUDEN
from riskloom.queries.operating_points import YOUDEN_THR, _RATES, _confusion
from riskloom.queries.registry import EVENTS_SQL, PREDICTIONS_SQL, Tables, query, roc_sql, rounded
from riskloom.session import checkpointed

NAMES = [f"f{i:04d}" for i in range(64)]


def _train(t: Tables):
    return checkpointed(M.vectors(t.wide_cohort(), "embedding"))


def _halves(t: Tables):
    rows = _train(t)
    folds = fold_column(rows, 2, 1, 5).select("id", "fold")
    split = checkpointed(rows.join(folds, "id"))
    return (
        split.where(F.col("fold") == 0).drop("fold"),
        split.where(F.col("fold") == 1).drop("fold"),
    )


def _scores(t: Tables, model: str, params: dict):
    rows = _train(t)
    return M.predict(M.fit_model(rows, model, params), rows)


@query("class_weights", """WITH c AS (SELECT vec_id AS id, CASE WHEN label < 2 THEN 1 ELSE 0 END AS y FROM embeddings),
n AS (SELECT COUNT(*) AS n, SUM(y) AS p FROM c)
SELECT id, y, ROUND(CASE WHEN y = 1 THEN n / (2.0 * p) ELSE n / (2.0 * (n - p)) END, 9) AS weight FROM c, n""")
def _weights(t: Tables):
    return rounded(M.with_class_weights(t.wide_cohort().select("id", "y")))


@query("logistic_regression_scores")
def _logistic(t: Tables):
    return _scores(t, "LR_EN", {"C": 0.1, "l1_ratio": 0.5})


@query("linear_svm_scores")
def _svm(t: Tables):
    return _scores(t, "LinSVM_cal", {"C": 0.1})


@query("random_forest_scores")
def _forest(t: Tables):
    return _scores(t, "RF", {})


@query("boosted_tree_scores")
def _boosted(t: Tables):
    return _scores(t, "XGBoost", {})


@query("coefficient_importance")
def _coefficients(t: Tables):
    model = M.fit_model(_train(t), "LR_EN", {"C": 0.1, "l1_ratio": 0.5})
    return M.coefficient_table(model, NAMES, t.spark)


@query("permutation_importance")
def _permutation(t: Tables):
    rows = _train(t)
    model = M.fit_model(rows, "LR_EN", {"C": 1.0, "l1_ratio": 0.5})
    return M.permutation_drops(model, rows, NAMES)


@query("model_based_selection")
def _model_selection(t: Tables):
    return M.model_selection(_train(t), NAMES, "LR_EN", "median")


@query("fold_features_by_strategy")
def _fold_features(t: Tables):
    strategy = M.FeatureStrategy(screen_top_n=30, k_best=20, model_selector=True)
    names = M.fold_features(_train(t), NAMES, "LR_EN", strategy)
    return t.spark.createDataFrame([(n,) for n in names], "feature string")


@query("hyperparameter_search")
def _search(t: Tables):
    choices = M.candidates({"C": [0.01, 0.1, 1.0], "l1_ratio": [0.5]})
    _, _, scores = M.search(_train(t), "LR_EN", choices, 3)
    rows = [(c["C"], s) for c, s in zip(choices, scores, strict=True)]
    return t.spark.createDataFrame(rows, "C double, score double")


@query("two_objective_trials")
def _objectives(t: Tables):
    choices = M.candidates({"C": [0.01, 1.0], "l1_ratio": [0.5]})
    return M.two_objective_scores(_train(t), "LR_EN", choices, 3)


@query("tuning_scores_by_scorer")
def _scorers(t: Tables):
    rows = _train(t)
    scored = checkpointed(M.fit_model(rows, "LR_EN", {"C": 0.1}).transform(rows))
    names = ("roc_auc", "average_precision", "tpr_at_fpr", "neg_brier_score")
    values = [(n, float(M.scorer(n).evaluate(scored))) for n in names]
    return t.spark.createDataFrame(values, "scoring string, value double")


@query("score_with_adjustment")
def _adjusted(t: Tables):
    rows = _train(t)
    model = M.fit_model(rows, "LR_EN", {"C": 0.1})
    scored = calibrate.score_with_adjustment(model, rows, M.prevalence(rows), 0.05)
    return scored.select("id", "y", "y_prob", "y_prob_adjusted")


@query("calibrated_model_scores")
def _calibrated(t: Tables):
    rows = _train(t)
    oof = M.cross_fitted(rows, "LR_EN", {"C": 0.1}, None, 3)
    fitted = M.CalibratedModel(
        M.fit_model(rows, "LR_EN", {"C": 0.1}), calibrate.OOFCalibrator("sigmoid").fit(oof)
    )
    return fitted.predict(rows)


@query("nested_cross_validation")
def _nested(t: Tables):
    out = M.nested_cv(
        _train(t), NAMES, "LR_EN", choices=M.candidates(M.parameter_grid("LR_EN")),
        repeats=2, strategy=M.FeatureStrategy(k_best=16),
    )
    return out.oof


@query("k_best_per_training_set", """WITH v AS (SELECT vec_id % 3 AS fold, label < 2 AS y,
  UNNEST(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
h(held_out) AS (VALUES (0), (1), (2)),
m AS (SELECT held_out, j, COUNT(*) FILTER (y) AS n1, COUNT(*) FILTER (NOT y) AS n0,
  AVG(x) FILTER (y) - AVG(x) FILTER (NOT y) AS gap,
  COALESCE(VAR_POP(x) FILTER (y) * COUNT(*) FILTER (y), 0)
    + COALESCE(VAR_POP(x) FILTER (NOT y) * COUNT(*) FILTER (NOT y), 0) AS ss
  FROM v JOIN h ON fold <> held_out GROUP BY held_out, j),
f AS (SELECT held_out, j, n1 * n0 / (n1 + n0) * gap ** 2 / (ss / (n1 + n0 - 2)) AS f FROM m)
SELECT held_out::INT AS held_out, 'f' || lpad(j::VARCHAR, 4, '0') AS feature, ROUND(f, 6) AS f_score FROM f
QUALIFY ROW_NUMBER() OVER (PARTITION BY held_out ORDER BY f DESC, j) <= 16""")
def _k_best_per_training_set(t: Tables):
    rows = _train(t).withColumn("member", F.array(F.pmod("id", F.lit(3)).cast("int")))
    blocks = B.pack(rows, 3)
    sums = B.moments(blocks)
    blocks.release()
    out = []
    for g in range(3):
        scores = sums.f_scores(B.Fit(0, g))
        out += [(g, NAMES[j], float(scores[j])) for j in sums.best(B.Fit(0, g), 16)]
    return rounded(t.spark.createDataFrame(out, "held_out int, feature string, f_score double"), 6)


@query("recursive_elimination_curve")
def _elimination(t: Tables):
    train, val = _halves(t)
    out = M.recursive_elimination(
        train, val, NAMES, NAMES, "LR_EN", {"C": 1.0}, 4, min_auroc_frac=0.0
    )
    return out.curve


@query("cross_validated_elimination")
def _rfecv(t: Tables):
    train, val = _halves(t)
    out = M.cross_validated_elimination(train, val, NAMES, NAMES, "LR_EN", {"C": 1.0}, 4)
    rows = [(int(k), float(v)) for k, v in out["cv_scores"].items()]
    return t.spark.createDataFrame(rows, "size int, score double")


@query("learning_curve")
def _learning_curve(t: Tables):
    return M.learning_curve(_train(t), "LR_EN", {"C": 0.1}, folds=2, n_points=3)


# --- stacking --------------------------------------------------------------------


def _stack_rows(t: Tables):
    """Three scores per event as three models, two repeats each."""
    p = F.col("y_prob")
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(r).alias("repeat"), e.alias("y_prob"))
            for m, r, e in (
                ("a", 0, p), ("a", 1, p * 0.9), ("b", 0, p * p), ("b", 1, p * p * 0.8),
                ("c", 0, 1 - p * 0.5), ("c", 1, 1 - p * 0.25),
            )
        ]
    )
    return t.event_predictions().select("id", "y_true", "split_seed", F.inline(entries))


@query("stacking_meta_features", f"""WITH {EVENTS_SQL},
m AS (SELECT id, y_true, (y_prob + y_prob * 0.9) / 2 AS a, (y_prob * y_prob + y_prob * y_prob * 0.8) / 2 AS b,
  (1 - y_prob * 0.5 + 1 - y_prob * 0.25) / 2 AS c FROM pred),
q AS (SELECT id, y_true, {", ".join(f"GREATEST(LEAST({m}, 1 - 1e-7), 1e-7) AS {m}" for m in "abc")} FROM m)
SELECT id, y_true, {", ".join(f"ROUND(LN({m} / (1 - {m})), 6) AS oof_{m}" for m in "abc")} FROM q""")
def _meta(t: Tables):
    return rounded(K.collect_meta(_stack_rows(t), ["a", "b", "c"]), 6)


@query("stacking_id_mismatches", f"""WITH {EVENTS_SQL}
SELECT id, 'a' AS models FROM pred WHERE id % 10 = 0""")
def _mismatches(t: Tables):
    rows = _stack_rows(t).where((F.col("model") == "a") | (F.col("id") % 10 != 0))
    out = K.id_mismatches(rows, ["a", "b"])
    return out.withColumn("models", F.array_join("models", ","))


@query("stacked_predictions")
def _stacked(t: Tables):
    meta = K.collect_meta(_stack_rows(t), ["a", "b", "c"])
    stacker = K.fit_stacker(meta, ["a", "b", "c"], calibration_folds=3)
    return stacker.predict(meta).select("id", "y_true", "y_prob")


@query("stacker_coefficients")
def _stacker(t: Tables):
    meta = K.collect_meta(_stack_rows(t), ["a", "b", "c"])
    return K.fit_stacker(meta, ["a", "b", "c"], calibrate=False).coefficients(t.spark)


@query("stack_and_score_splits")
def _stack_run(t: Tables):
    rows = _stack_rows(t)
    oof = rows.where(F.col("split_seed") < 4)
    split = F.when(F.col("split_seed") < 5, "VAL").otherwise("TEST")
    later = rows.where((F.col("split_seed") >= 4) & (F.col("repeat") == 0)).withColumn("split", split)
    _, scored = K.stack_from_run(oof, later, ["a", "b", "c"], calibrate=False)
    return scored


# --- evaluation ------------------------------------------------------------------


@query("evaluate_splits", f"""WITH {PREDICTIONS_SQL}, {roc_sql("model")},
b AS (SELECT model, AVG((y_true - y_prob) ** 2) AS brier FROM pred GROUP BY model),
s AS (SELECT model, {AUROC} AS auroc, {AP} AS prauc, {YOUDEN} AS youden, {SENS95} AS sens, MAX(brier) AS brier,
  {YOUDEN_THR} AS threshold FROM roc JOIN b USING (model) GROUP BY model),
{_confusion("model, threshold", "pred JOIN s USING (model)")}
SELECT model, ROUND(auroc, 9) AS auroc, ROUND(prauc, 9) AS prauc, ROUND(youden, 9) AS youden,
  ROUND(sens, 9) AS sensitivity_at_spec, ROUND(brier, 9) AS brier, ROUND(threshold, 9) AS threshold,
  tp, fp, tn, fn, {_RATES} FROM s JOIN cm USING (model, threshold)""")
def _evaluate(t: Tables):
    out = E.evaluate_predictions(t.predictions(), ["model"])
    return rounded(out.drop("n_pos", "n", "objective", "ece", "calib_intercept", "calib_slope"))


@query("evaluate_validation_then_test")
def _val_test(t: Tables):
    split = F.when(F.col("split_seed") < 3, "VAL").otherwise("TEST")
    rows = t.predictions().withColumn("split", split).withColumn("split_seed", F.lit(0))
    return E.evaluate_validation_then_test(rows)


@query("operating_rates_at_fixed_points", f"""WITH {PREDICTIONS_SQL},
thr(kind, threshold) AS (VALUES ('low', CAST('0.3' AS DOUBLE)), ('high', CAST('0.5' AS DOUBLE))),
{_confusion("model, kind, threshold", "pred CROSS JOIN thr")}
SELECT model, kind, threshold, tp, fp, tn, fn, {_RATES} FROM cm""")
def _operating(t: Tables):
    return rounded(E.operating_rates(t.predictions(), {"low": 0.3, "high": 0.5}))


@query("study_pooled_metrics")
def _study(t: Tables):
    from riskloom.plans.study import StudyConfig, run_study
    from riskloom.queries.storage import fresh_folder
    from riskloom.sources.catalog import Catalog

    cohort = t.wide_cohort().select("id", "target", F.col("embedding").alias("features_array"))
    # The cohort has neither sex nor age, so strata come from the outcome.
    config = StudyConfig(
        scenario="IncidentPlusPrevalent",
        stability_threshold=0.5,
        corr_threshold=0.9,
        panel_size=5,
        objective="youden",
    )
    catalog = Catalog(t.spark, fresh_folder(t.spark, "study"))
    out = run_study(checkpointed(cohort), NAMES, catalog, config, with_consensus=False)
    return out["pooled_test"]
