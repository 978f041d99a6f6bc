"""Training, elimination, stacking and a small study end to end."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import stacking as K, train as M
from riskloom.operators.discrimination import auroc
from riskloom.session import checkpointed

slow = pytest.mark.skipif(
    os.environ.get("RISKLOOM_SLOW") != "1", reason="minutes long; set RISKLOOM_SLOW=1"
)

NAMES = ["s0", "s1", "n0", "n1", "n2"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    y = (rng.random(160) < 0.35).astype(int)
    x = rng.normal(size=(160, 5))
    x[:, :2] += 1.5 * y[:, None]
    data = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(160)]
    df = spark.createDataFrame(data, "id bigint, y int, a array<double>")
    return checkpointed(M.vectors(df, "a").coalesce(2))


@pytest.mark.parametrize(
    "model, params, indices",
    [("LR_EN", {"C": 0.05, "l1_ratio": 1.0}, None), ("LR_EN", {"C": 1.0}, [4, 0, 2]),
     ("LinSVM_cal", {"C": 1.0, "max_iter": 8}, [0, 1, 3]),
     ("LinSVM_cal", {"C": 1.0, "max_iter": 8, "calibration_method": "isotonic"}, None),
     ("RF", {"n_estimators": 6, "max_depth": 2}, [0, 1, 3])],
)
def test_permutation_drops_equal_whole_vectors(spark, rows, monkeypatch, model, params, indices):
    fitted = M.fit_model(rows, model, params, indices, calibration_folds=2)
    monkeypatch.setattr(M, "TERMS", 2)
    got = {(r[0], r[1]): r[2] for r in M.permutation_drops(fitted, rows, NAMES, repeats=2).collect()}
    monkeypatch.setattr(M, "_margin_slopes", lambda *a: None)
    monkeypatch.setattr(M, "_used_places", lambda *a: {0, 1, 2, 3, 4})
    want = {(r[0], r[1]): r[2] for r in M.permutation_drops(fitted, rows, NAMES, repeats=2).collect()}
    assert got.keys() == want.keys() == {(k, n) for k in range(2) for n in NAMES}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize(
    "model, params",
    [("LR_EN", {"C": 1.0}), pytest.param("LinSVM_cal", {"C": 1.0}, marks=slow),
     ("LinSVM_cal", {"C": 1.0, "max_iter": 8}),
     ("LinSVM_cal", {"C": 1.0, "max_iter": 8, "calibration_method": "isotonic"}),
     ("RF", {"n_estimators": 10, "max_depth": 4}), ("XGBoost", {"n_estimators": 5, "max_depth": 2})],
)
def test_models_find_the_signal(spark, rows, model, params):
    scores = M.predict(M.fit_model(rows, model, params, calibration_folds=3), rows)
    assert scores.agg(F.min("y_prob"), F.max("y_prob")).first()[0] >= 0
    assert auroc(scores, []).first().auroc > 0.8


def test_default_iterations_are_the_reference_ones(spark, rows, monkeypatch):
    assert M.classifier("LinSVM_cal").getMaxIter() == 5000
    assert M.classifier("XGBoost").getMaxIter() == 1000
    seen = {}

    def fit(train, kind, params, **kwargs):
        seen.update(params)

    monkeypatch.setattr(M, "fit_model", fit)
    monkeypatch.setattr(M, "coefficient_importance", lambda model, names: dict.fromkeys(names, 1.0))
    M.model_selection(rows, NAMES, "XGBoost")
    assert seen["n_estimators"] == 200


def test_importance_orders_signal_first(spark, rows):
    model = M.fit_model(rows, "LR_EN", {"C": 1.0})
    coef = M.coefficient_importance(model, NAMES)
    assert {n for n, _ in sorted(coef.items(), key=lambda e: -e[1])[:2]} == {"s0", "s1"}
    drops = M.permutation_drops(model, rows, NAMES, repeats=2, only=["s0", "n0"])
    mean = {r.feature: r.d for r in drops.groupBy("feature").agg(F.avg("drop").alias("d")).collect()}
    assert set(mean) == {"s0", "n0"} and mean["s0"] > mean["n0"]


def test_nested_cv_scores_every_row_once_per_repeat(spark, rows):
    out = M.nested_cv(rows, NAMES, "LR_EN", folds=2, repeats=2, strategy=M.FeatureStrategy(screen_top_n=3))
    assert out.oof.groupBy("id").count().where("count <> 2").isEmpty()
    assert out.selection_log.count() == 4
    assert all(len(r.features) == 3 for r in out.selection_log.collect())
    assert out.calibrator is not None


def test_elimination_keeps_the_signal(spark, rows):
    out = M.recursive_elimination(rows, rows, NAMES, NAMES, "LR_EN", {"C": 1.0}, 2, cv_folds=1)
    smallest = out.curve.where("size = 2").first()
    assert smallest.features == ["s0", "s1"]
    assert out.ranking.count() == 3


def test_sizes_grids_and_candidates(spark, rows):
    assert M.evaluation_sizes(100, 5) == [100, 50, 25, 12, 6, 5]
    assert M.evaluation_sizes(100, 5, "fine") == [100, 75, 50, 37, 25, 18, 12, 9, 6, 5]
    assert M.evaluation_sizes(8, 5, "linear") == [8, 7, 6, 5]
    assert M.evaluation_sizes(4, 5) == [4]
    grid = M.parameter_grid("LR_EN")
    assert len(grid["C"]) == 7 and grid["C"][0] == pytest.approx(1e-4)
    assert len(M.candidates(grid)) == 21
    some = M.candidates(grid, 5, seed=1)
    assert len({tuple(c.values()) for c in some}) == 5
    with pytest.raises(ValueError):
        M.parameter_grid("nope")
    with pytest.raises(ValueError, match="gamma"):
        M.search(rows, "LR_EN", [{"gamma": 1.0}], 2)


def test_stacker(spark, rows):
    base = M.predict(M.fit_model(rows, "LR_EN", {"C": 1.0}), rows)
    noise = (F.xxhash64("id") % 1000 / 1000.0 + 1) / 2
    both = base.withColumn("model", F.lit("good")).unionByName(
        base.withColumn("y_prob", noise).withColumn("model", F.lit("bad"))
    )
    meta = K.collect_meta(both, ["good", "bad"])
    stacker = K.fit_stacker(meta, ["good", "bad"], calibration_folds=2)
    coef = {r.base_model: abs(r.coefficient) for r in stacker.coefficients(spark).collect()}
    assert coef["good"] > coef["bad"]
    assert stacker.predict(meta).count() == 160
    with pytest.raises(ValueError, match="disagree"):
        K.require_same_ids(both.where("model = 'good' OR id <> 3"), ["good", "bad"])


def test_a_lost_branch_leaves_the_others(spark):
    from riskloom.plans.study import side_by_side

    def pool():
        return spark.sparkContext.getLocalProperty("spark.scheduler.pool"), spark.range(7).count()

    assert side_by_side(spark, {"a": pool, "b": pool}, 2) == {"a": ("a", 7), "b": ("b", 7)}
    assert side_by_side(spark, {}, 2) == {}
    done = []
    with pytest.raises(ExceptionGroup) as lost:
        side_by_side(
            spark, {"bad": lambda: spark.range(3).select(F.raise_error(F.lit("gone"))).collect(),
                    "good": lambda: done.append(spark.range(5).count())}, 1,
        )
    assert done == [5] and lost.value.exceptions[0].__notes__ == ["in bad"]


def test_splits_of_several_scenarios(spark, tmp_path):
    from riskloom.plans.study import StudyConfig, make_scenario_splits
    from riskloom.sources.catalog import Catalog

    data = [(i, ["Controls", "Controls", "Incident", "Prevalent"][i % 4]) for i in range(200)]
    cohort = checkpointed(spark.createDataFrame(data, "id bigint, target string"))
    catalog = Catalog(spark, str(tmp_path / "splits"))
    made = make_scenario_splits(cohort, catalog, StudyConfig(), ["IncidentOnly", "IncidentPlusPrevalent"])
    assert {s: t.count() for s, t in made.items()} == {"IncidentOnly": 150, "IncidentPlusPrevalent": 200}
    assert catalog.load_splits("IncidentOnly").count() == 150
    assert catalog.load_split_metadata("IncidentPlusPrevalent", 0).count() == 3


def test_small_study(spark, tmp_path):
    from riskloom.plans.study import StudyConfig, evaluate_holdout, optimize_panel, run_study
    from riskloom.sources.catalog import Catalog

    rng = np.random.default_rng(11)
    y = (rng.random(240) < 0.3).astype(int)
    x = rng.normal(size=(240, 5))
    x[:, :2] += 1.5 * y[:, None]
    data = [(i, ["Controls", "Incident"][y[i]], [float(v) for v in x[i]]) for i in range(240)]
    cohort = checkpointed(
        spark.createDataFrame(data, "id bigint, target string, features_array array<double>").coalesce(2)
    )
    config = StudyConfig(
        models=("LR_EN", "LR_L1"), folds=2, repeats=1, holdout_size=0.2, n_boot=20, objective="youden",
        stability_threshold=0.5, corr_threshold=0.9, panel_size=3, min_panel=3,
        params={"LR_EN": {"C": 1.0}, "LR_L1": {"C": 1.0}}, target_prevalence=0.05, learning_points=2,
    )
    catalog = Catalog(spark, str(tmp_path / "study"))
    out = run_study(cohort, NAMES, catalog, config)
    pooled = {r.model: r.auroc for r in out["pooled_test"].collect()}
    assert set(pooled) == {"LR_EN", "LR_L1", "ENSEMBLE"} and min(pooled.values()) > 0.7
    # Without feature selection all features tie, so the panel follows the names.
    assert [r.feature for r in out["panel"].orderBy("rank").collect()] == ["n0", "n1", "n2"]
    # One scale in every table: scores at the target's prevalence, the ensemble's too.
    mean = catalog.predictions().groupBy("model").agg(F.avg("y_prob").alias("raw"), F.avg("y_prob_adjusted").alias("p"))
    assert all(r.p < 0.6 * r.raw for r in mean.collect()) and mean.count() == 3
    stored = catalog.metrics(split="TEST").select("model", "brier").collect()
    brier = {r.model: r.brier for r in out["pooled_test"].collect()}
    assert all(abs(r.brier - brier[r.model]) < 1e-9 for r in stored) and len(stored) == 3
    for name in ("roc_band", "pr_band", "calibration_band", "decision_curve_band", "risk_histogram", "risk_statistics"):
        table = catalog.read(f"aggregated_{name}", scenario="IncidentOnly")
        assert {r.model for r in table.select("model").distinct().collect()} == set(pooled), name
    for name in ("oof_roc", "oof_pr", "oof_calibration", "oof_thresholds", "learning_curve"):
        table = catalog.read(f"aggregated_{name}", scenario="IncidentOnly")
        assert {r.model for r in table.select("model").distinct().collect()} == {"LR_EN", "LR_L1"}, name
    screened = {r.feature: r for r in catalog.read("aggregated_screening").collect()}
    assert set(screened) == set(NAMES) and screened["s0"].n_splits == 1
    splits = catalog.load_splits("IncidentOnly").join(cohort.select("id", "target"), "id").withColumn(
        "y", (F.col("target") == "Incident").cast("int")
    )
    for aggregated in (True, False):
        cut = optimize_panel(cohort, splits, NAMES, catalog, config, "LR_EN", 0, aggregated, cv_folds=1)
        assert cut.curve.count() == 2
    assert catalog.elimination_ranking(model="LR_EN").count() == 2
    assert catalog.models_with_results() == ["LR_EN", "LR_L1"]
    assert catalog.best_parameters().count() == 0
    assert catalog.ensemble_predictions(split="TEST").count() > 0
    assert catalog.ensemble_parameters().count() == 1
    assert catalog.load_split_metadata("IncidentOnly", 0).count() == 3
    held = evaluate_holdout(cohort, catalog, config, "LR_EN", 0, clinical_points=[0.3])
    assert held["metrics"].first().n_samples == 48
    assert {r.kind for r in held["thresholds"].collect()} == {"primary", "clin_0p3"}


def test_forest_rows_are_dealt_to_tasks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 2, 1.0, [float(i % 7), float(i % 3)]) for i in range(400)],
                                 "id bigint, y int, weight double, a array<double>").coalesce(1)
    rows = rows.select("id", "y", "weight", M.array_to_vector("a").alias("features"))
    tasks = {}

    class Recorded(M.Pipeline):
        def fit(self, dataset):
            tasks[type(self.getStages()[-1]).__name__] = dataset.rdd.getNumPartitions()

    monkeypatch.setattr(M, "Pipeline", Recorded)
    M.fit_model(rows, "RF", {})
    M.fit_model(rows, "XGBoost", {})
    assert tasks["RandomForestClassifier"] == spark.sparkContext.defaultParallelism
    assert tasks["GBTClassifier"] == 1
    ids = [[r["id"] for r in part] for part in M._tree_rows(rows, 400, 500).rdd.glom().collect()]
    assert sorted(sum(ids, [])) == list(range(400))
    assert ids == [[r["id"] for r in part] for part in M._tree_rows(rows.repartition(3), 400, 500).rdd.glom().collect()]
