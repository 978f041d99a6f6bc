"""Forests grown by whole tasks against Spark's own."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel, classification
from pyspark.sql import functions as F

from riskloom.operators import boosting as B
from riskloom.operators import forest as R
from riskloom.operators import train as M
from riskloom.operators.discrimination import auroc


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)).round(2)
    x[:, 4] = 1.0
    x[:, 5] = x[:, 5].round()
    y = rng.random(500) < 1 / (1 + np.exp(-x[:, 0] - x[:, 1] * x[:, 2] + 1))
    listed = [(i, int(y[i]), x[i].tolist()) for i in range(500)]
    df = spark.createDataFrame(listed, "id bigint, y int, a array<double>")
    return M.vectors(df, "a").coalesce(1).persist()


def column(model, rows, name="probability"):
    scored = model.transform(rows).orderBy("id").select(name).collect()
    return np.array([r[0].toArray() if name != "prediction" else r[0] for r in scored])


WHOLE = {"labelCol": "y", "weightCol": "weight", "bootstrap": False, "featureSubsetStrategy": "all", "numTrees": 2}


@pytest.mark.parametrize(
    "limits",
    [{"maxDepth": 3}, {"maxDepth": 5, "minInstancesPerNode": 9}, {"maxBins": 8, "maxDepth": 4}, {"maxDepth": 1},
     {"maxDepth": 4, "minInfoGain": 0.01, "minWeightFractionPerNode": 0.03}],
)
@pytest.mark.parametrize("weights", ["class", "row"])
def test_tasks_grow_sparks_trees(spark, rows, limits, weights):
    if weights == "row":
        rows = rows.withColumn("weight", F.col("weight") * (1 + F.col("id") % 7))
    got = R.RandomForestClassifier(**WHOLE, **limits).fit(rows)
    want = classification.RandomForestClassifier(**WHOLE, **limits).fit(rows)
    assert isinstance(got, R.ForestModel) and got.totalNumNodes == want.totalNumNodes
    assert np.abs(column(got, rows) - column(want, rows)).max() < 1e-9
    assert np.abs(column(got, rows, "rawPrediction") - column(want, rows, "rawPrediction")).max() < 1e-9
    assert (column(got, rows, "prediction") == column(want, rows, "prediction")).all()
    assert np.abs(got.featureImportances.toArray() - want.featureImportances.toArray()).max() < 1e-9


def test_drawn_forest_is_like_sparks(rows):
    settings = {"labelCol": "y", "weightCol": "weight", "numTrees": 200, "maxDepth": 30, "minInstancesPerNode": 5}
    got = R.RandomForestClassifier(**settings, seed=3).fit(rows)
    want = classification.RandomForestClassifier(**settings, seed=3).fit(rows)
    other = classification.RandomForestClassifier(**settings, seed=4).fit(rows)
    assert abs(got.totalNumNodes / want.totalNumNodes - 1) < 0.05
    # As near as two of Spark's forests are to each other.
    near = np.abs(column(other, rows) - column(want, rows)).mean()
    assert np.abs(column(got, rows) - column(want, rows)).mean() < 1.25 * near
    assert np.abs(got.featureImportances.toArray() - want.featureImportances.toArray()).max() < 0.03
    assert got.getNumTrees == 200 and got.numFeatures == 6


def test_forest_takes_no_job_per_level(spark, rows):
    sc = spark.sparkContext
    sc.setJobGroup("forest", "levels")
    try:
        model = M.fit_model(rows, "RF", {"n_estimators": 40})
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert model.stages[-1].getNumTrees == 40
    fits = len(sc.statusTracker().getJobIdsForGroup("forest"))
    assert fits <= 18 and isinstance(model.stages[-1], R.ForestModel)
    assert auroc(M.predict(model, rows), []).first().auroc > 0.8


def test_rows_beyond_a_block_or_other_labels_take_sparks_forest(rows, monkeypatch):
    three = rows.withColumn("y", F.col("id") % 3)
    assert R.RandomForestClassifier(labelCol="y", numTrees=2).fit(three).numClasses == 3
    monkeypatch.setattr(R, "BLOCK_BYTES", 500 * 6 - 1)
    got = R.RandomForestClassifier(labelCol="y", numTrees=2).fit(rows)
    assert isinstance(got, classification.RandomForestClassificationModel)


def test_forest_does_not_depend_on_how_rows_come(rows, monkeypatch):
    params = {"n_estimators": 12}
    first = column(M.fit_model(rows, "RF", params, scale=False), rows)
    dealt = rows.repartition(3).orderBy(F.desc("id"))
    monkeypatch.setattr(R, "CELLS", 1)  # a feature at a time
    assert (column(M.fit_model(dealt, "RF", params, scale=False), rows) == first).all()
    other = M.fit_model(rows, "RF", params, scale=False, seed=7)
    assert (column(other, rows) != first).any()


def test_stored_forest_is_the_same(spark, rows, tmp_path):
    model = M.fit_model(rows, "RF", {"n_estimators": 5}, [0, 2, 3])
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert np.abs(column(again, rows) - column(model, rows)).max() < 1e-12
    assert again.stages[-1].getNumTrees == 5 and again.stages[-1].getFeaturesCol() == "scaled"
    first, second = (M.coefficient_importance(m, ["a", "b", "c"]) for m in (model, again))
    assert all(abs(first[n] - second[n]) < 1e-12 for n in first) and first["a"] > 0


def test_boosted_trees_in_files_are_those_that_spark_loads(spark, rows, tmp_path, monkeypatch):
    got = M.fit_model(rows, "XGBoost", {"n_estimators": 9}, [0, 1, 2])
    assert isinstance(got.stages[-1], R.ForestModel)
    monkeypatch.setattr(R, "tree_model", None)  # nothing but ``in_files`` needs it
    monkeypatch.setattr(B.GBTClassifier, "_fit", lambda self, data, fit=B.GBTClassifier._fit: fit(spark_model(self), data))
    want = M.fit_model(rows, "XGBoost", {"n_estimators": 9}, [0, 1, 2])
    assert isinstance(want.stages[-1], classification.GBTClassificationModel)
    for name in ("probability", "rawPrediction", "prediction"):
        assert np.abs(column(got, rows, name) - column(want, rows, name)).max() < 1e-12
    values = [m.stages[-1].featureImportances.toArray() for m in (got, want)]
    assert np.abs(values[0] - values[1]).max() < 1e-9
    assert got.stages[-1].totalNumNodes == want.stages[-1].totalNumNodes
    got.write().save(str(tmp_path / "b"))
    again = PipelineModel.load(str(tmp_path / "b"))
    assert np.abs(column(again, rows) - column(want, rows)).max() < 1e-12


def spark_model(estimator):
    estimator.in_files = False
    return estimator


def test_odd_rows(rows):
    one = M.fit_model(rows.limit(1), "RF", {"n_estimators": 3}, scale=False)
    assert set(column(one, rows)[:, 1]) <= {0.0, 1.0}
    none = rows.withColumn("weight", F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0))
    assert np.isfinite(column(M.fit_model(none, "RF", {"n_estimators": 3}), rows)).all()
    assert column(M.fit_model(rows, "RF", {"n_estimators": 3}), rows.where("id < 0")).shape == (0,)
    with pytest.raises(Exception, match="weights from 0"):
        M.fit_model(rows.withColumn("weight", F.lit(-1.0)), "RF", {"n_estimators": 3})
