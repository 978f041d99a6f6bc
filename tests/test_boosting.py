"""Boosting in one block against Spark's own rounds."""

import numpy as np
import pytest
from pyspark.ml import classification
from pyspark.sql import functions as F

from riskloom.operators import boosting as B
from riskloom.operators import train as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5)).round(2)
    x[:, 4] = 1.0
    y = rng.random(500) < 1 / (1 + np.exp(-x[:, 0] - x[:, 1] * x[:, 2] + 1))
    listed = [(i, int(y[i]), x[i].tolist()) for i in range(500)]
    df = spark.createDataFrame(listed, "id bigint, y int, a array<double>")
    return M.vectors(df, "a").coalesce(1).persist()


def probabilities(model, rows):
    scored = model.transform(rows).orderBy("id").select("probability").collect()
    return np.array([r[0][1] for r in scored])


SHARED = {"labelCol": "y", "weightCol": "weight", "maxIter": 8, "stepSize": 0.1, "seed": 3}


# Not deeper: in small nodes two splits gain the same, and rounding chooses.
@pytest.mark.parametrize(
    "limits", [{"maxDepth": 2}, {"maxDepth": 4, "minInstancesPerNode": 9}, {"maxBins": 8, "maxDepth": 3}]
)
def test_block_gives_the_model_of_sparks_rounds(spark, rows, limits, tmp_path):
    got = B.GBTClassifier(**SHARED, **limits).fit(rows)
    want = classification.GBTClassifier(**SHARED, **limits).fit(rows)
    assert type(got) is type(want) and got.getNumTrees == 8 and got.treeWeights == want.treeWeights
    assert np.abs(probabilities(got, rows) - probabilities(want, rows)).max() < 1e-9
    if limits.get("maxDepth") == 2:
        assert np.abs(got.featureImportances.toArray() - want.featureImportances.toArray()).max() < 1e-9
    got.write().save(str(tmp_path / "m"))
    again = classification.GBTClassificationModel.load(str(tmp_path / "m"))
    assert again.getMaxIter() == 8 and (probabilities(again, rows) == probabilities(got, rows)).all()


def test_rows_beyond_a_block_take_sparks_rounds(rows, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_VALUES", 500 * 5 - 1)
    got = B.GBTClassifier(**SHARED).fit(rows)
    assert np.abs(probabilities(got, rows) - probabilities(classification.GBTClassifier(**SHARED).fit(rows), rows)).max() == 0


def test_rounds_take_no_job_each(spark, rows):
    sc = spark.sparkContext
    sc.setJobGroup("boosting", "rounds")
    try:
        model = M.fit_model(rows, "XGBoost", {"n_estimators": 60})
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert model.stages[-1].getNumTrees == 60
    assert len(sc.statusTracker().getJobIdsForGroup("boosting")) < 60


def test_draws_do_not_depend_on_how_rows_come(rows):
    params = {"n_estimators": 6}
    first = probabilities(M.fit_model(rows, "XGBoost", params, scale=False), rows)
    dealt = rows.repartition(3).orderBy(F.desc("id"))
    assert (probabilities(M.fit_model(dealt, "XGBoost", params, scale=False), rows) == first).all()
    other = M.fit_model(rows, "XGBoost", params, scale=False, seed=7)
    assert (probabilities(other, rows) != first).any()


def test_odd_rows(spark, rows):
    few = M.fit_model(rows.limit(1), "XGBoost", {"n_estimators": 2}, scale=False)
    assert few.stages[-1].totalNumNodes == 2
    none = rows.withColumn("weight", F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0))
    assert np.isfinite(probabilities(B.GBTClassifier(**SHARED).fit(none), rows)).all()
    with pytest.raises(Exception, match="labels 0 and 1"):
        B.GBTClassifier(**SHARED).fit(rows.withColumn("y", F.col("id")))
