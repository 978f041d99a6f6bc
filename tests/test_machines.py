"""Linear machines of one task against Spark's iterations."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml import classification
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from riskloom.operators import machines as L
from riskloom.operators import train as M


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)).round(3)
    x[:, 3] = 2.0
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) > 0.7).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    listed = [(i, int(y), x.tolist()) for i, (x, y) in enumerate(zip(*data, strict=True))]
    return M.vectors(spark.createDataFrame(listed, "id bigint, y int, a array<double>"), "a").coalesce(2).persist()


def loss(model, data, weights, penalty):
    x, y = data
    slopes = model.coefficients.toArray()
    hinge = np.maximum(0.0, 1.0 - (2 * y - 1) * (x @ slopes + model.intercept))
    return (weights * hinge).sum() / weights.sum() + penalty * slopes @ slopes / 2


@pytest.mark.parametrize("penalty", [1e-3, 0.05])
def test_machine_is_sparks_at_its_optimum(rows, data, penalty):
    weights = np.array([r.weight for r in rows.orderBy("id").select("weight").collect()])
    shared = {"labelCol": "y", "weightCol": "weight", "regParam": penalty, "standardization": False}
    got = L.LinearSVC(**shared, maxIter=100, tol=1e-5).fit(rows)
    want = classification.LinearSVC(**shared, maxIter=40, tol=1e-9).fit(rows)
    assert type(got) is type(want) and got.coefficients[3] == want.coefficients[3] == 0.0
    ours, theirs = (loss(m, data, weights, penalty) for m in (got, want))
    assert ours < theirs + 1e-9 and theirs - ours < 1e-3
    assert np.abs(got.coefficients.toArray() - want.coefficients.toArray()).max() < 0.05
    moved = [
        loss(shifted(got, d), data, weights, penalty)
        for d in np.random.default_rng(1).normal(size=(50, 5)) * 1e-3 * np.array([1, 1, 1, 0, 1])
    ]
    assert min(moved) >= ours


def shifted(model, change):
    slopes = DenseVector(model.coefficients.toArray() + change[:4])
    return SimpleNamespace(coefficients=slopes, intercept=model.intercept + change[4])


def test_machine_takes_few_jobs(spark, rows):
    sc = spark.sparkContext
    sc.setJobGroup("machine", "steps")
    try:
        M.fit_model(rows, "LinSVM_cal", {"C": 10.0})
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("machine")) < 120


def test_rows_beyond_a_block_and_odd_rows_take_sparks_iterations(rows, monkeypatch):
    settings = {"labelCol": "y", "regParam": 0.1, "standardization": False, "maxIter": 3}
    with pytest.raises(Exception, match="binary classification"):
        L.LinearSVC(**settings).fit(rows.withColumn("y", F.lit(0)))
    monkeypatch.setattr(L, "BLOCK_VALUES", 300 * 4 - 1)
    got, want = (c(**settings).fit(rows) for c in (L.LinearSVC, classification.LinearSVC))
    assert (got.coefficients.toArray() == want.coefficients.toArray()).all()


def test_order_of_rows_changes_rounding_only(rows):
    first = M.fit_model(rows, "LinSVM_cal", {"C": 1.0})
    other = M.fit_model(rows.repartition(3).orderBy(F.desc("id")), "LinSVM_cal", {"C": 1.0})
    a, b = (np.array([r.y_prob for r in M.predict(m, rows).orderBy("id").collect()]) for m in (first, other))
    assert np.abs(a - b).max() < 1e-3
