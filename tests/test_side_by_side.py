"""Outer folds and the linear machine's folds do not wait for each other."""

import threading

import numpy as np
import pytest

from riskloom.operators import train as M
from riskloom.session import in_order


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    y = x[:, 0] + rng.normal(size=120) > 0.5
    listed = [(i, int(y[i]), x[i].tolist()) for i in range(120)]
    df = spark.createDataFrame(listed, "id bigint, y int, a array<double>")
    return M.vectors(df, "a").repartition(6).persist()


def test_outer_folds_run_side_by_side_with_the_same_scores(spark, rows, monkeypatch):
    fit, together = M.fit_model, threading.Barrier(2, timeout=60)

    def waiting(train, model_name, params, *args, **kwargs):
        together.wait()
        return fit(train, model_name, {"n_estimators": 3, "max_depth": 2}, *args, **kwargs)

    monkeypatch.setattr(M, "fit_model", waiting)
    names = ["a", "b", "c"]
    got = M.nested_cv(rows, names, "XGBoost", 2, 1, calibration="none")
    assert [r.outer_split for r in got.selection_log.orderBy("outer_split").collect()] == [0, 1]
    monkeypatch.setattr(M, "_fits_at_once", lambda *a: 1)
    monkeypatch.setattr(together, "wait", lambda: None)
    want = M.nested_cv(rows, names, "XGBoost", 2, 1, calibration="none")
    key = ["repeat", "fold", "id", "y_true", "y_prob"]
    assert sorted(got.oof.select(key).collect()) == sorted(want.oof.select(key).collect())
    assert got.oof.count() == 120


def test_the_linear_machine_reads_few_rows_in_one_task(rows, monkeypatch):
    read = []

    class Recorded(M.Pipeline):
        def _fit(self, dataset):
            read.append(dataset.rdd.getNumPartitions())
            return super()._fit(dataset)

    monkeypatch.setattr(M, "Pipeline", Recorded)
    M.fit_model(rows, "LinSVM_cal", {"max_iter": 3}, calibration_folds=2)
    assert read == [1, 1, 1]


def test_jobs_answer_in_their_order_and_fail_loudly(spark):
    assert in_order(spark, [lambda k=k: k for k in range(5)], 3) == list(range(5))
    with pytest.raises(ZeroDivisionError):
        in_order(spark, [lambda: 1, lambda: 1 // 0], 2)
