"""The driver contract and a sample of queries against their SQL."""

import inspect

import pytest

import __spark_entry__ as contract
from riskloom.operators import resample, train
from riskloom.plans import study
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "auroc",
    "roc_points",
    "threshold_fixed_specificity",
    "decision_curve",
    "expected_calibration_error",
    "calibration_intercept_slope",
    "filter_audit",
    "stratified_split_sizes",
    "mann_whitney_many_features",
    "f_statistic_screen",
    "connected_components",
    "rank_aggregation_geometric",
    "summary_statistics",
    "stacking_meta_features",
    "prediction_catalog",
)


def test_registry_is_consistent():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 150


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    want = duck.execute(contract.oracle_sql()[name]).df()
    assert compare(got, want) is None


class _Called(Exception):
    """Ends a query where it calls its operator."""


@pytest.mark.parametrize(
    "name, operator",
    [("permutation_importance", "permutation_drops"), ("nested_cross_validation", "nested_cv"),
     ("recursive_elimination_curve", "recursive_elimination"),
     ("cross_validated_elimination", "cross_validated_elimination"),
     ("bootstrap_auroc_interval", "stratified_bootstrap_ci"), ("bootstrap_auroc_sd", "bootstrap_sd"),
     ("bootstrap_difference_interval", "bootstrap_difference_ci"), ("test_set_intervals", "test_set_intervals"),
     ("random_forest_scores", "classifier"), ("boosted_tree_scores", "classifier"),
     ("study_pooled_metrics", "run_study")],
)
def test_query_runs_the_whole_operator(spark, monkeypatch, name, operator):
    home = next(m for m in (train, resample, study) if getattr(getattr(m, operator, None), "__module__", "") == m.__name__)
    signature, seen = inspect.signature(getattr(home, operator)), {}

    def record(*args, **kwargs):
        seen.update(signature.bind(*args, **kwargs).arguments)
        raise _Called

    monkeypatch.setattr(home, operator, record)
    with pytest.raises(_Called):
        contract.queries()[name](spark, SF).collect()
    for draws in ("n_boot", "repeats", "cv_folds", "n_iter"):
        if draws in seen:
            assert seen[draws] >= signature.parameters[draws].default
    if "start" in seen:
        assert len(seen["start"]) == 64
    assert not seen.get("only")
    if operator == "nested_cv":
        assert len(seen["choices"]) > 1
    if operator == "classifier":
        assert not {"n_estimators", "max_depth"} & set(seen.get("params") or {})
    if operator == "run_study":
        whole, config = study.StudyConfig(), seen["config"]
        for part in ("models", "folds", "repeats", "n_boot"):
            assert getattr(config, part) == getattr(whole, part)
