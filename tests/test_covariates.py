"""Metadata in the models of a study."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import train as M
from riskloom.operators.covariates import Covariates, fit_covariates, with_covariates
from riskloom.operators.discrimination import auroc
from riskloom.plans import study as P
from riskloom.session import checkpointed
from riskloom.sources.catalog import Catalog

NAMES = ["n0", "n1", "n2", "n3"]


def test_values_and_levels(spark):
    schema = "id bigint, age double, sex string, flat string"
    train = spark.createDataFrame(
        [(1, 40.0, "F", "a"), (2, 60.0, "M", "a"), (3, None, "X", "a"), (4, float("nan"), None, "a")], schema
    )
    fitted = fit_covariates(train, ["age"], ["sex", "flat"])
    assert fitted.names == ["age", "sex_M", "sex_X"]
    assert Covariates.from_json(fitted.to_json()) == fitted and Covariates.from_json(None).names == []
    new = spark.createDataFrame([(9, 10.0, "M", "b"), (10, None, "new", None)], schema)
    got = {r[0]: r[1] for r in train.unionByName(new).select("id", fitted.values()).collect()}
    assert got == {
        1: [40, 0, 0], 2: [60, 1, 0], 3: [50, 0, 1], 4: [50, 0, 0], 9: [10, 1, 0], 10: [50, 0, 0],
    }
    with pytest.raises(ValueError, match="no metadata columns"):
        fit_covariates(train, ["bmi"])
    many = spark.range(300).select(F.col("id").cast("string").alias("sex"))
    with pytest.raises(ValueError, match="levels"):
        fit_covariates(many, [], ["sex"])
    assert with_covariates(train, fit_covariates(train), "age") is train
    empty = fit_covariates(train.limit(0), ["age"], ["sex"])
    assert empty.names == ["age"] and train.select(empty.values()[0]).first()[0] == 40.0


def test_encoding_equals_the_preprocessing_pipeline(spark):
    from pyspark.ml.functions import vector_to_array

    from riskloom.operators.prepare import preprocessor

    rows = spark.createDataFrame(
        [(i, float(i * i % 17), "cab"[i % 3]) for i in range(30)], "id bigint, age double, sex string"
    )
    fitted = fit_covariates(rows, ["age"], ["sex"])
    stage = preprocessor(rows, ["age"], ["sex"]).fit(rows)
    both = stage.transform(rows).select(vector_to_array("features").alias("a"), fitted.values().alias("b")).collect()
    a, b = np.array([r.a for r in both]), np.array([r.b for r in both])
    b[:, 0] = (b[:, 0] - b[:, 0].mean()) / b[:, 0].std(ddof=1)
    assert np.allclose(a, b)


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(4)
    age, sex = rng.normal(50, 10, 300), rng.integers(0, 2, 300)
    y = rng.random(300) < 1 / (1 + np.exp(-((age - 58) / 4 + 2.0 * sex)))
    x = rng.normal(size=(300, 4))
    data = [
        (i, ["Controls", "Incident"][int(y[i])], float(age[i]), "FM"[sex[i]], [float(v) for v in x[i]])
        for i in range(300)
    ]
    data[7] = (7, "Controls", None, "F", data[7][4])
    schema = "id bigint, target string, age double, sex string, features_array array<double>"
    return checkpointed(spark.createDataFrame(data, schema).coalesce(2))


def test_study_with_metadata_only_signal(spark, cohort, tmp_path):
    config = P.StudyConfig(
        models=("LR_EN",), folds=2, repeats=1, holdout_size=0.2, n_boot=20, objective="youden", min_panel=2,
        stability_threshold=0.5, params={"LR_EN": {"C": 1.0}}, numeric_metadata=("age",), categorical_metadata=("sex",),
        strategy=M.FeatureStrategy(screen_method="mannwhitney", screen_top_n=3),
    )
    catalog = Catalog(spark, str(tmp_path / "study"))
    table = P.make_splits(cohort, catalog, config)
    assert table.where("id = 7").isEmpty()  # no age
    splits = checkpointed(
        table.select("id", "split", "split_seed", (F.col("target") == "Incident").cast("int").alias("y"))
    )
    scored = P.train_model(cohort, splits, NAMES, catalog, config, "LR_EN", 0)
    assert auroc(scored, []).first().auroc > 0.75
    # Metadata are in the model and its coefficients, and in no list of measured features.
    log = catalog.read("selection_log").collect()
    assert all(len(r.features) == 3 and set(r.features) < set(NAMES) for r in log)
    assert {"age", "sex_M"} < {r.feature for r in catalog.read("coefficient_log").collect()}
    assert {r.feature for r in catalog.read("screening").collect()} == set(NAMES)
    _, _, settings = catalog.load_model("IncidentOnly", "LR_EN", 0)
    assert {"age", "sex_M"} < set(settings["features"].split(","))
    held = P.evaluate_holdout(cohort, catalog, config, "LR_EN", 0)
    assert held["metrics"].first().auroc > 0.75
    panel = catalog.read("stable_panel").where("kept").select("feature").collect()
    cut = P.optimize_panel(cohort, splits, NAMES, catalog, config, "LR_EN", 0, cv_folds=1)
    points = cut.curve.orderBy("size").collect()
    assert [p.size for p in points][0] == 2 and points[-1].size == len(panel)
    # Every size keeps the metadata, so noise panels still predict.
    assert all(p.auroc_val > 0.75 and set(p.features) <= set(NAMES) for p in points)
    assert not {r.feature for r in cut.ranking.collect()} & {"age", "sex_M"}
    without = P.StudyConfig(models=("LR_EN",), numeric_metadata=("bmi",))
    with pytest.raises(ValueError, match="filtered by numbers"):
        P.train_model(cohort, splits, NAMES, catalog, without, "LR_EN", 0)


def test_trees_keep_metadata_while_features_leave(spark, cohort):
    rows = cohort.dropna(subset=["age"]).withColumn("y", (F.col("target") == "Incident").cast("int"))
    fitted = fit_covariates(rows, ["age"], ["sex"])
    frame = checkpointed(M.vectors(with_covariates(rows, fitted, "features_array"), "features_array").coalesce(2))
    out = M.recursive_elimination(
        frame, frame, [*NAMES, *fitted.names], NAMES[:3], "RF", {"n_estimators": 8, "max_depth": 3}, 2, cv_folds=1,
        n_perm_repeats=1, always=fitted.names,
    )
    assert all(p.auroc_val > 0.75 and set(p.features) <= set(NAMES) for p in out.curve.collect())
    assert out.ranking.count() == 1
