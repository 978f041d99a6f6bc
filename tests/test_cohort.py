"""Preparation, splits and sources."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import prepare as P, splits as S
from riskloom.sources import cohort as Q
from riskloom.sources.catalog import Catalog


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(42)
    labels = ["Controls"] * 300 + ["Incident"] * 60 + ["Prevalent"] * 40
    rows = [
        (i, t, float(rng.uniform(20, 80)), ["F", "M", None][i % 3]) for i, t in enumerate(labels)
    ]
    return spark.createDataFrame(rows, "id bigint, target string, age double, sex string")


def test_stratified_split_is_a_partition(spark, cohort):
    strata, scheme = S.working_strata(cohort, 2, "target")
    out = S.stratified_split(strata, [0, 1], 0.25, 0.25)
    assert scheme in S.SCHEMES
    assert out.count() == 2 * 400
    assert S.split_overlap(out).isEmpty()
    sizes = {(r.split_seed, r.split): r["count"] for r in out.groupBy("split_seed", "split").count().collect()}
    assert sizes[(0, "TRAIN")] == 200 and sizes[(0, "VAL")] == 100 and sizes[(1, "TEST")] == 100


def test_split_does_not_depend_on_partitions(spark, cohort):
    strata, _ = S.working_strata(cohort, 2, "target")
    one = S.stratified_split(strata.coalesce(1), [7], 0.2, 0.2)
    many = S.stratified_split(strata.repartition(9), [7], 0.2, 0.2)
    assert S.same_splits(one, many)
    other = S.stratified_split(strata, [8], 0.2, 0.2).withColumn("split_seed", F.lit(7))
    assert not S.same_splits(one, other)


def test_missing_sex_has_its_own_stratum(spark, cohort):
    names = {r.stratum for r in S.with_strata(cohort, "outcome+sex", "target").collect()}
    assert "Controls_UnknownSex" in names


def test_rare_strata_collapse(spark):
    df = spark.createDataFrame([("Controls", "a")] * 3 + [("Incident", "b")], "target string, stratum string")
    out = {r.stratum for r in S.collapse_rare(df, 2, "target").collect()}
    assert out == {"a", "Incident_RARE"}


def test_age_bins_are_right_closed(spark):
    df = spark.createDataFrame([(40.0,), (40.1,), (60.0,), (151.0,)], "__age double")
    got = [r.b for r in df.select(S.age_bin(F.col("__age"), "age3").alias("b")).collect()]
    assert got == ["young", "middle", "middle", "nan"]


def test_repeated_splits_keep_prevalent_in_train(spark, cohort):
    table, _ = S.repeated_splits(
        cohort, ["Incident", "Prevalent"], [0, 1], prevalent_train_only=True,
        prevalent_fraction=0.5, train_controls_per_case=1.0, target_col="target",
    )
    assert S.prevalent_in_evaluation(table, "target").isEmpty()
    train = table.where("split = 'TRAIN' AND split_seed = 0").groupBy("target").count().collect()
    n = {r.target: r["count"] for r in train}
    assert n["Prevalent"] == 20 and n["Controls"] == n["Incident"] + n["Prevalent"]
    S.validate_splits(table, cohort)
    with pytest.raises(ValueError):
        S.validate_splits(table.unionByName(table.withColumn("split", F.lit("TEST"))))


def test_temporal_split_with_one_hot_date(spark):
    # Half of all rows share one date, so the cuts fall inside it.
    day = datetime.date(2020, 1, 1)
    rows = [(i, day if 20 <= i < 70 else day + datetime.timedelta(days=i - 40)) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, d date")
    out = S.temporal_split(df, "d", 0.3, 0.3)
    order = [r.id for r in df.orderBy("d", "id").collect()]
    got = {r.id: r.split for r in out.collect()}
    assert [got[i] for i in order] == ["TRAIN"] * 40 + ["VAL"] * 30 + ["TEST"] * 30


def test_temporal_order_of_text_and_missing(spark):
    df = spark.createDataFrame([(1, "2021-01-02"), (2, None), (3, "2021-01-01")], "id bigint, d string")
    with pytest.warns(UserWarning):
        ids = [r.id for r in S.in_temporal_order(df, "d").collect()]
    assert ids == [2, 3, 1]
    with pytest.raises(ValueError):
        S.in_temporal_order(df.withColumn("d", F.lit(None).cast("string")), "d")


def test_downsampling(spark, cohort):
    out = S.downsample_controls(cohort, ["Incident"], 2.0, target_col="target")
    n = {r.target: r["count"] for r in out.groupBy("target").count().collect()}
    assert n == {"Controls": 120, "Incident": 60}
    whole = S.downsample_controls(cohort, ["Incident"], 100.0, target_col="target")
    assert whole.count() == cohort.count()


def test_row_filters(spark):
    rows = [
        ("Controls", None, 50.0, 25.0), ("Controls", "2020-01-01", 50.0, 25.0),
        ("Incident", "2020-01-01", None, 25.0), ("Incident", "2020-01-01", 40.0, 22.0),
        ("Controls", "2020-01-01", None, None),
    ]
    df = spark.createDataFrame(rows, f"{P.TARGET} string, {P.EVENT_DATE} string, age double, BMI double")
    assert P.filter_rows(df).count() == 2
    audit = P.filter_audit(df).first()
    assert (audit.n_in, audit.n_removed_uncertain_controls, audit.n_removed_dropna_meta_num, audit.n_out) == (5, 2, 1, 2)


def test_roles_and_validation(spark):
    roles = P.resolve_roles(["eid", "age", "sex", "b_resid", "a_resid"])
    assert roles.features == ["b_resid", "a_resid"] and roles.numeric == ["age"]
    with pytest.raises(ValueError):
        P.resolve_roles(["eid", "age"])
    with pytest.raises(ValueError):
        P.resolve_roles(["a_resid"], "explicit", numeric=["age"])
    bad = spark.createDataFrame([("1", "Other")], f"{P.ID} string, {P.TARGET} string")
    with pytest.raises(ValueError, match="invalid target"):
        P.validate_cohort(bad)
    with pytest.raises(ValueError):
        P.validate_binary(spark.createDataFrame([(2,)], "y int"), "y")
    with pytest.raises(ValueError):
        P.scenario_labels("Nope")


def test_melt_turns_nan_into_null(spark):
    df = spark.createDataFrame([(1, float("nan"), 2.0)], "id int, a_resid double, b_resid double")
    rows = {r.feature: r.value for r in P.melt_columns(df, ["a_resid", "b_resid"], ["id"]).collect()}
    assert rows == {"a_resid": None, "b_resid": 2.0}


def test_preprocessor_drops_first_level_and_unknown(spark):
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (5.0, "c")], "n double, c string")
    fitted = P.preprocessor(df, ["n"], ["c"]).fit(df)
    new = spark.createDataFrame([(3.0, "a"), (3.0, "c"), (3.0, "zzz")], "n double, c string")
    got = [r.v for r in fitted.transform(new).select(vector_to_array("features").alias("v")).collect()]
    assert got == [[0.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]]


def test_csv_and_parquet_sources(spark, tmp_path):
    path = str(tmp_path / "cohort.csv")
    with open(path, "w") as f:
        f.write("eid,CeD_comparison,age,x_resid,note\n1,Controls,50,0.5,a\n2,Incident,,1.5,b\n")
    df = Q.read_cohort(spark, path)
    assert df.columns == ["eid", "CeD_comparison", "age", "x_resid"]
    assert dict(df.dtypes)["x_resid"] == "double"
    Q.csv_to_parquet(spark, path, compression="gzip")
    assert Q.preferred_path(spark, path).endswith(".parquet")
    assert Q.read_cohort(spark, path).orderBy("eid").collect() == df.orderBy("eid").collect()
    with pytest.raises(ValueError):
        Q.read_cohort(spark, str(tmp_path / "x.txt"))
    with pytest.raises(FileNotFoundError):
        Q.read_cohort(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        Q.csv_to_parquet(spark, path, compression="rar")


def test_split_catalog_rules(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "cat"))
    rows = spark.createDataFrame(
        [("S", 0, "TRAIN", 1), ("S", 0, "TEST", 2)],
        "scenario string, split_seed int, split string, id bigint",
    )
    assert catalog.save_splits(rows) is True
    assert catalog.save_splits(rows) is False
    changed = rows.withColumn("id", F.col("id") + 10)
    with pytest.raises(FileExistsError):
        catalog.save_splits(changed)
    assert catalog.save_splits(changed, overwrite=True)
    assert {r.id for r in catalog.load_splits("S", 0).collect()} == {11, 12}
    catalog.save_holdout(rows, "S")
    assert catalog.load_holdout("S").count() == 2
    assert catalog.load_split_metadata("S") is None


def test_result_sinks(spark, tmp_path):
    from riskloom.operators import dca, thresholds as T

    catalog = Catalog(spark, str(tmp_path / "results"))
    rows = [("m", i, int(i % 3 == 0), (i % 10) / 10.0 + 0.01) for i in range(60)]
    pred = spark.createDataFrame(rows, "model string, id bigint, y_true int, y_prob double")
    catalog.save_thresholds(T.threshold_bundle(pred, ["model"]))
    assert {r.kind for r in catalog.read("thresholds", model="m").collect()} == {"youden", "spec_target"}
    catalog.save_decision_curve(dca.decision_curve(pred, ["model"], [0.1, 0.2, 0.3]), ["model"])
    assert catalog.read("decision_summary").first().n_thresholds == 3
    metrics = spark.createDataFrame([("m", 0, 0.8)], "model string, split_seed int, auroc double")
    catalog.append_cv_metrics(metrics)
    catalog.append_cv_metrics(metrics)
    catalog.append_cv_metrics(metrics.withColumn("split_seed", F.lit(1)))
    assert catalog.read("cv_metrics").count() == 2
    folds = [
        {"fold": k, "features": ["a", "b"][: k + 1], "val_auroc": 0.7, "cv_scores": {2: 0.7, 1: 0.6}}
        for k in range(2)
    ]
    catalog.save_fold_eliminations(folds, "m")
    assert catalog.read("rfecv_summary").first().mean_optimal_size == 1.5
    consensus = catalog.read("rfecv_consensus").where("in_consensus").collect()
    assert [r.feature for r in consensus] == ["a"]
    catalog.write("stability", spark.createDataFrame([("m", "a", 1.0)], "model string, feature string, selection_fraction double"), ["model"])
    assert catalog.models_with_results(only=["m"]) == ["m"] and catalog.stability(0.5).count() == 1


def test_results_of_scenarios_models_and_seeds_stay_apart(spark, tmp_path):
    from types import SimpleNamespace

    catalog = Catalog(spark, str(tmp_path / "apart"))
    curve = spark.createDataFrame([("m", 4, 0.8), ("m", 2, 0.7)], "model string, size int, auroc_val double")
    ranking = spark.createDataFrame([("m", "a", 1)], "model string, feature string, elimination_order int")
    for _ in range(2):  # a rerun replaces its own rows
        for scenario in ("S1", "S2"):
            for seed in (0, 1):
                catalog.save_elimination(SimpleNamespace(curve=curve, ranking=ranking), seed, scenario)
                metrics = spark.createDataFrame([(scenario, "m", seed, 0.8)], "scenario string, model string, split_seed int, auroc double")
                catalog.append_cv_metrics(metrics)
            summary = spark.createDataFrame([(0, "TRAIN", 9)], "split_seed int, split string, n int")
            catalog.save_split_metadata(summary, scenario, {"scheme": "x"})
            catalog.save_holdout_metadata(summary.drop("split_seed"), scenario, {"n_in": 3})
    assert catalog.read("rfe_curve").count() == 8 and catalog.read("rfe_ranking").count() == 4
    assert catalog.elimination_ranking(scenario="S1", split_seed=1).count() == 1
    assert catalog.read("cv_metrics").count() == 4
    assert catalog.load_split_metadata("S1").count() == 1
    assert catalog.read("holdout_metadata", scenario="S2").first().settings == {"n_in": "3"}
