"""Hand values, brute force and edge cases of metrics, thresholds and curves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import calibrate, curves, dca, discrimination as D, isotonic, thresholds as T


def frame(spark, y, p, model="m"):
    rows = [(model, i, int(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "model string, id bigint, y_true int, y_prob double")


def brute_auroc(y, p):
    y, p = np.asarray(y), np.asarray(p)
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


def test_four_rows(spark):
    df = frame(spark, [1, 0, 1, 0], [0.8, 0.6, 0.4, 0.2])
    row = D.ensemble_metrics(df, ["model"]).first()
    assert row.auroc == pytest.approx(3 / 4)
    assert row.prauc == pytest.approx(5 / 6)
    assert row.brier == pytest.approx(0.2)
    at = T.metrics_at_threshold(df, ["model"], 0.5).first()
    assert (at.tp, at.fp, at.fn, at.tn) == (1, 1, 1, 1)
    assert dca.net_benefit(df, ["model"], 0.5).first().net_benefit == pytest.approx(0.0)


def test_all_tied_is_half(spark):
    assert D.auroc(frame(spark, [1, 0], [0.5, 0.5]), ["model"]).first().auroc == 0.5


@pytest.mark.parametrize("y", [[1, 1, 1], [0, 0, 0]])
def test_single_class(spark, y):
    df = frame(spark, y, [0.1, 0.2, 0.3])
    row = D.discrimination_metrics(df, ["model"]).first()
    assert row.auroc is None and row.prauc is None and row.youden is None
    with pytest.raises(Exception, match="both classes"):
        D.auroc(df, ["model"], strict=True).collect()
    assert T.choose_threshold(df, ["model"], "youden").first().threshold == 0.5
    spec = T.choose_threshold(df, ["model"], "fixed_spec").first().threshold
    assert spec == pytest.approx(0.3 + 1e-12)


def test_empty_and_missing_scores(spark):
    df = frame(spark, [1, 0, 1, 0], [0.9, None, float("nan"), 0.1])
    row = D.ensemble_metrics(df, ["model"]).first()
    assert row.n_samples == 2 and row.auroc == 1.0
    assert D.auroc(df.where("false"), ["model"]).count() == 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_random_scores_against_brute_force(spark, partitions):
    rng = np.random.default_rng(3)
    # A third of all rows share one score; the rest crowd near zero.
    p = np.where(rng.random(3000) < 0.33, 0.25, rng.beta(0.2, 8, 3000))
    y = (rng.random(3000) < 0.1 + p).astype(int)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = frame(spark, y, p)
        assert D.auroc(df, ["model"]).first().auroc == pytest.approx(brute_auroc(y, p), abs=1e-12)
        squared = df.withColumn("y_prob", F.col("y_prob") * F.col("y_prob"))
        assert D.auroc(squared, ["model"]).first().auroc == pytest.approx(brute_auroc(y, p), abs=1e-12)
        last = D.auroc(df.withColumn("y_prob", F.col("y_prob") * 1e9 - 5), ["model"], probabilities=False)
        assert last.first().auroc == pytest.approx(brute_auroc(y, p), abs=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_no_window_over_a_whole_group(spark):
    """Row-level windows are partitioned by group and cell."""
    df = frame(spark, [1, 0], [0.4, 0.6])
    plan = curves.roc_table(df, ["model"])._jdf.queryExecution().optimizedPlan().toString()
    row_level = [line for line in plan.splitlines() if "Window" in line and "score" in line]
    assert row_level and all("__cell" in line for line in row_level)


def test_thresholds_against_brute_force(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    df = frame(spark, y, p)
    grid = np.unique(p)
    f1 = [2 * (y[p >= t]).sum() / ((p >= t).sum() + y.sum()) for t in grid]
    assert T.choose_threshold(df, ["model"], "max_f1").first().threshold == pytest.approx(grid[int(np.argmax(f1))])
    j = [y[p >= t].sum() / y.sum() - (1 - y)[p >= t].sum() / (1 - y).sum() for t in grid]
    best = T.choose_threshold(df, ["model"], "youden").first().threshold
    assert j[list(grid).index(best)] == pytest.approx(max(j))
    controls = np.sort(p[y == 0])
    expected = np.quantile(controls, 0.9, method="higher")
    assert T.threshold_from_controls(df, ["model"], 0.9).first().threshold == pytest.approx(expected)


def test_controls_quantile_by_hand(spark):
    df = frame(spark, [0, 0, 0, 0], [0.1, 0.2, 0.3, 0.4])
    assert T.threshold_from_controls(df, ["model"], 0.5).first().threshold == 0.3


def test_top_risk_breaks_ties_by_id(spark):
    df = frame(spark, [0, 1, 1, 0, 1], [0.5] * 5)
    row = T.top_risk_capture(df, ["model"], (0.4,)).first()
    assert (row.n_top, row.cases_in_top, row.controls_in_top) == (2, 1, 1)
    text = df.withColumn("id", F.concat(F.lit("p"), F.col("id").cast("string")))
    assert T.top_risk_capture(text, ["model"], (1.0,)).first().cases_in_top == 3


def test_decision_curve_bounds(spark):
    df = frame(spark, [0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 0, 0, 1, 1, 1, 1])
    rows = dca.decision_curve(df, ["model"], [0.1, 0.5, 0.9]).collect()
    assert all(r.net_benefit_model == pytest.approx(0.5) for r in rows)
    assert all(r.net_benefit_all <= r.net_benefit_model + 1e-12 for r in rows)
    with pytest.raises(ValueError):
        dca.dca_thresholds(prevalence=1.5)


def test_threshold_grids():
    grid = dca.dca_thresholds()
    assert len(grid) == 100 and grid[0] == 0.001 and grid[-1] == 0.1
    low, high = dca.dca_thresholds(prevalence=0.0034)[0], dca.dca_thresholds(prevalence=0.0034)[-1]
    assert low == pytest.approx(0.00034) and high == pytest.approx(0.034)


def test_prevalence_shift(spark):
    df = frame(spark, [1], [0.2])
    row = calibrate.adjust_for_prevalence(df, 0.2, 0.1).first()
    assert row.y_prob_adjusted == pytest.approx(0.1)
    back = calibrate.adjust_for_prevalence(
        df.withColumn("y_prob", F.lit(row.y_prob_adjusted)), 0.1, 0.2
    ).first()
    assert back.y_prob_adjusted == pytest.approx(0.2)
    assert calibrate.adjust_for_prevalence(df, 0.0, 0.1).first().y_prob_adjusted == 0.2


def test_calibration_slope_of_true_probabilities(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000)
    p = 1 / (1 + np.exp(-z))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * z)))).astype(int)
    both = frame(spark, y, p).unionByName(frame(spark, [1, 1], [0.2, 0.3], "one_class"))
    rows = {r.model: r for r in calibrate.calibration_intercept_slope(both, ["model"]).collect()}
    assert rows["m"].calib_intercept == pytest.approx(0.5, abs=0.15)
    assert rows["m"].calib_slope == pytest.approx(2.0, abs=0.25)
    assert rows["one_class"].calib_slope is None


def test_separable_group_does_not_converge(spark):
    df = frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    assert calibrate.calibration_intercept_slope(df, ["model"]).first().calib_slope is None


def test_isotonic_is_monotone_and_improves(spark):
    rng = np.random.default_rng(2)
    p = rng.random(500)
    y = (rng.random(500) < p**3).astype(int)
    df = frame(spark, y, p)
    out = calibrate.OOFCalibrator("isotonic").fit(df).transform(df, out_col="q")
    rows = out.orderBy("y_prob").select("q").collect()
    values = [r.q for r in rows]
    assert all(b >= a - 1e-12 for a, b in zip(values, values[1:]))
    assert min(values) >= 0 and max(values) <= 1
    with pytest.raises(ValueError):
        calibrate.OOFCalibrator().fit(df.limit(5))


def brute_isotonic(score, pos, neg):
    """Fitted value of each score: the largest over starts of the least mean over ends."""
    s, w = np.cumsum(np.r_[0, pos]), np.cumsum(np.r_[0, pos + neg])
    n = len(score)
    out = []
    for i in range(n):
        out.append(max(min((s[b + 1] - s[a]) / (w[b + 1] - w[a]) for b in range(i, n)) for a in range(i + 1)))
    return np.array(out)


@pytest.mark.parametrize("shape", ["rising", "falling", "noise", "flat"])
def test_blocks_of_many_ranges_equal_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr("riskloom.operators.isotonic.RANGE_SCORES", 5)
    monkeypatch.setattr("riskloom.operators.isotonic.FAN_IN", 3)
    rng = np.random.default_rng(8)
    score = np.sort(rng.normal(size=90))
    rate = {"rising": np.linspace(0, 1, 90), "falling": np.linspace(1, 0, 90)}.get(shape, np.full(90, 0.4))
    size = rng.integers(1, 9, 90)
    pos = np.zeros(90, int) if shape == "flat" else rng.binomial(size, rate)
    table = [(float(a), int(k), int(n - k)) for a, k, n in zip(score, pos, size)]
    counts = spark.createDataFrame(table, "score double, pos long, neg long").repartition(7)
    blocks = isotonic.isotonic_blocks(counts).orderBy("low").collect()
    values = [b.total / b.weight for b in blocks]
    assert all(a < b for a, b in zip(values, values[1:]))
    want = brute_isotonic(score, pos, size - pos)
    got = [next(v for b, v in zip(blocks, values) if b.low <= x <= b.high) for x in score]
    np.testing.assert_allclose(got, want, atol=1e-12)
    assert sum(b.weight for b in blocks) == size.sum()
    assert isotonic.isotonic_blocks(counts.limit(0)).count() == 0


def test_calibrator_gives_the_values_of_the_blocks(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p**2).astype(int)
    df = frame(spark, y, p)
    got = calibrate.OOFCalibrator("isotonic").fit(df).transform(df, out_col="q").collect()
    score = np.unique(p)
    pos = np.array([y[p == v].sum() for v in score])
    neg = np.array([(1 - y[p == v]).sum() for v in score])
    want = dict(zip(score, brute_isotonic(score, pos, neg)))
    assert max(abs(r.q - want[r.y_prob]) for r in got) < 1e-12


def test_calibration_is_applied_once(spark):
    df = frame(spark, [0, 1] * 10, np.linspace(0.05, 0.95, 20))
    maps = {"m": calibrate.OOFCalibrator("sigmoid").fit(df)}
    once = calibrate.apply_base_calibration(df, maps)
    twice = calibrate.apply_base_calibration(once, maps)
    assert once.orderBy("id").collect() == twice.orderBy("id").collect()


def test_pipeline_stage_round_trip(spark, tmp_path):
    stage = calibrate.PrevalenceShift(samplePrevalence=0.2, targetPrevalence=0.1)
    stage.save(str(tmp_path / "shift"))
    loaded = calibrate.PrevalenceShift.load(str(tmp_path / "shift"))
    assert loaded.transform(frame(spark, [1], [0.2])).first().y_prob_adjusted == pytest.approx(0.1)


def test_ece_uses_left_closed_bins(spark):
    df = frame(spark, [1, 0], [0.3, 1.0])
    bins = {r.bin for r in calibrate.binned_means(df, ["model"]).collect()}
    # 3 * 0.1 is larger than 0.3, so 0.3 stays in bin 2; 1.0 joins the last bin.
    assert bins == {2, 9}
    assert math.isclose(calibrate.expected_calibration_error(df, ["model"]).first().ece, (0.7 + 1.0) / 2)


def test_roc_band_is_the_curve_for_one_split(spark):
    df = frame(spark, [1, 0, 1, 0], [0.8, 0.6, 0.4, 0.2]).withColumn("split_seed", F.lit(0))
    rows = D.curve_band(df, ["model"], "split_seed", n_points=3).orderBy("x").collect()
    assert [(r.x, r.mean) for r in rows] == [(0.0, 0.0), (0.5, 1.0), (1.0, 1.0)]
