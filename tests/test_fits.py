"""Batched penalised fits against single fits, an independent solver and plain sums."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.operators import fits as B, linear_cv, train as M
from riskloom.operators.fits import Fit
from riskloom.session import checkpointed

NAMES = [f"x{i}" for i in range(6)]


def table(n=240, signal=1.0, seed=5):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(int)
    x = rng.normal(size=(n, 6)) * [1, 2, 0.5, 3, 1, 1] + [0, 5, -2, 0, 0, 1]
    x[:, :2] += signal * y[:, None]
    x[:, 3] = 7.0  # constant
    return y, x


def frame(spark, y, x):
    data = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(len(y))]
    df = spark.createDataFrame(data, "id bigint, y int, a array<double>").repartition(4)
    return checkpointed(M.vectors(df, "a").withColumn("member", F.array(F.pmod("id", F.lit(3)).cast("int"))))


@pytest.fixture(scope="module", params=[2_048, 40])
def packed(spark, request):
    y, x = table()
    rows = frame(spark, y, x)
    before, B.BLOCK_ROWS = B.BLOCK_ROWS, request.param  # one task, and several
    blocks = B.pack(rows, 3)
    B.BLOCK_ROWS = before
    yield rows, blocks, B.moments(blocks), y, x
    blocks.release()


def test_all_folds_and_candidates_equal_single_fits(packed):
    rows, blocks, sums, y, _ = packed
    choices = [{"C": c, "l1_ratio": r} for c in (0.02, 1.0, 50.0) for r in (0.1, 0.9)]
    n = len(y)
    fits = [Fit(0, g, 1 / (c["C"] * n), c["l1_ratio"]) for g in range(3) for c in choices]
    got = B.fit_many(blocks, sums, fits, tol=1e-10)
    for i in (0, 3, 7, 17):
        g, choice = divmod(i, len(choices))
        inside = rows.where(F.pmod("id", F.lit(3)) != g)
        single = M.classifier("LR_EN", {**choices[choice], "tol": 1e-13, "max_iter": 5000}, n)
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
        model = Pipeline(stages=[scaler, single.setFeaturesCol("scaled")]).fit(inside).stages[-1]
        assert np.abs(model.coefficients.toArray() - got.standardised[i, :-1]).max() < 1e-6
        assert abs(model.intercept - got.standardised[i, -1]) < 1e-6
    assert (got.standardised[:, 3] == 0).all()
    scored = B.fold_scores(blocks, got, {(0, 1): [6, 9]})
    for r in scored.limit(5).collect():
        x = np.array(rows.where(F.col("id") == r.id).first().features)
        want = 1 / (1 + np.exp(-(got.coefficients[[6, 9]] @ x + got.intercepts[[6, 9]])))
        assert np.allclose(want, r.scores)
    assert scored.count() == 80


def test_sums_of_folds_give_every_training_set(packed):
    _, _, sums, y, x = packed
    for g in range(3):
        inside = np.arange(len(y)) % 3 != g
        fit = Fit(0, g)
        a, b = x[inside & (y == 1)], x[inside & (y == 0)]
        gap = a.mean(0) - b.mean(0)
        ss = ((a - a.mean(0)) ** 2).sum(0) + ((b - b.mean(0)) ** 2).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            want = len(a) * len(b) / inside.sum() * gap**2 / (ss / (inside.sum() - 2))
        got = sums.f_scores(fit)
        vary = [0, 1, 2, 4, 5]
        assert np.isnan(got[3]) and np.allclose(got[vary], want[vary])
        assert sums.best(fit, 2) == frozenset(sorted(vary, key=lambda j: -want[j])[:2])
        assert np.allclose(sums.scaling(fit)[1][vary], (x[inside].std(0, ddof=1) / x.std(0, ddof=1).clip(1e-9))[vary])


def test_squared_hinge_with_absolute_penalty(packed):
    """The zero pattern and the values of plain proximal gradient steps."""
    _, blocks, sums, y, x = packed
    penalty = 0.15
    got = B.fit_many(blocks, sums, [Fit(penalty=penalty, ratio=1.0)], "squared_hinge", tol=1e-10)
    z = np.delete((x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0, ddof=1), 1), 3, axis=1)
    z = np.concatenate([z, np.ones((len(y), 1))], axis=1)
    n1 = y.sum()
    w = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))
    w, s = w / w.sum(), 2.0 * y - 1
    beta, lip = np.zeros(6), 2 * np.linalg.eigvalsh((z * w[:, None]).T @ z)[-1]
    for _ in range(20_000):
        slope = z.T @ (-2 * w * s * np.maximum(1 - s * (z @ beta), 0))
        new = beta - slope / lip
        new[:5] = np.sign(new[:5]) * np.maximum(np.abs(new[:5]) - penalty / lip, 0)
        beta = new
    mine = np.delete(got.standardised[0], 3)
    assert ((mine == 0) == (np.abs(beta) < 1e-9)).all() and (mine == 0).any()
    assert np.allclose(mine, beta, atol=1e-6)


def test_class_weights_are_those_of_each_training_set(packed):
    rows, blocks, sums, y, _ = packed
    base = Fit(0, 1)
    flat = rows.withColumn("weight", F.lit(1.0))
    own = B.pack(flat, 3)
    fit = linear_cv.candidate_fit(B.moments(own), base, "LR_EN", {"C": 1.0, "class_weight": "balanced"}, len(y))
    inside = y[np.arange(len(y)) % 3 != 1]
    assert fit.case == pytest.approx(len(inside) / (2 * inside.sum()))
    got = B.fit_many(own, B.moments(own), [fit], tol=1e-10).standardised[0]
    part = M.with_class_weights(flat.drop("weight").where("pmod(id, 3) <> 1"))
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    single = M.classifier("LR_EN", {"C": 1.0, "tol": 1e-13, "max_iter": 5000}, len(y)).setFeaturesCol("scaled")
    want = Pipeline(stages=[scaler, single]).fit(part).stages[-1].coefficients.toArray()
    assert np.abs(want - got[:-1]).max() < 1e-6
    with pytest.raises(ValueError, match="either all"):
        linear_cv._weighted(rows, [{"class_weight": None}, {}])
    own.release()


def test_noise_gives_no_inner_score(spark):
    """Features taken inside the inner folds cannot look good by the choice itself."""
    rng = np.random.default_rng(2)
    n, p = 120, 200
    names = [f"n{i:03d}" for i in range(p)]
    data = [(i, int(i % 3 == 0), [float(v) for v in rng.normal(size=p)]) for i in range(n)]
    rows = checkpointed(M.vectors(spark.createDataFrame(data, "id bigint, y int, a array<double>"), "a"))
    choices = [{"C": 1.0, "k": k} for k in (5, 20)]
    out = M.nested_cv(rows, names, "LR_EN", 3, 1, 3, choices, calibration="none")
    scores = [r.best_score for r in out.param_log.collect()]
    # Choosing once outside gives about 0.9 on such a table.
    assert np.mean(scores) < 0.68
    log = {r.outer_split: r.params["k"] for r in out.param_log.collect()}
    used = {r.outer_split: len(r.features) for r in out.selection_log.collect()}
    assert {o: int(k) for o, k in log.items()} == used
    assert out.coefficients.groupBy("outer_split").count().collect()[0]["count"] in (5, 20)


def test_paths_shrink_to_the_signal_and_equal_cold_fits(spark):
    y, x = table(signal=2.0)
    rows = frame(spark, y, x)
    blocks = B.pack(rows, 3)
    sums = B.moments(blocks)
    bases = [Fit(0, g, 0.01, 0.5) for g in (0, 1, B.NOBODY)]
    paths = B.elimination_paths(blocks, sums, bases, NAMES, 2, tol=1e-9)
    for base, (sets, fitted) in zip(bases, paths, strict=True):
        assert [len(s) for s in sets] == [6, 5, 4, 3, 2] and sets[-1] == {0, 1}
        assert all(b < a for a, b in zip(sets, sets[1:], strict=False))
        cold = B.fit_many(blocks, sums, [Fit(base.column, base.held_out, 0.01, 0.5, sets[2])], tol=1e-9)
        assert np.abs(cold.standardised[0] - fitted.standardised[2]).max() < 1e-6
    blocks.release()
    out = M.cross_validated_elimination(rows, rows, NAMES, NAMES, "LR_EN", {"C": 1.0}, 1)
    assert set(out["cv_scores"]) == {1, 2, 3, 4, 5, 6} and {"x0", "x1"} <= set(out["features"]) | {"x0", "x1"}
    assert out["optimal_size"] < 6 and all(out["ranking"][n] == 1 for n in out["features"])
    assert sorted(v for v in out["ranking"].values() if v > 1) == list(range(2, 6 - out["optimal_size"] + 2))


def test_one_class_folds_and_empty_lists(spark):
    y, x = table(30)
    y = (np.arange(30) % 3 == 0).astype(int)  # all cases are in fold 0
    blocks = B.pack(frame(spark, y, x), 3)
    sums = B.moments(blocks)
    assert np.isnan(sums.f_scores(Fit(0, 0))).all() and len(sums.best(Fit(0, 0), 2)) == 2
    got = B.fit_many(blocks, sums, [Fit(0, 0, 0.1, 0.5), Fit(0, 1, 0.1, 0.5)], max_passes=40)
    assert np.isfinite(got.standardised).all()
    assert B.fit_many(blocks, sums, []).coefficients.shape == (0, 6)
    blocks.release()


def test_blocks_follow_the_rows_not_the_files(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    data = [(i, i % 2, 1.0, [float(i % 7), float(i % 3)], [i % 3]) for i in range(320)]
    df = spark.createDataFrame(data, "id bigint, y int, weight double, a array<double>, member array<int>")
    df = df.coalesce(1).withColumn("features", array_to_vector("a"))
    blocks = B.pack(df, 3)
    rows = blocks.frame.select(F.spark_partition_id().alias("task"), F.size("ids").alias("n"))
    tasks = rows.groupBy("task").agg(F.sum("n").alias("n")).toPandas()
    blocks.release()
    assert tasks["n"].sum() == 320
    assert len(tasks) == blocks.tasks == spark.sparkContext.defaultParallelism
    assert tasks["n"].max() < 160
