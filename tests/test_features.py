"""Screening, correlation, panels, resampling and tails."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import tails
from riskloom.operators import corr as R, panels as N, pareto as M, resample as B, screen as S, summarize as L


def melted(spark, x, y, name="f"):
    rows = [(i, int(b), name, None if a is None else float(a)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, y int, feature string, value double")


def test_tail_values():
    # Closed forms: t with 1 and 2 degrees of freedom, F(2, 2), normal 1.96.
    assert tails.t_two_sided(np.array([1.0]), np.array([1.0]))[0] == pytest.approx(0.5)
    t = 2.0
    assert tails.t_two_sided(np.array([t]), np.array([2.0]))[0] == pytest.approx(1 - t / math.sqrt(2 + t * t))
    assert tails.f_upper(np.array([3.0]), np.array([2.0]), np.array([2.0]))[0] == pytest.approx(0.25)
    assert tails.normal_two_sided(np.array([1.959963984540054]))[0] == pytest.approx(0.05)
    assert tails.t_quantile(0.975, 4) == pytest.approx(2.7764451051977987, rel=1e-9)
    assert tails.regularized_beta(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] == pytest.approx(0.5248)


def test_mann_whitney_by_hand(spark):
    # Cases 4 5 6, controls 1 2 3: U = 9, z = (9 − 4.5 − 0.5) / sqrt(9 · 7 / 12).
    df = melted(spark, [1, 2, 3, 4, 5, 6], [0, 0, 0, 1, 1, 1])
    row = S.mann_whitney(df, min_per_group=3).first()
    z = 4 / math.sqrt(9 * 7 / 12)
    assert row.u == 9 and row.z == pytest.approx(z)
    assert row.p_value == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert S.mann_whitney(df, min_per_group=4).count() == 0
    flat = melted(spark, [1] * 6, [0, 0, 0, 1, 1, 1])
    assert S.mann_whitney(flat, min_per_group=3).first().p_value is None


def test_f_equals_t_squared(spark):
    df = melted(spark, [1.0, 2.0, 4.0, 5.0, 7.0, 6.0], [0, 0, 0, 1, 1, 1])
    f = S.f_scores(df).first()
    two = S.two_group_statistics(df).first()
    pooled_t = (two.mean1 - two.mean0) / (two.pooled_sd * math.sqrt(1 / 3 + 1 / 3))
    assert f.f_score == pytest.approx(pooled_t**2)
    assert f.p_value == pytest.approx(tails.t_two_sided(np.array([pooled_t]), np.array([4.0]))[0])


def test_median_imputation_with_outlier(spark):
    x = [None, 1.0, 2.0, 3.0, 1e12]
    got = {r.id: r.value for r in S.impute(melted(spark, x, [0] * 5)).collect()}
    assert got[0] == 2.5
    assert {r.id: r.value for r in S.impute(melted(spark, x[:4], [0] * 4), "mean").collect()}[0] == 2.0


def test_quantiles_of_skewed_values(spark):
    from riskloom.functions.ordered import exact_quantiles

    rng = np.random.default_rng(0)
    x = np.concatenate([np.full(1000, 3.25), rng.lognormal(0, 3, 2000), [1e15, -1e15]])
    df = melted(spark, x, np.zeros(len(x)))
    row = exact_quantiles(df, ["feature"], "value", [0.1, 0.5, 0.9]).first()
    assert [row.q_0, row.q_1, row.q_2] == pytest.approx(list(np.quantile(x, [0.1, 0.5, 0.9])))


def test_correlation_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    x[:, 1] += x[:, 0]
    rows = [(i, f"p{j}", float(x[i, j])) for i in range(60) for j in range(3)]
    df = spark.createDataFrame(rows, "id bigint, feature string, value double")
    got = {(r.feature_i, r.feature_j): r.r for r in R.correlation(df, ["p0", "p1", "p2"], "pearson").collect()}
    expected = np.abs(np.corrcoef(x.T))
    assert got[("p0", "p1")] == pytest.approx(expected[0, 1])
    ranks = np.argsort(np.argsort(x, axis=0), axis=0)
    spearman = {(r.feature_i, r.feature_j): r.r for r in R.correlation(df, ["p0", "p1", "p2"]).collect()}
    assert spearman[("p0", "p2")] == pytest.approx(abs(np.corrcoef(ranks.T)[0, 2]))


def test_components_of_a_long_path(spark):
    names = [f"v{i:03d}" for i in range(60)]
    vertices = spark.createDataFrame([(n,) for n in [*names, "z"]], "feature string")
    pairs = spark.createDataFrame(
        [(a, b, 0.9) for a, b in zip(names, names[1:])], "feature_i string, feature_j string, r double"
    )
    rows = R.connected_components(vertices, R.correlation_graph(pairs, 0.8)).collect()
    assert {r.component for r in rows if r.feature != "z"} == {"v000"}
    assert [r.component for r in rows if r.feature == "z"] == ["z"]


def test_prune_and_refill(spark):
    pairs = spark.createDataFrame(
        [("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.1), ("c", "d", 0.85), ("a", "d", 0.0),
         ("b", "d", 0.0), ("a", "e", 0.0), ("b", "e", 0.0), ("c", "e", 0.0), ("d", "e", 0.0)],
        "feature_i string, feature_j string, r double",
    )
    freq = spark.createDataFrame(
        [("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.6), ("e", 0.5)], "feature string, selection_freq double"
    )
    table, panel = R.prune_and_refill(["a", "b", "c", "d", "e"], pairs, freq, 3, 0.8)
    assert panel == ["a", "c", "e"]
    assert {r.feature: r.removed_for for r in table.collect()}["b"] == "a"
    assert R.greedy_refill(["a", "c"], ["b"], set(), 1) == ["a"]


def test_refill_in_chunks_equals_one_walk(spark, monkeypatch):
    monkeypatch.setattr("riskloom.operators.corr.CHUNK", 7)
    rng = np.random.default_rng(11)
    ranked = [f"f{i:03d}" for i in rng.permutation(80)]
    edges = [(a, b, float(rng.random())) for a in ranked for b in ranked if a < b and rng.random() < 0.3]
    # Pairs may name their features in either order.
    rows = [(a, b, r) if rng.random() < 0.5 else (b, a, r) for a, b, r in edges]
    pairs = spark.createDataFrame(rows, "feature_i string, feature_j string, r double")
    conflicts = {(a, b) for a, b, r in edges if r >= 0.5}
    for kept, size in (([], 25), (ranked[:3], 12), (ranked[:3], 2), ([], 200)):
        want = R.greedy_refill(kept, ranked, conflicts, size)
        assert R._refill_in_chunks(kept, ranked, pairs, 0.5, size) == want


def test_selection_log_by_hand(spark):
    log = spark.createDataFrame(
        [(0, '["A","B","A"]'), (0, '["A","C"]'), (1, '["A","B"]'), (1, '["B","C"]'), (1, "oops")],
        "repeat int, j string",
    )
    parsed = N.parse_selections(log, "j")
    freq = {r.feature: r.selection_freq for r in N.selection_frequencies(parsed).collect()}
    assert freq == {"A": 3 / 5, "B": 3 / 5, "C": 2 / 5}
    stable = {r.feature: r.selection_freq for r in N.stable_panel(parsed, 2).collect()}
    assert stable == {"A": 1.0, "B": 1.0, "C": 1.0}
    kept = N.stable_panel(parsed, 4, 0.75, fallback_top_n=1).where("kept").collect()
    assert [r.feature for r in kept] == ["A"]


def test_rank_aggregation_by_hand(spark):
    rows = spark.createDataFrame(
        [("m", "x", 1), ("m", "y", 2), ("n", "y", 1), ("n", "z", 2), ("n", "x", 4), ("n", "w", 3)],
        "model string, feature string, final_rank int",
    )
    geo = {r.feature: r for r in N.aggregate_ranks(rows).collect()}
    assert geo["x"].consensus_score == pytest.approx(1 / 2)
    assert geo["z"].m_rank == 3 and geo["z"].n_models_present == 1 and geo["z"].rank_std == 0
    borda = {r.feature: r.consensus_score for r in N.aggregate_ranks(rows, "borda").collect()}
    assert borda["x"] == pytest.approx(((3 - 1 + 1) + (5 - 4 + 1)) / 2)
    with pytest.raises(ValueError):
        N.aggregate_ranks(rows, "mean")


def test_pareto_choice(spark):
    rows = spark.createDataFrame(
        [(0, 0.9, 0.3), (1, 0.8, 0.1), (2, 0.7, 0.2), (3, 0.9, 0.4), (4, 0.85, 0.15)],
        "trial int, auroc double, brier double",
    )
    front = M.pareto_frontier(rows)
    assert {r.trial for r in front.collect()} == {0, 1, 4}
    assert M.select_trial(front, "extreme_auroc").first().trial == 0
    assert M.select_trial(front, "knee").first().trial == 4


def test_knee_and_sizes(spark):
    curve = spark.createDataFrame(
        [(100, 0.95), (50, 0.94), (25, 0.93), (10, 0.80), (5, 0.60)], "size int, auroc double"
    )
    assert M.knee_size(curve).first().knee_size == 25
    got = {r.fraction: r.size for r in M.recommended_sizes(curve).collect()}
    assert got == {0.95: 25, 0.9: 25, 0.85: 25 if 0.95 * 0.85 > 0.80 else 10}


@pytest.mark.parametrize("sizes", [[1, 1, 2, 0, 1], [30, 1, 20, 9]])
def test_drawn_counts_follow_the_sizes(sizes):
    sizes, n = np.array(sizes), np.full(4_000, 7)
    got = B.drawn_counts(np.random.default_rng(1), n, sizes)
    assert (got.sum(1) == 7).all() and got.shape == (4_000, len(sizes))
    p = sizes / sizes.sum()
    assert np.allclose(got.mean(0), 7 * p, atol=0.1)
    assert np.allclose(got.var(0), 7 * p * (1 - p), atol=0.15)


def test_replicate_metrics_equal_brute_force(spark, monkeypatch):
    """One group of many ties and another with few rows: the draws themselves are measured again."""
    monkeypatch.setattr(B, "ORDERED_CELLS", 5)
    rng = np.random.default_rng(8)
    data = [("a", round(float(s), 2), int(n), int(m)) for s, n, m in zip(
        np.unique(rng.random(300).round(2)), rng.integers(0, 4, 300), rng.integers(0, 5, 300), strict=False)]
    data += [("b", 0.1, 0, 3), ("b", 0.1001, 2, 1), ("b", 0.9, 1, 0), ("c", 0.5, 3, 0)]
    counts = spark.createDataFrame(data, "g string, score double, pos bigint, neg bigint")
    got = {(r.g, r.rep): r for r in B.replicate_metrics(counts, ["g"], 40, 3).collect()}
    # The same draws, row by row: every (replicate, cell) spreads with the same generator.
    celled = B.with_ordered_cells(counts.where("pos > 0 or neg > 0"), ["g"]).toPandas()
    assert celled[celled.g == "a"]["__c"].nunique() > 3
    for g, part in celled.groupby("g"):
        cells = part.groupby("__c")[["pos", "neg"]].sum().sort_index()
        seeds = spark.range(40).selectExpr("id as rep", f"xxhash64(3, '{g}', cast(id as int)) as s").toPandas()
        cell_seeds = {
            c: spark.range(1).selectExpr(f"xxhash64(4, '{g}', cast({c} as int)) as s").first().s for c in cells.index
        }
        draws = []
        for s in seeds.s:
            gen = B._generator(s)
            p, n = (cells[x].to_numpy() for x in ("pos", "neg"))
            draws.append([gen.multinomial(v.sum(), v / v.sum()) if v.sum() else v for v in (p, n)])
        sample = {rep: [] for rep in range(40)}
        for i, c in enumerate(cells.index):
            rows_ = part[part["__c"] == c].sort_values("score", ascending=False)
            reps = [r for r in range(40) if draws[r][0][i] or draws[r][1][i]]
            gen = B._generator(cell_seeds[c], 0)
            both = [
                B.drawn_counts(gen, np.array([draws[r][k][i] for r in reps]), rows_[x].to_numpy())
                for k, x in enumerate(("pos", "neg"))
            ]
            for j, r in enumerate(reps):
                for m, score in enumerate(rows_.score):
                    a, b = (int(x[j][m]) for x in both)
                    sample[r].append((score, a, b))
        for r, items in sample.items():
            items.sort(reverse=True)
            s = np.repeat([x[0] for x in items], [x[1] + x[2] for x in items])
            y = np.concatenate([[1] * x[1] + [0] * x[2] for x in items]).astype(int)
            assert (y.sum(), len(y) - y.sum()) == (part.pos.sum(), part.neg.sum())
            mine = got[g, r]
            if g == "c":
                assert mine.auroc is None and mine.prauc is None
                continue
            gap = s[y == 1][:, None] - s[y == 0][None, :]
            assert mine.auroc == pytest.approx((gap > 0).mean() + 0.5 * (gap == 0).mean())
            at = [(np.sum(y[s >= t]) / y.sum(), np.mean(y[s >= t]), np.sum(1 - y[s >= t]) / np.sum(1 - y)) for t in sorted(set(s), reverse=True)]
            ap = sum((b[0] - a[0]) * b[1] for a, b in zip([(0, 0, 0), *at], at, strict=False))
            assert mine.prauc == pytest.approx(ap)
            assert mine.youden == pytest.approx(max(0, max(t - f for t, _, f in at)))


def test_bootstrap_keeps_class_totals_and_repeats(spark):
    rng = np.random.default_rng(6)
    p = rng.random(300)
    y = (rng.random(300) < p).astype(int)
    rows = [(int(a), float(b)) for a, b in zip(y, p)]
    df = spark.createDataFrame(rows, "y_true int, y_prob double")
    from riskloom.operators.curves import score_counts

    counts = score_counts(df, [])
    drawn = B.resampled_counts(counts, [], ["score"], 30, seed=1)
    totals = drawn.groupBy("rep").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()
    assert len(totals) == 30 and {(r.p, r.n) for r in totals} == {(int(y.sum()), int(300 - y.sum()))}
    a = B.stratified_bootstrap_ci(df, [], n_boot=60, seed=2).first()
    b = B.stratified_bootstrap_ci(df.repartition(7), [], n_boot=60, seed=2).first()
    assert a == b and 0 < a.ci_lower < a.ci_upper < 1
    # SD over replicates is near the usual large-sample value.
    assert 0.01 < B.bootstrap_sd(df, [], 60).first().auroc_sd < 0.06
    few = B.stratified_bootstrap_ci(df.limit(3), [], n_boot=30).first()
    assert few.ci_lower is None or few.ci_lower >= 0


def test_selection_score(spark):
    df = spark.createDataFrame([("a", 0.9, 0.1, 1.0), ("b", None, None, None)],
                               "model string, auroc double, brier double, calib_slope double")
    got = {r.model: r.selection_score for r in L.with_selection_scores(df).collect()}
    assert got["a"] == pytest.approx(0.5 * 0.9 + 0.3 * 0.9 + 0.2)
    assert got["b"] == pytest.approx(0.25 + 0.3 * 0.75 + 0.2)
    custom = L.with_selection_scores(df, {"auroc": 0.7, "brier": 0.2, "slope": 0.1})
    assert {r.model: r.selection_score for r in custom.collect()}["a"] == pytest.approx(0.91)


def test_paired_comparison_needs_matching_seeds(spark):
    rows = [("m", c, s, v) for c, base in (("0.5_1", 0.8), ("0.5_5", 0.7)) for s, v in
            [(0, base), (1, base + 0.02), (2, base - 0.01 * (c == "0.5_1"))]]
    df = spark.createDataFrame(rows, "model string, config string, split_seed int, auroc double")
    row = B.paired_comparison(df).first()
    d = np.array([0.1, 0.1, 0.09])
    assert row.mean_diff == pytest.approx(d.mean())
    assert row.t_stat == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(3)))
    assert row.p_adj == pytest.approx(row.p_value * 4)


def test_absent_rows_drop_no_people(spark):
    from riskloom.operators.corr import correlation

    rng = np.random.default_rng(4)
    a = rng.normal(size=40)
    b = a + rng.normal(size=40)
    rows = [(i, "a", float(a[i])) for i in range(40)] + [(i, "b", float(b[i])) for i in range(40)]
    schema = "id long, feature string, value double"
    two = correlation(spark.createDataFrame(rows, schema), ["a", "b"], "pearson").first().r
    rows += [(i, "c", float(rng.normal())) for i in range(30)]  # ten people have no row of c
    three = correlation(spark.createDataFrame(rows, schema), ["a", "b", "c"], "pearson").collect()
    assert {(r.feature_i, r.feature_j) for r in three} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert abs(two - abs(np.corrcoef(a, b)[0, 1])) < 1e-12
    assert abs(next(r.r for r in three if r.feature_j == "b") - two) < 1e-12


def test_repeated_rows_of_a_person_count_once(spark):
    from riskloom.operators.corr import correlation

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 30))
    rows = [(i, "a", float(a[i])) for i in range(30)] + [(i, "b", float(b[i])) for i in range(30)]
    rows += [(3, "a", float(a[3]) + 2), (3, "a", None), (4, "b", float(b[4]))]  # mean, nothing, the same
    a[3] += 1
    schema = "id long, feature string, value double"
    got = correlation(spark.createDataFrame(rows, schema), ["a", "b"], "pearson").first().r
    assert got == pytest.approx(abs(np.corrcoef(a, b)[0, 1]))


def test_many_features_keep_their_names(spark):
    from riskloom.operators.prepare import melt_array

    n = 12_001
    df = spark.range(1).select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double")).alias("a"))
    for names in (None, [f"name{i}" for i in range(n)]):
        got = {r.feature: r.value for r in melt_array(df, "a", ["id"], names=names).collect()}
        assert len(got) == n
        label = (lambda i: f"f{i:04d}") if names is None else names.__getitem__
        assert all(got[label(i)] == i for i in (0, 9, 1000, 9_999, 10_000, 10_001, n - 1))


def test_paired_replicates_are_one_sample_of_both_scores(spark, monkeypatch):
    def rows_of_samples(*args, **kwargs):
        raise AssertionError("a row per replicate and pair")

    rng = np.random.default_rng(3)
    p = np.round(rng.random(900) ** 2, 2)
    y = (rng.random(900) < 0.2 + 0.5 * p).astype(int)
    data = [("ab"[i % 2], int(y[i]), float(p[i]), float(1 - p[i])) for i in range(900)]
    df = spark.createDataFrame(data, "model string, y_true int, p1 double, p2 double")
    counts = df.groupBy("model", F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg")
    )
    two = B.paired_replicate_metrics(counts, ["model"], 60, 5).toPandas()
    sums = two.groupby(["model", "rep"])["auroc"].agg(["sum", "count"])
    assert len(sums) == 120 and set(sums["count"]) == {2}
    assert sums["sum"].to_numpy() == pytest.approx(np.ones(120), abs=1e-12)
    monkeypatch.setattr(B, "resampled_counts", rows_of_samples)
    out = B.bootstrap_difference_ci(df, ["model"], "p1", "p2", n_boot=200).toPandas()
    one = B.stratified_bootstrap_ci(df, ["model"], p_col="p1", n_boot=200).toPandas().set_index("model")
    for row in out.itertuples():
        assert row.n_valid == 200 and row.ci_lower < row.difference < row.ci_upper
        # The second score mirrors the first: the difference is twice its AUROC, less one.
        assert row.ci_lower == pytest.approx(2 * one.loc[row.model, "ci_lower"] - 1, abs=0.05)
        assert row.ci_upper == pytest.approx(2 * one.loc[row.model, "ci_upper"] - 1, abs=0.05)


def test_correlation_looks_for_medians_only_where_values_are_missing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, f, float(v)) for i, row in enumerate(rng.normal(size=(40, 3))) for f, v in zip("abc", row)]
    schema = "id bigint, feature string, value double"
    calls, impute = [], R.impute
    monkeypatch.setattr(R, "impute", lambda *a, **k: calls.append(1) or impute(*a, **k))

    def spearman(rows):
        return {(r[0], r[1]): r[2] for r in R.correlation(spark.createDataFrame(rows, schema), list("abc")).collect()}

    def by_ranks(x):
        ranks = (x[:, None] > x).sum(1) + (x[:, None] == x).sum(1) / 2  # ties share the mean
        return pytest.approx(abs(np.corrcoef(ranks[:, 0], ranks[:, 1])[0, 1]), abs=1e-9)

    whole = spearman(data)
    assert not calls
    x = np.array([v for *_, v in data]).reshape(40, 3)
    assert whole["a", "b"] == by_ranks(x)
    holes = spearman([r for r in data if r[:2] != (7, "b")])
    assert calls
    x[7, 1] = np.median(np.delete(x[:, 1], 7))
    assert holes["a", "b"] == by_ranks(x)
