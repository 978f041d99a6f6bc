"""Resampling and summaries across splits (families K, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import resample as B, summarize as L
from riskloom.queries.metrics import AP, AUROC, SENS95, YOUDEN, newton_sql
from riskloom.queries.operating_points import _RATES, _confusion
from riskloom.queries.registry import (
    EVENTS_SQL,
    METRICS_SQL,
    PREDICTIONS_SQL,
    Tables,
    query,
    roc_sql,
    rounded,
)


@query("bootstrap_auroc_interval")
def _bootstrap(t: Tables):
    return B.stratified_bootstrap_ci(t.event_predictions(), ["model"], "auroc", seed=7)


@query("bootstrap_difference_interval")
def _difference(t: Tables):
    rows = t.event_predictions().withColumn("other", (F.col("id") % 101) / 101.0)
    return B.bootstrap_difference_ci(rows, ["model"], "y_prob", "other")


@query("bootstrap_auroc_sd")
def _sd(t: Tables):
    return B.bootstrap_sd(t.event_predictions(), ["model"])


@query("test_set_intervals")
def _intervals(t: Tables):
    return B.test_set_intervals(t.event_predictions(), ["model"])


_PAIR_LIST = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in B.CONFIG_PAIRS)


@query("paired_comparison", f"""WITH {METRICS_SQL}, pr(config1, config2, label) AS (VALUES {_PAIR_LIST}),
d AS (SELECT a.model, config1, config2, label, a.auroc AS x, b.auroc AS y FROM pr
  JOIN metrics a ON a.config = config1 JOIN metrics b ON b.config = config2 AND b.model = a.model AND b.split_seed = a.split_seed)
SELECT model, config1, config2, label, COUNT(*) AS n, ROUND(AVG(x - y), 9) AS mean_diff,
  ROUND((AVG(x) - AVG(y)) / SQRT((VAR_POP(x) + VAR_POP(y)) / 2), 6) AS cohen_d,
  ROUND(AVG(x - y) / (STDDEV_SAMP(x - y) / SQRT(COUNT(*))), 6) AS t_stat,
  0.05 / (4 * (SELECT COUNT(DISTINCT model) FROM metrics)) AS alpha_corrected FROM d GROUP BY ALL""")
def _paired(t: Tables):
    out = B.paired_comparison(t.split_metrics()).drop("p_value", "p_adj", "significant")
    return rounded(out).withColumns({c: F.round(c, 6) for c in ("cohen_d", "t_stat")})


@query("effect_size", """WITH arm AS (SELECT l_linestatus AS model, l_returnflag AS arm, AVG(l_quantity) AS m,
  VAR_POP(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT model, ROUND((ARG_MIN(m, arm) - ARG_MAX(m, arm)) / SQRT(AVG(v)), 9) AS effect_size FROM arm GROUP BY model""")
def _effect(t: Tables):
    rows = t.lineitem.where(F.col("l_returnflag") != "N").withColumnRenamed("l_linestatus", "model")
    return rounded(B.effect_size(rows, ["model"], "l_returnflag", "l_quantity"))


@query("factorial_summary", f"""WITH {METRICS_SQL},
m AS (SELECT config, model, UNNEST(['auroc', 'brier']) AS metric, UNNEST([auroc, brier]) AS v FROM metrics)
SELECT config, model, metric, ROUND(AVG(v), 9) AS mean, ROUND(STDDEV_SAMP(v), 9) AS sd, COUNT(*) AS n,
  ROUND(AVG(v) - CAST('2.7764451051977987' AS DOUBLE) * STDDEV_SAMP(v) / SQRT(COUNT(*)), 9) AS ci_lower,
  ROUND(AVG(v) + CAST('2.7764451051977987' AS DOUBLE) * STDDEV_SAMP(v) / SQRT(COUNT(*)), 9) AS ci_upper
FROM m GROUP BY ALL""")
def _factorial(t: Tables):
    return rounded(B.factorial_summary(t.split_metrics(), ["auroc", "brier"]))


_CASES = f"""{EVENTS_SQL.replace("pred AS (", "ev AS (")},
pred AS (SELECT model, CASE WHEN category = 'Incident' THEN 1 ELSE 0 END AS y_true, y_prob FROM ev
  WHERE category <> 'Controls'), {roc_sql("model")},
mw AS (SELECT model, CAST(MAX(n_pos) AS BIGINT) AS n_incident, CAST(MAX(n_neg) AS BIGINT) AS n_prevalent,
  SUM(pos * (n_neg - fp + neg / CAST(2 AS DOUBLE))) AS mw_stat, MAX(ABS(tpr - fpr)) AS ks_stat FROM roc GROUP BY model),
ds AS (SELECT model, AVG(y_prob) FILTER (y_true = 1) AS m1, AVG(y_prob) FILTER (y_true = 0) AS m2,
  QUANTILE_CONT(y_prob, 0.5) FILTER (y_true = 1) AS d1, QUANTILE_CONT(y_prob, 0.5) FILTER (y_true = 0) AS d2,
  VAR_SAMP(y_prob) FILTER (y_true = 1) AS v1, VAR_SAMP(y_prob) FILTER (y_true = 0) AS v2,
  STDDEV_POP(y_prob) FILTER (y_true = 1) AS s1, STDDEV_POP(y_prob) FILTER (y_true = 0) AS s2 FROM pred GROUP BY model),
cmp AS (SELECT *, SQRT(((n_incident - 1) * v1 + (n_prevalent - 1) * v2) / (n_incident + n_prevalent - 2)) AS sp
  FROM mw JOIN ds USING (model))"""


@query("compare_case_types", f"""WITH {_CASES}
SELECT model, n_incident, n_prevalent, ROUND(mw_stat, 3) AS mw_stat, ROUND(ks_stat, 9) AS ks_stat,
  ROUND(m1, 9) AS incident_mean, ROUND(m2, 9) AS prevalent_mean, ROUND(d1, 9) AS incident_median,
  ROUND(d2, 9) AS prevalent_median, ROUND(s1, 9) AS incident_sd, ROUND(s2, 9) AS prevalent_sd,
  ROUND(d1 - d2, 9) AS median_diff, ROUND((m1 - m2) / sp, 9) AS cohens_d,
  ROUND((m1 - m2) / (sp * SQRT(1.0 / n_incident + 1.0 / n_prevalent)), 6) AS t_stat FROM cmp""")
def _case_types(t: Tables):
    out = B.compare_case_types(t.event_predictions(), ["model"])
    keep = ("model n_incident n_prevalent mw_stat ks_stat incident_mean prevalent_mean "
            "incident_median prevalent_median incident_sd prevalent_sd median_diff cohens_d t_stat")
    out = rounded(out.select(*keep.split()))
    return out.withColumns({"t_stat": F.round("t_stat", 6), "mw_stat": F.round("mw_stat", 3)})


@query("compare_case_types_tests")
def _case_tests(t: Tables):
    out = B.compare_case_types(t.event_predictions(), ["model"])
    return out.select("model", "mw_pval", "t_pval", "ks_pval", "power")


_TYPED = f"""{EVENTS_SQL},
typed AS (SELECT model, 'incident' AS case_type, y_prob, CASE WHEN category = 'Incident' THEN 1 ELSE 0 END AS y_true
  FROM pred WHERE category <> 'Prevalent' UNION ALL
  SELECT model, 'prevalent', y_prob, CASE WHEN category = 'Prevalent' THEN 1 ELSE 0 END
  FROM pred WHERE category <> 'Incident')"""


@query("calibration_by_case_type", f"""WITH {_TYPED},
d AS (SELECT model, case_type, y_true, LN(q / (1 - q)) AS x
  FROM (SELECT *, GREATEST(LEAST(y_prob, 1 - 1e-7), 1e-7) AS q FROM typed)),
br AS (SELECT model, case_type, AVG((y_true - y_prob) ** 2) AS brier FROM typed GROUP BY ALL),
{newton_sql("d", "model, case_type", 10)}
SELECT model, case_type, ROUND(brier, 6) AS brier, ROUND(a, 6) AS calib_intercept, ROUND(b, 6) AS calib_slope
FROM n10 JOIN br USING (model, case_type)""")
def _case_calibration(t: Tables):
    return rounded(B.calibration_by_case_type(t.event_predictions(), ["model"]), 6)


@query("calibration_curve_by_case_type", f"""WITH {_TYPED},
e AS (SELECT model, case_type, LIST_SORT(LIST_DISTINCT(QUANTILE_CONT(y_prob,
  [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM typed GROUP BY ALL),
b AS (SELECT model, case_type, y_true, y_prob, GREATEST(0, LEAST(LEN(edges) - 2,
  LEN(LIST_FILTER(edges, lambda x: x <= y_prob)) - 1)) AS bin FROM typed JOIN e USING (model, case_type))
SELECT model, case_type, CAST(bin AS INTEGER) AS bin, COUNT(*) AS n, CAST(SUM(y_true) AS BIGINT) AS k,
  ROUND(AVG(y_prob), 9) AS mean_pred, ROUND(AVG(y_true), 9) AS observed_freq FROM b GROUP BY model, case_type, bin""")
def _case_curve(t: Tables):
    return rounded(B.calibration_curve_by_case_type(t.event_predictions(), ["model"]))


@query("summarize_case_type_runs")
def _case_runs(t: Tables):
    runs = B.compare_case_types(t.event_predictions(), ["model", "split_seed"])
    return B.summarize_comparisons(runs)


@query("compare_configurations")
def _configurations(t: Tables):
    rows = t.event_predictions().withColumn("run_id", F.col("split_seed"))
    runs = rows.select("run_id").distinct().withColumn("ratio", (F.col("run_id") % 2) * 4 + 1)
    return B.compare_configurations(rows, runs)


@query("summary_statistics", f"""WITH {METRICS_SQL},
m AS (SELECT model, UNNEST(['auroc', 'brier', 'calib_slope']) AS metric, UNNEST([auroc, brier, calib_slope]) AS v FROM metrics)
SELECT model, metric, ROUND(AVG(v), 9) AS mean, ROUND(STDDEV_SAMP(v), 9) AS sd,
  ROUND(AVG(v) - 1.96 * STDDEV_SAMP(v) / SQRT(COUNT(v)), 9) AS ci95_lo,
  ROUND(AVG(v) + 1.96 * STDDEV_SAMP(v) / SQRT(COUNT(v)), 9) AS ci95_hi,
  ROUND(MIN(v), 9) AS min, ROUND(MAX(v), 9) AS max, COUNT(v) AS n FROM m GROUP BY ALL""")
def _summary(t: Tables):
    return rounded(L.summary_stats(t.split_metrics(), ["auroc", "brier", "calib_slope"]))


_POOLED = f"""{PREDICTIONS_SQL}, {roc_sql("model")},
b AS (SELECT model, AVG((y_true - y_prob) ** 2) AS brier, COUNT(*) AS n, CAST(SUM(y_true) AS BIGINT) AS k FROM pred GROUP BY model),
pm AS (SELECT model, {AUROC} AS auroc, {AP} AS prauc, {YOUDEN} AS youden, {SENS95} AS sens,
  MAX(brier) AS brier, MAX(n) AS n_samples, MAX(k) AS n_positive FROM roc JOIN b USING (model) GROUP BY model)"""


@query("pooled_metrics_by_model", f"""WITH {_POOLED}
SELECT model, ROUND(auroc, 9) AS auroc, ROUND(prauc, 9) AS prauc, ROUND(youden, 9) AS youden,
  ROUND(sens, 9) AS sensitivity_at_spec, ROUND(brier, 9) AS brier, n_samples, n_positive,
  ROUND(CAST(n_positive AS DOUBLE) / n_samples, 9) AS prevalence FROM pm""")
def _pooled(t: Tables):
    return rounded(L.pooled_metrics(t.predictions()))


@query("pooled_thresholds")
def _pooled_thresholds(t: Tables):
    return L.pooled_thresholds(t.predictions())


_PARAMS_SQL = """pl AS (SELECT l_linestatus AS model, UNNEST(['C', 'penalty']) AS param,
  UNNEST([CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), l_returnflag]) AS value FROM lineitem)"""


def _params(t: Tables):
    text = F.to_json(
        F.struct(
            F.col("l_quantity").cast("int").cast("string").alias("C"),
            F.col("l_returnflag").alias("penalty"),
        )
    )
    log = t.lineitem.select(F.col("l_linestatus").alias("model"), text.alias("params"))
    return L.long_parameters(log, ["model"])


@query("long_parameters", f"WITH {_PARAMS_SQL} SELECT model, param, value, COUNT(*) AS n FROM pl GROUP BY ALL")
def _long_params(t: Tables):
    return _params(t).groupBy("model", "param", "value").agg(F.count(F.lit(1)).alias("n"))


@query("hyperparameter_summary", f"""WITH {_PARAMS_SQL},
k AS (SELECT model, param, value, COUNT(*) AS n FROM pl GROUP BY ALL),
md AS (SELECT model, param, ARG_MIN(value, ROW(-n, value)) AS mode FROM k GROUP BY ALL)
SELECT model, param, COUNT(*) AS n_values, ROUND(AVG(TRY_CAST(value AS DOUBLE)), 9) AS mean,
  ROUND(STDDEV_SAMP(TRY_CAST(value AS DOUBLE)), 9) AS sd, MIN(TRY_CAST(value AS DOUBLE)) AS min,
  MAX(TRY_CAST(value AS DOUBLE)) AS max, CASE WHEN param = 'penalty' THEN MAX(mode) END AS mode,
  CASE WHEN param = 'penalty' THEN COUNT(DISTINCT value) END AS n_unique,
  CASE WHEN param = 'penalty' THEN ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT value)), ', ') END AS values
FROM pl JOIN md USING (model, param) GROUP BY model, param""")
def _param_summary(t: Tables):
    return rounded(L.summarize_parameters(_params(t)))


@query("ensemble_coefficient_summary", f"""WITH {METRICS_SQL}
SELECT model, config AS base_model, ROUND(AVG(auroc - 0.33), 9) AS mean, ROUND(STDDEV_POP(auroc - 0.33), 9) AS sd,
  ROUND(MIN(auroc - 0.33), 9) AS min, ROUND(MAX(auroc - 0.33), 9) AS max,
  ROUND(QUANTILE_CONT(auroc - 0.33, 0.5), 9) AS median, COUNT(*) AS n_splits FROM metrics GROUP BY ALL""")
def _coefficients(t: Tables):
    rows = t.split_metrics().select(
        "model", F.col("config").alias("base_model"), (F.col("auroc") - 0.33).alias("coefficient")
    )
    return rounded(L.coefficient_summary(rows, ["model"]))


_NAMED_MODELS = "CASE WHEN config = '1.0_5' THEN 'ENSEMBLE' ELSE config END"


def _model_metrics(t: Tables):
    name = F.when(F.col("config") == "1.0_5", "ENSEMBLE").otherwise(F.col("config"))
    return t.split_metrics().groupBy(name.alias("model")).agg(
        F.avg("auroc").alias("auroc"),
        F.avg("brier").alias("prauc"),
        F.avg("brier").alias("brier"),
        F.avg("calib_slope").alias("calib_slope"),
    )


_MODELS_SQL = f"""{METRICS_SQL}, mm AS (SELECT {_NAMED_MODELS} AS model, AVG(auroc) AS auroc, AVG(brier) AS prauc,
  AVG(brier) AS brier, AVG(calib_slope) AS calib_slope FROM metrics GROUP BY 1)"""


@query("ensemble_gain", f"""WITH {_MODELS_SQL},
g AS (SELECT MAX(CASE WHEN model = 'ENSEMBLE' THEN auroc END) AS e, MAX(CASE WHEN model <> 'ENSEMBLE' THEN auroc END) AS b,
  MAX(CASE WHEN model = 'ENSEMBLE' THEN prauc END) AS p, MAX(CASE WHEN model = 'ENSEMBLE' THEN brier END) AS r FROM mm)
SELECT ROUND(e, 9) AS ensemble_auroc, ROUND(b, 9) AS best_base_auroc, ROUND(p, 9) AS ensemble_prauc,
  ROUND(r, 9) AS ensemble_brier, ROUND(e - b, 9) AS auroc_gain, ROUND(100 * (e - b) / b, 9) AS auroc_gain_percent FROM g""")
def _gain(t: Tables):
    return rounded(L.ensemble_gain(_model_metrics(t)))


@query("ensemble_aggregation_metadata")
def _ensemble_metadata(t: Tables):
    rows = t.split_metrics().select(
        F.col("config").alias("base_model"), (F.col("auroc") - 0.33).alias("coefficient")
    )
    return L.ensemble_metadata(rows, _model_metrics(t))


_SCORE = "0.5 * auroc + 0.3 * (1 - brier) + 0.2 * (1 - LEAST(ABS(calib_slope - 1), 1))"


@query("selection_scores", f"""WITH {_MODELS_SQL}
SELECT model, ROUND({_SCORE}, 9) AS selection_score FROM mm""")
def _scores(t: Tables):
    return rounded(L.with_selection_scores(_model_metrics(t)).select("model", "selection_score"))


@query("rank_models", f"""WITH {_MODELS_SQL}
SELECT model, ROUND({_SCORE}, 9) AS selection_score,
  ROW_NUMBER() OVER (ORDER BY ROUND({_SCORE}, 12) DESC, model) AS rank FROM mm""")
def _rank_models(t: Tables):
    return rounded(L.rank_models(_model_metrics(t)).select("model", "selection_score", "rank"))


@query("model_comparison_report", f"""WITH {_MODELS_SQL}
SELECT model, ROUND(auroc, 9) AS test_auroc, ROUND(brier, 9) AS test_brier, ROUND(auroc, 9) AS val_auroc,
  ROUND(brier, 9) AS val_brier, CAST(NULL AS DOUBLE) AS dca_threshold, ROUND(auroc / 2, 9) AS youden_threshold,
  ROUND(brier / 2, 9) AS spec_target_threshold, model = 'ENSEMBLE' AS is_ensemble FROM mm""")
def _comparison(t: Tables):
    metrics = _model_metrics(t).select("model", "auroc", "brier")
    kinds = F.array(
        F.struct(F.lit("youden").alias("kind"), (F.col("auroc") / 2).alias("threshold")),
        F.struct(F.lit("spec_target").alias("kind"), (F.col("brier") / 2).alias("threshold")),
    )
    thresholds = metrics.select("model", F.inline(kinds))
    return rounded(L.model_comparison(metrics, metrics, thresholds))


@query("base_model_metrics", f"""WITH {PREDICTIONS_SQL}, {roc_sql("model, split_seed")},
b AS (SELECT model, split_seed, AVG((y_true - y_prob) ** 2) AS brier FROM pred GROUP BY ALL)
SELECT model, split_seed, ROUND({AUROC}, 9) AS auroc, ROUND({AP}, 9) AS prauc, ROUND(MAX(brier), 9) AS brier
FROM roc JOIN b USING (model, split_seed) GROUP BY model, split_seed""")
def _base_models(t: Tables):
    return rounded(L.base_model_metrics(t.predictions(), ["O", "F"]))


@query("combine_learning_curves", """WITH p AS (SELECT l_linestatus AS run_group, l_suppkey % 5 AS run,
  l_linenumber * 100 AS train_size, AVG(l_discount) AS tr, AVG(l_tax) AS va FROM lineitem GROUP BY ALL)
SELECT run_group, train_size, ROUND(AVG(tr), 9) AS train_mean, ROUND(STDDEV_SAMP(tr), 9) AS train_sd,
  ROUND(QUANTILE_CONT(tr, 0.025), 9) AS train_ci_lo, ROUND(QUANTILE_CONT(tr, 0.975), 9) AS train_ci_hi,
  ROUND(AVG(va), 9) AS val_mean, ROUND(STDDEV_SAMP(va), 9) AS val_sd, ROUND(QUANTILE_CONT(va, 0.025), 9) AS val_ci_lo,
  ROUND(QUANTILE_CONT(va, 0.975), 9) AS val_ci_hi, COUNT(DISTINCT run) AS n_runs FROM p GROUP BY run_group, train_size""")
def _learning(t: Tables):
    points = t.lineitem.select(
        F.col("l_linestatus").alias("run_group"),
        (F.col("l_suppkey") % 5).alias("run"),
        (F.col("l_linenumber") * 100).alias("train_size"),
        F.col("l_discount").alias("train_score"),
        F.col("l_tax").alias("val_score"),
    )
    return rounded(L.combine_learning_curves(points, ["run_group"]))


@query("combine_tuning_trials", """WITH b AS (SELECT l_suppkey % 7 AS s, MAX(l_extendedprice * (1 - l_discount)) AS best, COUNT(*) AS n
  FROM lineitem GROUP BY 1)
SELECT COUNT(*) AS n_splits, CAST(SUM(n) AS BIGINT) AS total_trials, ROUND(AVG(best), 6) AS mean_best_value,
  ROUND(STDDEV_SAMP(best), 6) AS std_best_value, ROUND(AVG(n), 6) AS trials_per_split FROM b""")
def _trials(t: Tables):
    rows = t.lineitem.select(
        (F.col("l_suppkey") % 7).alias("split_seed"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"),
    )
    return rounded(L.combine_trials(rows), 6)


@query("holdout_metrics", f"""WITH {PREDICTIONS_SQL},
thr(kind, threshold) AS (VALUES ('primary', CAST('0.4' AS DOUBLE)), ('clin_0p5', CAST('0.5' AS DOUBLE))),
{_confusion("model, kind, threshold", "pred CROSS JOIN thr")}
SELECT model, kind, threshold, tp, fp, tn, fn, {_RATES} FROM cm""")
def _holdout(t: Tables):
    _, at = L.holdout_metrics(t.predictions(), {"primary": 0.4}, ["model"], [0.5])
    return rounded(at)


@query("holdout_metric_rows")
def _holdout_rows(t: Tables):
    row, _ = L.holdout_metrics(t.predictions(), {"primary": 0.4}, ["model"], [0.5])
    return row


_WIDE_OOF = """w AS (SELECT id, y_true, CASE WHEN id % 7 <> 0 THEN y_prob END AS y_prob_repeat0,
  CASE WHEN id % 5 <> 0 THEN y_prob * y_prob END AS y_prob_repeat1 FROM pred)"""


def _wide_oof(t: Tables):
    p = F.col("y_prob")
    return t.event_predictions().select(
        "id",
        "y_true",
        F.when(F.col("id") % 7 != 0, p).alias("y_prob_repeat0"),
        F.when(F.col("id") % 5 != 0, p * p).alias("y_prob_repeat1"),
    )


@query("stack_oof_repeats", f"""WITH {EVENTS_SQL}, {_WIDE_OOF}
SELECT id, y_true, 0 AS repeat, ROUND(y_prob_repeat0, 9) AS y_prob FROM w WHERE y_prob_repeat0 IS NOT NULL
UNION ALL SELECT id, y_true, 1, ROUND(y_prob_repeat1, 9) FROM w WHERE y_prob_repeat1 IS NOT NULL""")
def _stack(t: Tables):
    return rounded(L.stack_repeats(_wide_oof(t), ["id", "y_true"]))


@query("mean_of_oof_repeats", f"""WITH {EVENTS_SQL}, {_WIDE_OOF}
SELECT id, ROUND(LIST_AVG(LIST_FILTER([y_prob_repeat0, y_prob_repeat1], lambda v: v IS NOT NULL)), 9) AS y_prob FROM w""")
def _mean_oof(t: Tables):
    return rounded(L.fill_from_repeats(_wide_oof(t)).select("id", "y_prob"))


@query("oof_roc_band")
def _oof_band(t: Tables):
    long = L.stack_repeats(_wide_oof(t), ["id", "y_true"]).withColumn("model", F.lit("LR"))
    return L.oof_tables(long)["roc"]


@query("risk_histogram", f"""WITH {EVENTS_SQL},
s AS (SELECT model, MIN(y_prob) AS lo, MAX(y_prob) AS hi,
  CAST(LEAST(60, GREATEST(10, FLOOR(SQRT(COUNT(*))))) AS INTEGER) AS nb FROM pred GROUP BY model),
b AS (SELECT model, category, lo, hi, nb, CAST(LEAST(FLOOR((y_prob - lo) / (hi - lo) * nb), nb - 1) AS INTEGER) AS bin
  FROM pred JOIN s USING (model))
SELECT model, category, bin, ROUND(lo + bin * ((hi - lo) / nb), 9) AS bin_start,
  ROUND(lo + (bin + 1) * ((hi - lo) / nb), 9) AS bin_end, COUNT(*) AS n FROM b GROUP BY ALL""")
def _histogram(t: Tables):
    return rounded(L.risk_histogram(t.event_predictions(), ["model"]))


@query("risk_statistics_by_category", f"""WITH {EVENTS_SQL}
SELECT model, category, ROUND(AVG(y_prob), 9) AS mean, ROUND(QUANTILE_CONT(y_prob, 0.5), 9) AS median,
  ROUND(QUANTILE_CONT(y_prob, 0.75) - QUANTILE_CONT(y_prob, 0.25), 9) AS iqr, ROUND(STDDEV_POP(y_prob), 9) AS sd
FROM pred GROUP BY ALL""")
def _risk_statistics(t: Tables):
    return rounded(L.risk_distribution(t.event_predictions())["statistics"])


@query("aggregation_metadata")
def _metadata(t: Tables):
    from riskloom.operators import panels as N

    log = t.selection_log()
    stability = N.stability_over_splits(log, [])
    reports = N.aggregate_feature_reports(N.selection_frequencies(log, ["split_seed"]))
    return L.aggregation_metadata(stability, reports, t.predictions())
