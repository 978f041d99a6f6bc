"""Thresholds and decision curves (families H, J)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import curves, dca, discrimination as D, thresholds as T
from riskloom.queries.metrics import AUROC, K, KEYS, SENS95, YOUDEN
from riskloom.queries.registry import (
    COARSE_SQL,
    EVENTS_SQL,
    PREDICTIONS_SQL,
    Tables,
    query,
    roc_sql,
    rounded,
)

F1 = "COALESCE(2 * prec * tpr / NULLIF(prec + tpr, 0), 0)"
YOUDEN_THR = "CASE WHEN MAX(tpr - fpr) > 0 THEN ARG_MAX(score, ROW(tpr - fpr, score)) ELSE 0.5 END"


def spec_thr(target: float) -> str:
    ok = f"kept AND 1 - fpr >= {target} AND tp > 0"
    return f"COALESCE(ARG_MAX(score, ROW(tp, score)) FILTER ({ok}), MAX(score) + 1e-12)"


def _threshold(value: str, objective: str, base: str = COARSE_SQL) -> str:
    return f"""WITH {base}, {roc_sql(K)}
SELECT {K}, '{objective}' AS objective, ROUND({value}, 12) AS threshold FROM roc GROUP BY {K}"""


def _chosen(t: Tables, objective: str | None, **kw):
    return rounded(T.choose_threshold(t.coarse_predictions(), KEYS, objective, **kw), 12)


@query("operating_points_by_model_and_split", f"""WITH {PREDICTIONS_SQL}, {roc_sql(K)}, a AS (
  SELECT {K}, {AUROC} AS auroc, {YOUDEN} AS youden, {SENS95} AS sens95, {YOUDEN_THR} AS threshold
  FROM roc GROUP BY {K}),
c AS (SELECT {K}, SUM(CASE WHEN y_prob >= threshold THEN y_true ELSE 0 END) AS tp,
        SUM(CASE WHEN y_prob >= threshold THEN 1 - y_true ELSE 0 END) AS fp
      FROM pred JOIN a USING ({K}) GROUP BY {K})
SELECT {K}, ROUND(auroc, 9) AS auroc, ROUND(youden, 9) AS youden,
       ROUND(sens95, 9) AS sensitivity_at_95, ROUND(threshold, 9) AS threshold,
       CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp
FROM a JOIN c USING ({K})""")
def _flagship(t: Tables):
    roc = curves.roc_table(t.predictions(), KEYS)
    # tp and fp at the chosen score stand in the same ROC row, so no second pass.
    best = F.max_by(
        F.struct("tp", "fp"), F.struct(F.col("tpr") - F.col("fpr"), F.col("score"))
    )
    out = roc.groupBy(*KEYS).agg(
        curves.only_two_class(curves.auroc_of_roc()).alias("auroc"),
        curves.only_two_class(curves.youden_of_roc()).alias("youden"),
        curves.only_two_class(curves.sensitivity_at_specificity_of_roc(0.95)).alias(
            "sensitivity_at_95"
        ),
        T.youden_threshold_of_roc().alias("threshold"),
        best.alias("best"),
    )
    return rounded(out.select("*", "best.tp", "best.fp").drop("best"))


@query("threshold_max_f1", _threshold(f"ARG_MAX(score, ROW(ROUND({F1}, 14), -score))", "max_f1"))
def _max_f1(t: Tables):
    return _chosen(t, "max_f1")


@query("threshold_max_fbeta", _threshold(
    "ARG_MAX(score, ROW(ROUND(COALESCE(5.0 * prec * tpr / NULLIF(4.0 * prec + tpr, 0), 0), 14), -score))",
    "max_fbeta"))
def _max_fbeta(t: Tables):
    return _chosen(t, "max_fbeta", fbeta=2.0)


@query("threshold_youden", _threshold(YOUDEN_THR, "youden"))
def _youden(t: Tables):
    return _chosen(t, None)


@query("threshold_fixed_specificity", _threshold(spec_thr(0.9), "fixed_spec"))
def _fixed_spec(t: Tables):
    return _chosen(t, "fixed_spec", fixed_spec=0.9)


@query("threshold_fixed_precision", _threshold(
    f"COALESCE(MAX(CASE WHEN prec >= 0.34 THEN score END), ARG_MAX(score, ROW({F1}, -score)))",
    "fixed_ppv"))
def _fixed_ppv(t: Tables):
    return _chosen(t, "fixed_ppv", fixed_ppv=0.34)


@query("threshold_from_controls", f"""WITH {COARSE_SQL}
SELECT {K}, LIST_SORT(LIST(y_prob))[CAST(CEIL(CAST('0.9' AS DOUBLE) * (COUNT(*) - 1)) AS BIGINT) + 1] AS threshold
FROM pred WHERE y_true = 0 GROUP BY {K}""")
def _from_controls(t: Tables):
    return T.threshold_from_controls(t.coarse_predictions(), KEYS, 0.9)


_RATES = """ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0), 9) AS precision,
       ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0), 9) AS sensitivity,
       ROUND(COALESCE(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 9) AS f1,
       ROUND(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 9) AS specificity,
       ROUND(1 - CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 9) AS fpr"""


def _confusion(keys: str, source: str) -> str:
    return f"""cm AS (SELECT {keys}, COUNT(*) FILTER (y_prob >= threshold AND y_true = 1) AS tp,
  COUNT(*) FILTER (y_prob >= threshold AND y_true = 0) AS fp,
  COUNT(*) FILTER (y_prob < threshold AND y_true = 0) AS tn,
  COUNT(*) FILTER (y_prob < threshold AND y_true = 1) AS fn FROM {source} GROUP BY {keys})"""


@query("confusion_at_threshold", f"""WITH {COARSE_SQL},
held AS (SELECT *, CAST(0.5 AS DOUBLE) AS threshold FROM pred), {_confusion(K + ", threshold", "held")}
SELECT {K}, threshold, tp, fp, tn, fn, {_RATES} FROM cm""")
def _confusion_at(t: Tables):
    return rounded(T.metrics_at_threshold(t.coarse_predictions(), KEYS, 0.5))


@query("multi_target_specificity", f"""WITH {COARSE_SQL}, {roc_sql(K)}, thr AS (
  {" UNION ALL ".join(f"SELECT {K}, CAST({s} AS DOUBLE) AS target_spec, {spec_thr(s)} AS threshold FROM roc GROUP BY {K}" for s in (0.9, 0.95, 0.99))}),
{_confusion(K + ", target_spec, threshold", f"pred JOIN thr USING ({K})")}, rates AS (
SELECT *, {_RATES} FROM cm)
SELECT {K}, target_spec, ROUND(threshold, 12) AS threshold, sensitivity, precision, specificity
FROM rates""")
def _multi_target(t: Tables):
    out = T.multi_target_specificity(t.coarse_predictions(), KEYS, [0.9, 0.95, 0.99])
    return rounded(out, 9).withColumn("threshold", F.round("threshold", 12))


_GRID = [0.3, 0.32, 0.34, 0.36, 0.38]
_GRID_SQL = "grid(threshold) AS (SELECT UNNEST([" + ", ".join(f"CAST('{g!r}' AS DOUBLE)" for g in _GRID) + "]))"


def _dca(keys: str, grid_sql: str) -> str:
    return f"""{grid_sql}, {_confusion(keys + ", threshold", "pred CROSS JOIN grid")},
dca AS (SELECT *, CAST(tp AS DOUBLE) / n - CAST(fp AS DOUBLE) / n * (threshold / (1 - threshold)) AS nb,
  CAST(tp + fn AS DOUBLE) / n - (1 - CAST(tp + fn AS DOUBLE) / n) * (threshold / (1 - threshold)) AS nb_all
  FROM (SELECT *, tp + fp + tn + fn AS n FROM cm))"""


def linspace_sql(grid: list[float]) -> str:
    return "grid(threshold) AS (SELECT UNNEST([" + ", ".join(f"CAST('{g!r}' AS DOUBLE)" for g in grid) + "]))"


_WIDE = dca.dca_thresholds(0.01, 0.6, 0.01)
_SPLIT_DCA = _dca(K, linspace_sql(_WIDE))


@query("decision_curve", f"""WITH {PREDICTIONS_SQL}, {_SPLIT_DCA}
SELECT {K}, ROUND(threshold, 9) AS threshold, ROUND(threshold * 100, 9) AS threshold_pct,
       ROUND(nb, 9) AS net_benefit_model, ROUND(nb_all, 9) AS net_benefit_all,
       CAST(0 AS DOUBLE) AS net_benefit_none,
       ROUND(CASE WHEN nb_all > 0 THEN nb / nb_all END, 6) AS relative_utility, tp, fp, tn, fn,
       tp + fp AS n_treat, ROUND(CAST(tp AS DOUBLE) / (tp + fn), 9) AS sensitivity,
       ROUND(CAST(tn AS DOUBLE) / (tn + fp), 9) AS specificity FROM dca""")
def _decision_curve(t: Tables):
    out = rounded(dca.decision_curve(t.predictions(), KEYS, _WIDE))
    return out.withColumn("relative_utility", F.round("relative_utility", 6))


@query("net_benefit_at_threshold", f"""WITH {COARSE_SQL}, grid(threshold) AS (SELECT CAST('0.3' AS DOUBLE)),
{_dca(K, "unused AS (SELECT 1)")}
SELECT {K}, ROUND(nb, 9) AS net_benefit FROM dca""")
def _net_benefit(t: Tables):
    return rounded(dca.net_benefit(t.coarse_predictions(), KEYS, 0.3))


@query("treat_all_net_benefit", f"""WITH {COARSE_SQL}, {linspace_sql(dca.dca_thresholds(prevalence=0.3))},
r AS (SELECT {K}, AVG(y_true) AS prev FROM pred GROUP BY {K})
SELECT {K}, ROUND(threshold, 9) AS threshold,
       ROUND(prev - (1 - prev) * (threshold / (1 - threshold)), 9) AS net_benefit
FROM r CROSS JOIN grid""")
def _treat_all(t: Tables):
    rates = t.coarse_predictions().groupBy(*KEYS).agg(F.avg("y_true").alias("prev"))
    grid = F.array(*[F.lit(g) for g in dca.dca_thresholds(prevalence=0.3)])
    rows = rates.withColumn("threshold", F.explode(grid))
    benefit = dca.treat_all_benefit(F.col("prev"), F.col("threshold"))
    return rounded(rows.select(*KEYS, "threshold", benefit.alias("net_benefit")))


_CROSSING = """x AS (SELECT *, LEAD(threshold) OVER w AS t2, LEAD(nb) OVER w AS nb2 FROM dca
  WINDOW w AS (PARTITION BY {keys} ORDER BY threshold)),
zero AS (SELECT {keys}, ARG_MAX(CASE WHEN t2 IS NULL OR nb2 = nb THEN threshold
         ELSE threshold + (t2 - threshold) * (-nb / (nb2 - nb)) END, threshold) FILTER (nb > 0) AS threshold
  FROM x GROUP BY {keys})"""


@query("dca_zero_crossing", f"""WITH {PREDICTIONS_SQL}, {_SPLIT_DCA}, {_CROSSING.format(keys=K)}
SELECT {K}, ROUND(threshold, 9) AS threshold FROM zero""")
def _zero_crossing(t: Tables):
    return rounded(dca.zero_crossing_of_predictions(t.predictions(), KEYS, _WIDE))


@query("dca_curve_sign_change", f"""WITH {PREDICTIONS_SQL}, {_SPLIT_DCA},
x AS (SELECT *, LEAD(threshold) OVER w AS t2, LEAD(nb) OVER w AS nb2 FROM dca
  WINDOW w AS (PARTITION BY {K} ORDER BY threshold)),
a AS (SELECT {K}, COUNT(*) FILTER (SIGN(nb) <> SIGN(nb2)) AS changes,
  ARG_MIN(CASE WHEN ABS(nb2 - nb) > 1e-10 THEN threshold + (0 - nb) * (t2 - threshold) / (nb2 - nb) END, threshold)
    FILTER (SIGN(nb) <> SIGN(nb2)) AS first_cross,
  ARG_MIN(threshold, ROW(ABS(nb), threshold)) AS near, MIN(ABS(nb)) AS near_nb FROM x GROUP BY {K})
SELECT {K}, ROUND(CASE WHEN changes > 0 THEN first_cross WHEN near_nb < 0.05 THEN near END, 9) AS threshold
FROM a""")
def _sign_change(t: Tables):
    return rounded(dca.curve_sign_change(dca.decision_curve(t.predictions(), KEYS, _WIDE), KEYS))


_TABLE_GRID = [float(v) for v in np.arange(0.005, 0.2 + 1e-12, 0.005)]


@query("decision_curve_table_by_model", f"""WITH {EVENTS_SQL},
m AS (SELECT split_seed, y_true, y_prob, 'base' AS model FROM pred
      UNION ALL SELECT split_seed, y_true, y_prob * y_prob, 'squared' FROM pred),
{_dca("split_seed, model", linspace_sql(_TABLE_GRID)).replace("FROM pred CROSS JOIN grid", "FROM m CROSS JOIN grid")}
SELECT split_seed, ROUND(threshold, 9) AS threshold, model, ROUND(nb, 9) AS net_benefit FROM dca
UNION ALL SELECT split_seed, ROUND(threshold, 9), 'treat_none', CAST(0 AS DOUBLE) FROM dca WHERE model = 'base'
UNION ALL SELECT split_seed, ROUND(threshold, 9), 'treat_all', ROUND(nb_all, 9) FROM dca WHERE model = 'base'""")
def _dca_table(t: Tables):
    pred = t.event_predictions().select("split_seed", "y_true", "y_prob")
    scores = F.array(
        F.struct(F.lit("base").alias("model"), F.col("y_prob").alias("p")),
        F.struct(F.lit("squared").alias("model"), (F.col("y_prob") * F.col("y_prob")).alias("p")),
    )
    rows = pred.select("split_seed", "y_true", F.inline(scores)).withColumnRenamed("p", "y_prob")
    return rounded(dca.decision_curve_table(rows, ["split_seed"]))


def _point_sql(point: float) -> str:
    name = f"{point * 100:.1f}".replace(".", "p") + "pct"
    near = f"ABS(threshold - {point}) <= 0.001 + 1e-5 * {point}"
    return (
        f"ROUND(ARG_MIN(nb, threshold) FILTER ({near}), 9) AS nb_model_at_{name}, "
        f"ROUND(ARG_MIN(nb_all, threshold) FILTER ({near}), 9) AS nb_all_at_{name}"
    )


@query("dca_summary", f"""WITH {PREDICTIONS_SQL}, {_SPLIT_DCA},
x AS (SELECT *, threshold - LAG(threshold) OVER w AS dt, LAG(nb) OVER w AS nb0, LAG(nb_all) OVER w AS a0
  FROM dca WINDOW w AS (PARTITION BY {K} ORDER BY threshold))
SELECT {K}, COUNT(*) AS n_thresholds, ROUND(MIN(threshold), 9) AS threshold_min,
  ROUND(MAX(threshold), 9) AS threshold_max,
  ROUND(MIN(threshold) FILTER (nb > nb_all), 9) AS model_beats_all_from,
  ROUND(MAX(threshold) FILTER (nb > nb_all), 9) AS model_beats_all_to,
  ROUND(MIN(threshold) FILTER (nb > 0), 9) AS model_beats_none_from,
  ROUND(MAX(threshold) FILTER (nb > 0), 9) AS model_beats_none_to,
  ROUND(SUM(dt * (nb + nb0) / 2), 9) AS integrated_nb_model,
  ROUND(SUM(dt * (nb_all + a0) / 2), 9) AS integrated_nb_all,
  ROUND(SUM(dt * (nb + nb0) / 2) - SUM(dt * (nb_all + a0) / 2), 9) AS integrated_nb_improvement,
  {", ".join(_point_sql(p) for p in (0.1, 0.2, 0.3))}
FROM x GROUP BY {K}""")
def _dca_summary(t: Tables):
    curve = dca.decision_curve(t.predictions(), KEYS, _WIDE)
    return rounded(dca.dca_summary(curve, KEYS, (0.1, 0.2, 0.3)))


@query("decision_curve_per_split", f"""WITH {PREDICTIONS_SQL}, {_dca("model", linspace_sql(dca.dca_thresholds()))}
SELECT model, ROUND(threshold, 9) AS threshold, ROUND(nb, 9) AS net_benefit_model,
       ROUND(nb_all, 9) AS net_benefit_all FROM dca""")
def _dca_default(t: Tables):
    curve = dca.decision_curve(t.predictions(), ["model"])
    return rounded(curve.select("model", "threshold", "net_benefit_model", "net_benefit_all"))


@query("decision_curve_band", f"""WITH {PREDICTIONS_SQL}, {_SPLIT_DCA}
SELECT model, ROUND(threshold, 9) AS threshold, ROUND(AVG(nb), 9) AS mean,
  ROUND(STDDEV_POP(nb), 9) AS sd, ROUND(QUANTILE_CONT(nb, 0.025), 9) AS lower,
  ROUND(QUANTILE_CONT(nb, 0.975), 9) AS upper, COUNT(*) AS n_splits
FROM dca GROUP BY model, dca.threshold""")
def _dca_band(t: Tables):
    return rounded(dca.decision_curve_band(t.predictions(), ["model"], "split_seed", _WIDE))


@query("threshold_bundle", f"""WITH {PREDICTIONS_SQL}, {roc_sql("model")},
{_dca("model", linspace_sql(_WIDE)).replace("cm AS", "cm0 AS").replace("FROM cm)", "FROM cm0)")},
{_CROSSING.format(keys="model")}, thr AS (
  SELECT model, 'youden' AS kind, {YOUDEN_THR} AS threshold FROM roc GROUP BY model
  UNION ALL SELECT model, 'spec_target', {spec_thr(0.95)} FROM roc GROUP BY model
  UNION ALL SELECT model, 'dca', threshold FROM zero WHERE threshold IS NOT NULL),
{_confusion("model, kind, threshold", "pred JOIN thr USING (model)")}
SELECT model, kind, ROUND(threshold, 9) AS threshold, tp, fp, tn, fn, {_RATES} FROM cm""")
def _threshold_bundle(t: Tables):
    pred = t.predictions()
    crossing = dca.zero_crossing_of_predictions(pred, ["model"], _WIDE)
    return rounded(T.threshold_bundle(pred, ["model"], 0.95, crossing))


@query("top_risk_capture", f"""WITH {EVENTS_SQL},
f(frac) AS (SELECT UNNEST([CAST('0.01' AS DOUBLE), CAST('0.05' AS DOUBLE), CAST('0.1' AS DOUBLE)])),
r AS (SELECT model, y_true, ROW_NUMBER() OVER (PARTITION BY model ORDER BY y_prob DESC, id) AS rn,
  COUNT(*) OVER (PARTITION BY model) AS n, SUM(y_true) OVER (PARTITION BY model) AS cases FROM pred),
k AS (SELECT *, CAST(GREATEST(1, LEAST(n, CEIL(frac * n))) AS BIGINT) AS n_top FROM r CROSS JOIN f)
SELECT model, frac, n_top, CAST(SUM(y_true) AS BIGINT) AS cases_in_top,
  CAST(n_top - SUM(y_true) AS BIGINT) AS controls_in_top,
  ROUND(SUM(y_true) / CAST(MAX(cases) AS DOUBLE), 9) AS case_capture
FROM k WHERE rn <= n_top GROUP BY model, frac, n_top""")
def _top_risk(t: Tables):
    return rounded(T.top_risk_capture(t.event_predictions(), ["model"], (0.01, 0.05, 0.1)))
