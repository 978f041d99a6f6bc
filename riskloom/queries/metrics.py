"""Discrimination, probability and calibration metrics (families G, I)."""

from __future__ import annotations

from riskloom.operators import calibrate, curves, discrimination as D, isotonic
from riskloom.queries.registry import (
    COARSE_SQL,
    EVENTS_SQL,
    PREDICTIONS_SQL,
    Tables,
    query,
    roc_sql,
    rounded,
)

KEYS = ["model", "split_seed"]
K = "model, split_seed"

AUROC = (
    "SUM(pos * (n_neg - fp + CAST(neg AS DOUBLE) / 2)) / (CAST(MAX(n_pos) AS DOUBLE) * MAX(n_neg))"
)
AP = "SUM(pos * prec) / MAX(n_pos)"
YOUDEN = "GREATEST(MAX(tpr - fpr), 0)"
SENS95 = "COALESCE(MAX(CASE WHEN kept AND 1 - fpr >= 0.95 THEN tpr END), 0)"


def _roc_metric(value: str, name: str, base: str = COARSE_SQL) -> str:
    return f"""WITH {base}, {roc_sql(K)}
SELECT {K}, ROUND({value}, 9) AS {name} FROM roc GROUP BY {K}"""


@query("roc_points", f"""WITH {COARSE_SQL}, {roc_sql(K)}
SELECT {K}, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       ROUND(tpr, 9) AS tpr, ROUND(fpr, 9) AS fpr, ROUND(prec, 9) AS precision, kept FROM roc""")
def _roc_points(t: Tables):
    roc = curves.roc_table(t.coarse_predictions(), KEYS)
    return rounded(roc.select(*KEYS, "score", "tp", "fp", "tpr", "fpr", "precision", "kept"))


@query("auroc", _roc_metric(AUROC, "auroc"))
def _auroc(t: Tables):
    return rounded(D.auroc(t.coarse_predictions(), KEYS))


@query("auroc_fine_scores", _roc_metric(AUROC, "auroc", PREDICTIONS_SQL))
def _auroc_fine(t: Tables):
    return rounded(D.auroc(t.predictions(), KEYS))


@query("average_precision", _roc_metric(AP, "prauc"))
def _prauc(t: Tables):
    return rounded(D.prauc(t.coarse_predictions(), KEYS))


@query("youden_index", _roc_metric(YOUDEN, "youden"))
def _youden(t: Tables):
    return rounded(D.youden_j(t.coarse_predictions(), KEYS))


@query("sensitivity_at_specificity", _roc_metric(SENS95, "alpha"))
def _alpha(t: Tables):
    return rounded(D.sensitivity_at_specificity(t.coarse_predictions(), KEYS, 0.95))


@query("tpr_at_fpr", _roc_metric(
    "COALESCE(MAX(CASE WHEN kept AND fpr <= 0.1 THEN tpr END), 0)", "tpr_at_fpr"))
def _tpr_at_fpr(t: Tables):
    return rounded(D.tpr_at_fpr(t.coarse_predictions(), KEYS, 0.1))


@query("discrimination_bundle", f"""WITH {PREDICTIONS_SQL}, {roc_sql(K)}
SELECT {K}, ROUND({AUROC}, 9) AS auroc, ROUND({AP}, 9) AS prauc, ROUND({YOUDEN}, 9) AS youden,
       ROUND({SENS95}, 9) AS sensitivity_at_spec
FROM roc GROUP BY {K}""")
def _bundle(t: Tables):
    return rounded(D.discrimination_metrics(t.predictions(), KEYS))


@query("brier_score", f"""WITH {PREDICTIONS_SQL}
SELECT {K}, ROUND(AVG((y_true - y_prob) * (y_true - y_prob)), 9) AS brier
FROM pred GROUP BY {K}""")
def _brier(t: Tables):
    return rounded(D.brier_score(t.predictions(), KEYS))


@query("log_loss", f"""WITH {PREDICTIONS_SQL},
c AS (SELECT *, GREATEST(LEAST(y_prob, 1 - 1e-15), 1e-15) AS q FROM pred)
SELECT {K}, ROUND(AVG(-CASE WHEN y_true = 1 THEN LN(q) ELSE LN(1 - q) END), 9) AS log_loss
FROM c GROUP BY {K}""")
def _log_loss(t: Tables):
    return rounded(D.log_loss(t.predictions(), KEYS))


@query("ensemble_metrics", f"""WITH {PREDICTIONS_SQL}, {roc_sql("model")}, m AS (
  SELECT model, AVG((y_true - y_prob) * (y_true - y_prob)) AS brier, COUNT(*) AS n_samples,
         CAST(SUM(y_true) AS BIGINT) AS n_positive FROM pred GROUP BY model)
SELECT model, ROUND({AUROC}, 9) AS auroc, ROUND({AP}, 9) AS prauc, ROUND(MAX(brier), 9) AS brier,
       MAX(n_samples) AS n_samples, MAX(n_positive) AS n_positive,
       ROUND(CAST(MAX(n_positive) AS DOUBLE) / MAX(n_samples), 9) AS prevalence
FROM roc JOIN m USING (model) GROUP BY model""")
def _ensemble(t: Tables):
    return rounded(D.ensemble_metrics(t.predictions(), ["model"]))


@query("metrics_per_cv_repeat", f"""WITH {COARSE_SQL.replace("split_seed", "repeat")},
{roc_sql("model, repeat")}, m AS (
  SELECT model, repeat, AVG((y_true - y_prob) * (y_true - y_prob)) AS brier
  FROM pred GROUP BY model, repeat)
SELECT model, repeat, ROUND({AUROC}, 9) AS auroc, ROUND({AP}, 9) AS prauc,
       ROUND(MAX(brier), 9) AS brier
FROM roc JOIN m USING (model, repeat) GROUP BY model, repeat""")
def _cv_repeat(t: Tables):
    oof = t.coarse_predictions().withColumnRenamed("split_seed", "repeat")
    return rounded(D.cv_repeat_metrics(oof, ["model"]))


@query("score_distribution", f"""WITH {PREDICTIONS_SQL}
SELECT {K}, ROUND(AVG(y_prob), 9) AS mean, ROUND(QUANTILE_CONT(y_prob, 0.5), 9) AS median,
       ROUND(QUANTILE_CONT(y_prob, 0.75) - QUANTILE_CONT(y_prob, 0.25), 9) AS iqr,
       ROUND(STDDEV_POP(y_prob), 9) AS sd
FROM pred GROUP BY {K}""")
def _distribution(t: Tables):
    return rounded(D.distribution_stats(t.predictions(), KEYS))


_BAND = """SELECT model, ROUND(x, 9) AS x, ROUND(AVG(y), 9) AS mean, ROUND(STDDEV_POP(y), 9) AS sd,
       ROUND(QUANTILE_CONT(y, 0.025), 9) AS lower, ROUND(QUANTILE_CONT(y, 0.975), 9) AS upper,
       COUNT(*) AS n_splits FROM read GROUP BY model, x"""

_GRID = "grid AS (SELECT i, CAST(i AS DOUBLE) / 119 AS x FROM RANGE(120) r(i))"


@query("roc_band_over_splits", f"""WITH {COARSE_SQL}, {roc_sql(K)}, {_GRID},
pt AS (SELECT {K}, fp, tp, n_pos, n_neg FROM roc
       UNION ALL SELECT DISTINCT {K}, 0, 0, n_pos, n_neg FROM roc),
step AS (SELECT {K}, CAST(fp AS DOUBLE) / n_neg AS x0, MAX(tp) / CAST(MAX(n_pos) AS DOUBLE) AS y0,
                MIN(tp) / CAST(MAX(n_pos) AS DOUBLE) AS ylo
         FROM pt GROUP BY {K}, fp, n_neg),
seg AS (SELECT *, LEAD(x0) OVER w AS x1, LEAD(ylo) OVER w AS y1 FROM step
        WINDOW w AS (PARTITION BY {K} ORDER BY x0)),
read AS (
  SELECT {K}, x, CASE WHEN i = 0 THEN 0 WHEN x1 IS NULL THEN y0
         ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END AS y
  FROM seg JOIN grid ON x >= x0 AND (x < x1 OR x1 IS NULL))
{_BAND}""")
def _roc_band(t: Tables):
    return rounded(D.curve_band(t.coarse_predictions(), ["model"], "split_seed", "roc"))


@query("pr_band_over_splits", f"""WITH {COARSE_SQL}, {roc_sql(K)}, {_GRID},
pt AS (SELECT {K}, tp, fp, n_pos, prec, prec AS first_prec FROM roc
       UNION ALL SELECT DISTINCT {K}, 0, 0, n_pos, 1.0, 1.0 FROM roc),
step AS (SELECT {K}, CAST(tp AS DOUBLE) / n_pos AS x0, MAX_BY(prec, fp) AS y0,
                MIN_BY(prec, fp) AS yhi
         FROM pt GROUP BY {K}, tp, n_pos),
seg AS (SELECT *, LEAD(x0) OVER w AS x1, LEAD(yhi) OVER w AS y1 FROM step
        WINDOW w AS (PARTITION BY {K} ORDER BY x0)),
read AS (
  SELECT {K}, x, CASE WHEN x1 IS NULL THEN y0
         ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END AS y
  FROM seg JOIN grid ON x >= x0 AND (x < x1 OR x1 IS NULL))
{_BAND}""")
def _pr_band(t: Tables):
    return rounded(D.curve_band(t.coarse_predictions(), ["model"], "split_seed", "pr"))


def _edges(n: int) -> str:
    """Bin number by explicit comparison with the even edges i * (1 / n)."""
    return " + ".join(
        f"CASE WHEN y_prob >= CAST('{i * (1.0 / n)!r}' AS DOUBLE) THEN 1 ELSE 0 END"
        for i in range(1, n)
    )


@query("expected_calibration_error", f"""WITH {COARSE_SQL},
b AS (SELECT {K}, {_edges(10)} AS bin, COUNT(*) AS n, AVG(y_prob) AS p, AVG(y_true) AS r
      FROM pred GROUP BY ALL)
SELECT {K}, ROUND(SUM(n * ABS(p - r)) / SUM(n), 9) AS ece FROM b GROUP BY {K}""")
def _ece(t: Tables):
    return rounded(calibrate.expected_calibration_error(t.coarse_predictions(), KEYS))


@query("calibration_curve", f"""WITH {COARSE_SQL}
SELECT {K}, {_edges(10)} AS bin, ROUND(AVG(y_prob), 9) AS bin_center,
       ROUND(AVG(y_true), 9) AS observed_freq FROM pred GROUP BY ALL""")
def _calibration_curve(t: Tables):
    return rounded(calibrate.calibration_curve(t.coarse_predictions(), KEYS))


@query("calibration_band_over_splits", f"""WITH {COARSE_SQL},
b AS (SELECT {K}, {_edges(10)} AS bin, COUNT(*) AS n, AVG(y_true) AS y FROM pred GROUP BY ALL)
SELECT model, bin, ROUND(AVG(y), 9) AS mean, ROUND(STDDEV_POP(y), 9) AS sd,
       ROUND(QUANTILE_CONT(y, 0.025), 9) AS lower, ROUND(QUANTILE_CONT(y, 0.975), 9) AS upper,
       COUNT(*) AS n_splits, CAST(SUM(n) AS BIGINT) AS n_rows FROM b GROUP BY model, bin""")
def _calibration_band(t: Tables):
    return rounded(calibrate.calibration_band(t.coarse_predictions(), ["model"], "split_seed"))


def newton_sql(source: str, keys: str, steps: int = 8) -> str:
    """Unrolled Newton steps of a logistic fit of y_true on x, as CTEs n0 … n<steps>."""
    out = [f"n0 AS (SELECT {keys}, CAST(0 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b FROM {source} GROUP BY {keys})"]
    for i in range(steps):
        out.append(f"""s{i} AS (
  SELECT {keys}, a, b, SUM(p * (1 - p)) AS w, SUM(p * (1 - p) * x) AS wx,
         SUM(p * (1 - p) * x * x) AS wxx, SUM(y_true - p) AS r, SUM((y_true - p) * x) AS rx
  FROM (SELECT {", ".join("d." + k.strip() for k in keys.split(","))}, d.x, d.y_true, n.a, n.b,
               1 / (1 + EXP(-(n.a + n.b * d.x))) AS p
        FROM {source} d JOIN n{i} n USING ({keys}))
  GROUP BY {keys}, a, b),
n{i + 1} AS (
  SELECT {keys}, a + (wxx * r - wx * rx) / (w * wxx - wx * wx) AS a,
         b + (w * rx - wx * r) / (w * wxx - wx * wx) AS b FROM s{i})""")
    return ",\n".join(out)


@query("calibration_intercept_slope", f"""WITH {PREDICTIONS_SQL},
d AS (SELECT {K}, y_true, LN(q / (1 - q)) AS x
      FROM (SELECT *, GREATEST(LEAST(y_prob, 1 - 1e-7), 1e-7) AS q FROM pred)),
{newton_sql("d", K)}
SELECT {K}, ROUND(a, 6) AS calib_intercept, ROUND(b, 6) AS calib_slope FROM n8""")
def _intercept_slope(t: Tables):
    return rounded(calibrate.calibration_intercept_slope(t.predictions(), KEYS), 6)


@query("prevalence_adjustment", f"""WITH {EVENTS_SQL},
r AS (SELECT model, AVG(y_true) AS prev FROM pred GROUP BY model)
SELECT id, model, ROUND(1 / (1 + EXP(-(LN(q / (1 - q)) + LN(CAST(0.05 AS DOUBLE) / 0.95)
       - LN(prev / (1 - prev))))), 9) AS y_prob_adjusted
FROM (SELECT *, GREATEST(LEAST(y_prob, 1 - 1e-9), 1e-9) AS q FROM pred) JOIN r USING (model)""")
def _prevalence(t: Tables):
    from pyspark.sql import functions as F

    pred = t.event_predictions()
    rates = pred.groupBy("model").agg(F.avg("y_true").alias("prev"))
    out = calibrate.adjust_for_prevalence(pred.join(rates, "model"), F.col("prev"), 0.05)
    return rounded(out.select("id", "model", "y_prob_adjusted"))


@query("prediction_summary", f"""WITH {EVENTS_SQL}
SELECT model, split_seed, COUNT(*) AS n, CAST(SUM(y_true) AS BIGINT) AS n_pos,
       ROUND(AVG(y_true), 9) AS prevalence FROM pred GROUP BY ALL""")
def _prediction_summary(t: Tables):
    return rounded(calibrate.prediction_summary(t.event_predictions(), KEYS))


@query("quantile_calibration_bins", f"""WITH {EVENTS_SQL},
e AS (SELECT model, LIST_SORT(LIST_DISTINCT(QUANTILE_CONT(y_prob,
        [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM pred GROUP BY model),
b AS (SELECT model, y_true, y_prob, GREATEST(0, LEAST(LEN(edges) - 2,
        LEN(LIST_FILTER(edges, lambda x: x <= y_prob)) - 1)) AS bin FROM pred JOIN e USING (model))
SELECT model, CAST(bin AS INTEGER) AS bin, COUNT(*) AS n, CAST(SUM(y_true) AS BIGINT) AS k,
       ROUND(AVG(y_prob), 9) AS mean_pred FROM b GROUP BY model, bin""")
def _quantile_bins(t: Tables):
    return rounded(calibrate.quantile_bins(t.event_predictions(), ["model"]))


@query("binned_logits")
def _binned_logits(t: Tables):
    return calibrate.binned_logits(t.event_predictions(), ["model"])


@query("isotonic_calibration")
def _isotonic(t: Tables):
    pred = t.event_predictions()
    fitted = calibrate.OOFCalibrator("isotonic").fit(pred)
    return fitted.transform(pred.select("id", "model", "y_true", "y_prob"))


# From each end of a block the next end is the score with the least mean up to it,
# the last of equal ones.
_BLOCKS = f"""WITH RECURSIVE {EVENTS_SQL},
c AS (SELECT y_prob AS score, SUM(y_true) AS s, COUNT(*) AS w FROM pred
      WHERE y_prob IS NOT NULL AND ISFINITE(y_prob) GROUP BY y_prob),
p AS (SELECT ROW_NUMBER() OVER o AS k, score, CAST(SUM(s) OVER o AS DOUBLE) AS s,
             CAST(SUM(w) OVER o AS DOUBLE) AS w FROM c WINDOW o AS (ORDER BY score)),
g AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS before, CAST(0 AS DOUBLE) AS s,
         CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS weight
  UNION ALL
  SELECT * FROM (SELECT p.k, g.k AS before, p.s, p.w, p.s - g.s AS total, p.w - g.w AS weight
    FROM g JOIN p ON p.k > g.k ORDER BY (p.s - g.s) / (p.w - g.w), p.k DESC LIMIT 1))
SELECT ROUND(a.score, 9) AS low, ROUND(b.score, 9) AS high, total, weight,
       ROUND(total / weight, 9) AS value
FROM g JOIN p AS a ON a.k = g.before + 1 JOIN p AS b ON b.k = g.k WHERE g.k > 0"""


@query("isotonic_blocks", _BLOCKS)
def _isotonic_blocks(t: Tables):
    blocks = isotonic.isotonic_blocks(curves.score_counts(t.event_predictions(), []))
    return rounded(blocks.withColumn("value", blocks["total"] / blocks["weight"]))


_PLATT = f"""WITH {EVENTS_SQL},
d AS (SELECT 1 AS one, id, y_true, LN(q / (1 - q)) AS x
      FROM (SELECT *, GREATEST(LEAST(y_prob, 1 - 1e-7), 1e-7) AS q FROM pred)),
{newton_sql("d", "one")}
SELECT id, ROUND(1 / (1 + EXP(-(a + b * x))), 6) AS y_prob FROM d JOIN n8 USING (one)"""


@query("sigmoid_calibration", _PLATT)
def _sigmoid(t: Tables):
    pred = t.event_predictions()
    fitted = calibrate.OOFCalibrator("sigmoid").fit(pred)
    return rounded(fitted.transform(pred.select("id", "y_prob")), 6)


@query("calibrate_base_models")
def _base_calibration(t: Tables):
    from pyspark.sql import functions as F

    pred = t.event_predictions().select("id", "model", "y_true", "y_prob")
    maps = {"m1": calibrate.OOFCalibrator("isotonic").fit(pred.where(F.col("model") == "m1"))}
    return calibrate.apply_base_calibration(pred, maps)


@query("per_fold_calibration")
def _fold_calibration(t: Tables):
    pred = t.event_predictions().select("id", "split_seed", "y_true", "y_prob")
    return calibrate.fold_calibration(pred, "split_seed", "isotonic")
