"""Feature statistics, correlation and panels (families D, E, F, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import corr as R, panels as N, pareto as M, prepare as P, screen as S
from riskloom.queries.registry import (
    BRAND_VALUES_SQL,
    FEATURES_SQL,
    MEASUREMENTS_SQL,
    METRICS_SQL,
    SELECTIONS_SQL,
    STABILITY_SQL,
    Tables,
    query,
    rounded,
)

_MW = """v AS (SELECT feature, value, SUM(y) AS pos, SUM(1 - y) AS neg FROM features
  WHERE value IS NOT NULL GROUP BY feature, value),
c AS (SELECT *, SUM(neg) OVER (PARTITION BY feature ORDER BY value) AS cum_neg FROM v),
mw AS (SELECT feature, CAST(SUM(pos) AS BIGINT) AS n1, CAST(SUM(neg) AS BIGINT) AS n0,
    SUM(pos * (cum_neg - neg / CAST(2 AS DOUBLE))) AS u,
    SUM(CAST(pos + neg AS DOUBLE) ** 3 - (pos + neg)) AS ties,
    SUM(pos * value) / SUM(pos) AS m1, SUM(neg * value) / SUM(neg) AS m0 FROM c GROUP BY feature)"""


def _mann_whitney_sql(base: str) -> str:
    return f"""WITH {base}, {_MW}
SELECT feature, n1, n0, ROUND(u, 3) AS u, ROUND(ABS(m1 - m0), 9) AS effect_size,
  ROUND((GREATEST(u, CAST(n1 AS DOUBLE) * n0 - u) - CAST(n1 AS DOUBLE) * n0 / 2 - 0.5) /
    SQRT(CAST(n1 AS DOUBLE) * n0 / 12 * ((n1 + n0 + 1) - ties / (CAST(n1 + n0 AS DOUBLE) * (n1 + n0 - 1)))), 6) AS z
FROM mw WHERE n1 >= 10 AND n0 >= 10"""


def _mann_whitney(melted):
    out = S.mann_whitney(melted).select("feature", "n1", "n0", "u", "effect_size", "z")
    return rounded(out).withColumns({"z": F.round("z", 6), "u": F.round("u", 3)})


@query("mann_whitney_many_features", _mann_whitney_sql(FEATURES_SQL))
def _mw_features(t: Tables):
    return _mann_whitney(t.features())


@query("mann_whitney_many_rows", _mann_whitney_sql(MEASUREMENTS_SQL))
def _mw_rows(t: Tables):
    return _mann_whitney(t.measurements())


@query("mann_whitney_screen")
def _mw_screen(t: Tables):
    return S.mann_whitney_screen(t.features(), 20)


@query("univariate_strength")
def _strength(t: Tables):
    return S.univariate_strength(t.features())


_F = """m AS (SELECT feature, COUNT(*) FILTER (y = 1) AS n1, COUNT(*) FILTER (y = 0) AS n0,
    AVG(value) FILTER (y = 1) AS mean1, AVG(value) FILTER (y = 0) AS mean0,
    VAR_POP(value) FILTER (y = 1) * COUNT(*) FILTER (y = 1) AS ss1,
    VAR_POP(value) FILTER (y = 0) * COUNT(*) FILTER (y = 0) AS ss0 FROM {t} GROUP BY feature),
f AS (SELECT *, CAST(n1 AS DOUBLE) * n0 / (n1 + n0) * (mean1 - mean0) ** 2 / ((ss1 + ss0) / (n1 + n0 - 2)) AS f FROM m)"""

_IMPUTED = """med AS (SELECT feature, QUANTILE_CONT(value, 0.5) AS med FROM features GROUP BY feature),
filled AS (SELECT f.* REPLACE (COALESCE(value, med) AS value) FROM features f JOIN med USING (feature))"""

_HOLES = FEATURES_SQL.replace("features AS (", "raw AS (") + """,
features AS (SELECT * REPLACE (CASE WHEN (id + CAST(SUBSTR(feature, 2) AS INTEGER)) % 11 <> 0 THEN value END AS value) FROM raw)"""


def _with_holes(t: Tables):
    """Features with every eleventh value missing, to exercise imputation."""
    number = F.substring("feature", 2, 4).cast("int")
    hole = (F.col("id") + number) % 11 == 0
    return t.features().withColumn("value", F.when(~hole, F.col("value")))


@query("f_statistic_screen", f"""WITH {_HOLES}, {_IMPUTED}, {_F.format(t="filled")},
nm AS (SELECT feature, CAST(COUNT(value) AS DOUBLE) / COUNT(*) AS nonmissing_frac FROM features GROUP BY feature)
SELECT feature, n1, n0, ROUND(f, 6) AS f_score, ROUND(nonmissing_frac, 9) AS nonmissing_frac
FROM f JOIN nm USING (feature) WHERE f IS NOT NULL""")
def _f_screen(t: Tables):
    out = S.f_statistic_screen(_with_holes(t)).drop("p_value")
    return rounded(out).withColumn("f_score", F.round("f_score", 6))


@query("f_scores", f"""WITH {MEASUREMENTS_SQL}, {_F.format(t="features")}
SELECT feature, n1, n0, ROUND(f, 6) AS f_score FROM f""")
def _f_scores(t: Tables):
    return rounded(S.f_scores(t.measurements()).drop("p_value"), 6)


@query("k_best_features", f"""WITH {_HOLES}, {_IMPUTED}, {_F.format(t="filled")}
SELECT feature, ROUND(f, 6) AS score FROM f ORDER BY f DESC, feature LIMIT 10""")
def _k_best(t: Tables):
    return rounded(S.select_k_best(_with_holes(t), 10), 6)


@query("impute_median", f"""WITH {_HOLES}, {_IMPUTED}
SELECT feature, ROUND(SUM(value), 6) AS total, ROUND(MIN(med), 9) AS med
FROM filled JOIN med USING (feature) GROUP BY feature""")
def _impute(t: Tables):
    holes = _with_holes(t)
    medians = S.exact_quantiles(holes, ["feature"], "value", [0.5])
    total = S.impute(holes).groupBy("feature").agg(F.sum("value").alias("total"))
    out = total.join(medians.withColumnRenamed("q_0", "med"), "feature")
    return rounded(out, 9).withColumn("total", F.round("total", 6))


@query("impute_mean", f"""WITH {_HOLES}
SELECT feature, ROUND(AVG(value) * COUNT(*), 6) AS total FROM features GROUP BY feature""")
def _impute_mean(t: Tables):
    total = S.impute(_with_holes(t), "mean").groupBy("feature").agg(F.sum("value").alias("total"))
    return rounded(total, 6)


@query("variance_missingness_filter", f"""WITH {_HOLES}
SELECT feature, ROUND(frac, 9) AS nonmissing_frac, frac >= 0.91 AS passed_nonmissing,
  CASE WHEN frac >= 0.91 THEN ROUND(v, 9) END AS variance, frac >= 0.91 AND v >= 0.015 AS passed_variance
FROM (SELECT feature, CAST(COUNT(value) AS DOUBLE) / COUNT(*) AS frac, VAR_POP(value) AS v
      FROM features GROUP BY feature)""")
def _variance(t: Tables):
    return rounded(S.variance_missingness_filter(_with_holes(t), 0.91, 0.015))


@query("two_group_statistics", f"""WITH {FEATURES_SQL}, {_F.format(t="features")},
s AS (SELECT *, ss1 / (n1 - 1) AS v1, ss0 / (n0 - 1) AS v0, SQRT((ss1 + ss0) / (n1 + n0 - 2)) AS sp FROM f)
SELECT feature, n1, n0, ROUND(mean1, 9) AS mean1, ROUND(mean0, 9) AS mean0, ROUND(SQRT(v1), 9) AS sd1,
  ROUND(SQRT(v0), 9) AS sd0, ROUND(sp, 9) AS pooled_sd, ROUND((mean1 - mean0) / sp, 6) AS cohens_d,
  ROUND((mean1 - mean0) / SQRT(v1 / n1 + v0 / n0), 6) AS t_stat,
  ROUND((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 6) AS t_df FROM s""")
def _two_group(t: Tables):
    out = rounded(S.two_group_statistics(t.features()).drop("p_value"))
    return out.withColumns({c: F.round(c, 6) for c in ("cohens_d", "t_stat", "t_df")})


@query("screening_step")
def _screening_step(t: Tables):
    names = [f"e{i:02d}_resid" for i in range(64)]
    wide = t.wide_cohort().select(
        "id", "y", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]
    )
    return S.Screening(topN=5).fit(wide).transform(wide)


@query("univariate_auc", f"""WITH {FEATURES_SQL}, {_MW}
SELECT feature, ROUND(u / (CAST(n1 AS DOUBLE) * n0), 9) AS auc,
  ROUND(ABS(u / (CAST(n1 AS DOUBLE) * n0) - 0.5), 9) AS strength FROM mw""")
def _auc(t: Tables):
    return rounded(S.univariate_auc(t.features()))


_BIAS = f"""WITH {FEATURES_SQL.replace("features AS (", "raw AS (")}, pairs AS (
  SELECT feature || '|incident' AS feature, value, CASE WHEN target = 'Incident' THEN 1 ELSE 0 END AS y
  FROM raw WHERE target <> 'Prevalent' UNION ALL
  SELECT feature || '|prevalent', value, CASE WHEN target = 'Prevalent' THEN 1 ELSE 0 END
  FROM raw WHERE target <> 'Incident'),
{_MW.replace("FROM features", "FROM pairs")}, w AS (
  SELECT SPLIT_PART(feature, '|', 1) AS feature,
    MAX(CASE WHEN feature LIKE '%|incident' THEN u / (CAST(n1 AS DOUBLE) * n0) END) AS incident_auc,
    MAX(CASE WHEN feature LIKE '%|prevalent' THEN u / (CAST(n1 AS DOUBLE) * n0) END) AS prevalent_auc
  FROM mw GROUP BY 1),
b AS (SELECT *, incident_auc - prevalent_auc AS bias, CASE WHEN incident_auc - prevalent_auc > 0.05 THEN 'incident'
  WHEN incident_auc - prevalent_auc < -0.05 THEN 'prevalent' ELSE 'balanced' END AS side FROM w)"""


@query("feature_bias_by_case_type", f"""{_BIAS}
SELECT feature, ROUND(incident_auc, 9) AS incident_auc, ROUND(prevalent_auc, 9) AS prevalent_auc,
  ROUND(bias, 9) AS bias, side FROM b""")
def _bias(t: Tables):
    return rounded(S.feature_bias(t.features()))


@query("feature_bias_summary", f"""{_BIAS}
SELECT COUNT(*) AS n_features, COUNT(*) FILTER (side = 'incident') AS n_incident_biased,
  COUNT(*) FILTER (side = 'prevalent') AS n_prevalent_biased, COUNT(*) FILTER (side = 'balanced') AS n_balanced,
  ROUND(100.0 * COUNT(*) FILTER (side = 'incident') / COUNT(*), 9) AS pct_incident_biased,
  ROUND(100.0 * COUNT(*) FILTER (side = 'prevalent') / COUNT(*), 9) AS pct_prevalent_biased,
  ROUND(AVG(incident_auc), 9) AS mean_incident_auc, ROUND(AVG(prevalent_auc), 9) AS mean_prevalent_auc,
  ROUND(AVG(bias), 9) AS mean_bias FROM b""")
def _bias_summary(t: Tables):
    return rounded(S.feature_bias_summary(S.feature_bias(t.features())))


@query("screening_over_splits", f"""WITH {FEATURES_SQL.replace("features AS (", "raw AS (")},
s AS (SELECT feature, id % 4 AS split_seed, AVG(value) FILTER (y = 1) - AVG(value) FILTER (y = 0) AS effect
  FROM raw GROUP BY ALL)
SELECT feature, COUNT(*) AS n_splits, ROUND(AVG(effect), 9) AS effect_mean, ROUND(STDDEV_SAMP(effect), 9) AS effect_sd
FROM s GROUP BY feature""")
def _over_splits(t: Tables):
    rows = t.features().withColumn("split_seed", F.col("id") % 4)
    m = S.class_moments(rows, ["feature", "split_seed"])
    effects = m.select("feature", "split_seed", (F.col("mean1") - F.col("mean0")).alias("effect"))
    return rounded(S.screening_over_splits(effects, ["effect"]))


@query("union_of_selections", f"""WITH {FEATURES_SQL}, {_MW}, {_F.format(t="features")}
SELECT feature FROM (SELECT feature FROM f ORDER BY f DESC, feature LIMIT 10)
UNION SELECT feature FROM (SELECT feature FROM mw ORDER BY ABS(u / (CAST(n1 AS DOUBLE) * n0) - 0.5) DESC, feature LIMIT 10)""")
def _union(t: Tables):
    best = S.f_scores(t.features()).orderBy(F.col("f_score").desc(), "feature").limit(10)
    return N.union_of_selections(best, S.univariate_auc(t.features(), 10))


# --- correlation ---------------------------------------------------------------

_CORR = """corr AS (
  SELECT a.feature AS feature_i, b.feature AS feature_j, ABS(CORR(a.value, b.value)) AS r
  FROM {t} a JOIN {t} b ON a.id = b.id AND a.feature < b.feature GROUP BY ALL)"""

_RANKED = """ranked AS (SELECT id, feature, RANK() OVER (PARTITION BY feature ORDER BY value)
  + (COUNT(*) OVER (PARTITION BY feature, value) - 1) / CAST(2 AS DOUBLE) AS value FROM features)"""

NAMES = [f"f{i:04d}" for i in range(64)]


def _brands(t: Tables) -> list[str]:
    return [r[0] for r in t.part.select("p_brand").distinct().orderBy("p_brand").collect()]


@query("correlation_pearson_matrix", f"""WITH {FEATURES_SQL}, {_CORR.format(t="features")}
SELECT feature_i, feature_j, ROUND(r, 6) AS r FROM corr""")
def _pearson(t: Tables):
    return rounded(R.correlation_of_vectors(t.embeddings, "embedding", NAMES), 6)


@query("correlation_spearman", f"""WITH {FEATURES_SQL}, {_RANKED}, {_CORR.format(t="ranked")}
SELECT feature_i, feature_j, ROUND(r, 6) AS r FROM corr""")
def _spearman(t: Tables):
    return rounded(R.correlation(t.features(), NAMES, "spearman"), 6)


@query("correlation_with_imputation", f"""WITH {_HOLES}, {_IMPUTED}, {_CORR.format(t="filled")}
SELECT feature_i, feature_j, ROUND(r, 6) AS r FROM corr""")
def _imputed_corr(t: Tables):
    return rounded(R.correlation(_with_holes(t), NAMES, "pearson"), 6)


def _pairs(t: Tables):
    return R.correlation_of_vectors(t.embeddings, "embedding", NAMES)


_PAIRS = f"{FEATURES_SQL}, {_CORR.format(t='features')}"


@query("high_correlation_pairs", f"""WITH {_PAIRS}
SELECT feature_i, feature_j, ROUND(r, 6) AS r FROM corr WHERE r >= 0.1""")
def _high_pairs(t: Tables):
    return rounded(R.high_correlation_pairs(_pairs(t), 0.1), 6)


@query("correlation_graph", f"""WITH {_PAIRS}
SELECT feature_i AS src, feature_j AS dst FROM corr WHERE r >= 0.1
UNION ALL SELECT feature_j, feature_i FROM corr WHERE r >= 0.1""")
def _graph(t: Tables):
    return R.correlation_graph(_pairs(t), 0.1)


def components_sql(threshold: float, names: str = "SELECT DISTINCT feature FROM features") -> str:
    return f"""names AS ({names}),
edge AS (SELECT feature_i AS s, feature_j AS d FROM corr WHERE r >= {threshold}
  UNION ALL SELECT feature_j, feature_i FROM corr WHERE r >= {threshold}),
inner_edge AS (SELECT s, d FROM edge WHERE s IN (SELECT feature FROM names) AND d IN (SELECT feature FROM names)),
walk(feature, reach) AS (SELECT feature, feature FROM names UNION
  SELECT w.feature, e.d FROM walk w JOIN inner_edge e ON w.reach = e.s),
comp AS (SELECT feature, MIN(reach) AS component FROM walk GROUP BY feature)"""


_EDGE = 0.14


@query("connected_components", f"""WITH RECURSIVE {_PAIRS}, {components_sql(_EDGE)}
SELECT feature, component FROM comp""")
def _components(t: Tables):
    names = t.spark.createDataFrame([(n,) for n in NAMES], "feature string")
    return R.connected_components(names, R.correlation_graph(_pairs(t), _EDGE))


_FREQ = """freq AS (SELECT feature, CAST(COUNT(*) FILTER (value > 0) AS DOUBLE) / COUNT(*) AS selection_freq
  FROM features GROUP BY feature)"""


def _frequency(t: Tables):
    """Share of positive values, standing in for a selection frequency."""
    return t.features().groupBy("feature").agg(
        (F.count_if(F.col("value") > 0) / F.count(F.lit(1))).alias("selection_freq")
    )


_REPS = """rep AS (SELECT component, feature, selection_freq,
    FIRST_VALUE(feature) OVER (PARTITION BY component ORDER BY selection_freq DESC, feature) AS rep_feature,
    COUNT(*) OVER (PARTITION BY component) AS component_size FROM comp JOIN freq USING (feature))"""


@query("prune_correlated", f"""WITH RECURSIVE {_PAIRS}, {components_sql(_EDGE)}, {_FREQ}, {_REPS}
SELECT component, feature, ROUND(selection_freq, 9) AS selection_freq, feature = rep_feature AS kept,
  rep_feature, component_size FROM rep""")
def _prune(t: Tables):
    freq = _frequency(t)
    return rounded(R.prune_correlated(freq, _pairs(t), freq, _EDGE))


@query("representatives_with_univariate_tiebreak")
def _tiebreak(t: Tables):
    freq = _frequency(t)
    strength = S.univariate_strength(t.features())
    return R.prune_correlated(freq, _pairs(t), freq, _EDGE, strength)


def _ranked_names(t: Tables) -> list[str]:
    return [r["feature"] for r in N.rank_by_frequency(_frequency(t)).orderBy("rank").collect()]


@query("prune_and_refill_panel")
def _refill(t: Tables):
    freq = _frequency(t)
    names = _ranked_names(t)
    _, panel = R.prune_and_refill(names, R.checkpointed(_pairs(t)), freq, 20, _EDGE)
    rows = [(k, n) for k, n in enumerate(panel, start=1)]
    return t.spark.createDataFrame(rows, "rank int, feature string")


@query("panels_of_several_sizes")
def _sizes(t: Tables):
    return R.multi_size_panels(_ranked_names(t), _pairs(t), _frequency(t), [5, 10, 20], _EDGE)


@query("cluster_by_score", f"""WITH RECURSIVE {BRAND_VALUES_SQL}, {_RANKED}, {_CORR.format(t="ranked")},
{components_sql(0.2)}, freq AS (SELECT feature, AVG(value) AS selection_freq FROM features GROUP BY feature), {_REPS}
SELECT component, feature, ROUND(selection_freq, 6) AS consensus_score, feature = rep_feature AS kept,
  rep_feature, component_size FROM rep""")
def _cluster(t: Tables):
    values = t.brand_values()
    scores = values.groupBy("feature").agg(F.avg("value").alias("consensus_score"))
    pairs = R.correlation(values, _brands(t), "spearman")
    return rounded(R.cluster_by_score(scores, pairs, 0.2), 6)


# --- panels --------------------------------------------------------------------


@query("selection_frequencies", f"""WITH {SELECTIONS_SQL}, n AS (SELECT model, COUNT(*) AS n FROM slog GROUP BY model)
SELECT model, feature, ROUND(CAST(COUNT(*) AS DOUBLE) / MAX(n), 9) AS selection_freq
FROM named JOIN n USING (model) GROUP BY model, feature""")
def _frequencies(t: Tables):
    log = t.selection_log().withColumn("json", F.to_json("features")).drop("features")
    return rounded(N.selection_frequencies(N.parse_selections(log, "json"), ["model"]))


_FREQUENCIES = f"""{SELECTIONS_SQL}, n AS (SELECT COUNT(*) AS n FROM slog),
freq AS (SELECT feature, CAST(COUNT(*) AS DOUBLE) / MAX(n) AS selection_freq FROM named, n GROUP BY feature),
ranked AS (SELECT feature, ROUND(selection_freq, 9) AS selection_freq,
  ROW_NUMBER() OVER (ORDER BY selection_freq DESC, feature) AS rank FROM freq)"""


@query("frequency_panel_top_n", f"WITH {_FREQUENCIES} SELECT * FROM ranked WHERE rank <= 10")
def _panel(t: Tables):
    freq = N.selection_frequencies(t.selection_log())
    return rounded(N.frequency_panel(freq, "topN", 10))


@query("frequency_panel_threshold", f"WITH {_FREQUENCIES} SELECT * FROM ranked WHERE selection_freq >= 0.15")
def _panel_threshold(t: Tables):
    freq = N.selection_frequencies(t.selection_log())
    return rounded(N.frequency_panel(freq, "freq_ge_tau", freq_threshold=0.15))


@query("rank_by_frequency", f"WITH {_FREQUENCIES} SELECT * FROM ranked")
def _ranked(t: Tables):
    return rounded(N.rank_by_frequency(N.selection_frequencies(t.selection_log())))


@query("stable_panel", f"""WITH {SELECTIONS_SQL}
SELECT model, feature, ROUND(COUNT(DISTINCT repeat) / CAST(3 AS DOUBLE), 9) AS selection_freq,
  COUNT(DISTINCT repeat) / CAST(3 AS DOUBLE) >= 0.75 AS kept FROM named GROUP BY model, feature""")
def _stable(t: Tables):
    return rounded(N.stable_panel(t.selection_log(), 3, 0.75, group_cols=["model"]))


@query("stability_over_splits", f"""WITH {SELECTIONS_SQL},
n AS (SELECT model, COUNT(DISTINCT split_seed) AS n FROM slog GROUP BY model)
SELECT model, feature, COUNT(DISTINCT split_seed) AS n_splits_selected,
  ROUND(CAST(COUNT(DISTINCT split_seed) AS DOUBLE) / MAX(n), 9) AS selection_fraction
FROM named JOIN n USING (model) GROUP BY model, feature""")
def _stability(t: Tables):
    return rounded(N.stability_over_splits(t.selection_log()))


@query("aggregate_feature_reports", f"""WITH {SELECTIONS_SQL},
n AS (SELECT split_seed, COUNT(*) AS n FROM slog GROUP BY split_seed),
r AS (SELECT split_seed, feature, CAST(COUNT(*) AS DOUBLE) / MAX(n) AS f FROM named JOIN n USING (split_seed) GROUP BY ALL)
SELECT feature, ROUND(AVG(f), 9) AS selection_freq_mean, ROUND(STDDEV_SAMP(f), 9) AS selection_freq_std,
  ROUND(MIN(f), 9) AS selection_freq_min, ROUND(MAX(f), 9) AS selection_freq_max, COUNT(*) AS n_splits,
  ROW_NUMBER() OVER (ORDER BY ROUND(AVG(f), 12) DESC, feature) AS rank FROM r GROUP BY feature""")
def _reports(t: Tables):
    freq = N.selection_frequencies(t.selection_log(), ["split_seed"])
    return rounded(N.aggregate_feature_reports(freq))


@query("feature_report", f"""WITH {FEATURES_SQL}, {_FREQ}, {_MW}
SELECT feature, ROUND(selection_freq, 9) AS selection_freq, ROUND(ABS(m1 - m0), 9) AS effect_size,
  ROW_NUMBER() OVER (ORDER BY selection_freq DESC, feature) AS rank FROM freq LEFT JOIN mw USING (feature)""")
def _feature_report(t: Tables):
    return rounded(N.feature_report(_frequency(t), S.mann_whitney(t.features()))).drop("p_value")


@query("consensus_panels_by_size", f"""WITH {SELECTIONS_SQL},
c AS (SELECT split_seed, feature, COUNT(*) AS k FROM named GROUP BY ALL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY split_seed ORDER BY k DESC, feature) AS rn FROM c),
p AS (SELECT panel_size, split_seed, feature FROM r CROSS JOIN (SELECT UNNEST([5, 10, 15]) AS panel_size) WHERE rn <= panel_size),
n AS (SELECT panel_size, COUNT(DISTINCT split_seed) AS n_splits FROM p GROUP BY panel_size)
SELECT panel_size, feature, COUNT(DISTINCT split_seed) AS n_splits_selected, n_splits,
  CAST(CEIL(CAST('0.6' AS DOUBLE) * n_splits) AS BIGINT) AS min_splits FROM p JOIN n USING (panel_size)
GROUP BY panel_size, feature, n_splits
HAVING COUNT(DISTINCT split_seed) >= CEIL(CAST('0.6' AS DOUBLE) * n_splits)""")
def _by_size(t: Tables):
    freq = N.selection_frequencies(t.selection_log(), ["split_seed"])
    ranked = N.rank_by_frequency(freq, ["split_seed"])
    sizes = F.explode(F.array(*[F.lit(s) for s in (5, 10, 15)]))
    panels = ranked.withColumn("panel_size", sizes).where(F.col("rank") <= F.col("panel_size"))
    return N.consensus_panels_by_size(panels, 0.6)


@query("fold_consensus", f"""WITH {_FREQUENCIES}
SELECT *, selection_freq >= 0.16 AS in_consensus FROM ranked""")
def _fold_consensus(t: Tables):
    return rounded(N.fold_consensus(t.selection_log(), 0.16))


@query("fold_summary", f"""WITH {SELECTIONS_SQL}
SELECT model, COUNT(*) AS n_folds, ROUND(AVG(LEN(features)), 9) AS mean_optimal_size,
  ROUND(STDDEV_POP(LEN(features)), 9) AS sd_optimal_size, ROUND(AVG(repeat / CAST(2 AS DOUBLE)), 9) AS mean_val_auroc,
  ROUND(STDDEV_POP(repeat / CAST(2 AS DOUBLE)), 9) AS sd_val_auroc FROM slog GROUP BY model""")
def _fold_summary(t: Tables):
    folds = t.selection_log().withColumn("val_auroc", F.col("repeat") / 2.0)
    return rounded(N.fold_summary(folds, ["model"]))


def ranking_sql(source: str) -> str:
    """Composite ranks per model with the elimination order of model O."""
    return f"""st AS (SELECT model, feature, selection_fraction AS sf,
    ROW_NUMBER() OVER (PARTITION BY model ORDER BY selection_fraction DESC, feature) AS stability_rank,
    COUNT(*) OVER (PARTITION BY model) AS n FROM {source}),
mx AS (SELECT model, MAX(elimination_order) AS mo FROM rfe GROUP BY model),
im AS (SELECT st.*, (n - stability_rank + 1) / CAST(n AS DOUBLE) AS ns,
    (elimination_order + 1) / CAST(mo + 1 AS DOUBLE) AS rfe_importance
  FROM st LEFT JOIN rfe USING (model, feature) LEFT JOIN mx USING (model)),
rr AS (SELECT *, CASE WHEN rfe_importance IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY model
    ORDER BY rfe_importance DESC NULLS LAST, feature) END AS rfe_rank,
    COUNT(rfe_importance) OVER (PARTITION BY model) AS nr FROM im),
cs AS (SELECT *, COALESCE(0.5 * (nr - rfe_rank + 1) / CAST(NULLIF(nr, 0) AS DOUBLE) + 0.5 * ns, ns) AS composite FROM rr),
ranking AS (SELECT model, feature, sf, stability_rank, rfe_importance, rfe_rank, composite,
    ROW_NUMBER() OVER (PARTITION BY model ORDER BY ROUND(composite, 12) DESC, feature) AS final_rank FROM cs)"""


_RANKING = f"{STABILITY_SQL}, {ranking_sql('stability')}"


@query("per_model_ranking", f"""WITH {_RANKING}
SELECT model, feature, ROUND(sf, 9) AS stability_freq, stability_rank, ROUND(rfe_importance, 9) AS rfe_importance,
  rfe_rank, ROUND(composite, 9) AS composite_score, final_rank FROM ranking""")
def _ranking(t: Tables):
    return rounded(N.per_model_ranking(t.brand_stability(), t.brand_elimination()))


STABLE = 0.33
_STABLE_SQL = f"{STABILITY_SQL}, stable AS (SELECT * FROM stability WHERE selection_fraction >= {STABLE}), {ranking_sql('stable')}"


def aggregate_sql(score: str) -> str:
    return f"""mm AS (SELECT model, MAX(final_rank) AS worst FROM ranking GROUP BY model),
full_rank AS (SELECT f.feature, mm.model, worst, r.final_rank AS given, COALESCE(r.final_rank, worst + 1) AS rk
  FROM (SELECT DISTINCT feature FROM ranking) f CROSS JOIN mm LEFT JOIN ranking r ON r.feature = f.feature AND r.model = mm.model),
agg AS (SELECT feature, {score} AS consensus_score, COUNT(given) AS n_models_present,
    COUNT(given) / CAST(COUNT(*) AS DOUBLE) AS agreement_strength, COALESCE(STDDEV_SAMP(given), 0) AS rank_std,
    COALESCE(STDDEV_SAMP(given), 0) / AVG(given) AS rank_cv,
    CAST(MAX(CASE WHEN model = 'F' THEN rk END) AS DOUBLE) AS "F_rank",
    CAST(MAX(CASE WHEN model = 'O' THEN rk END) AS DOUBLE) AS "O_rank" FROM full_rank GROUP BY feature),
consensus AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ROUND(consensus_score, 12) DESC, feature) AS consensus_rank FROM agg)"""


_OUT = """SELECT feature, ROUND(consensus_score, 9) AS consensus_score, consensus_rank, n_models_present,
  ROUND(agreement_strength, 9) AS agreement_strength, ROUND(rank_std, 9) AS rank_std, ROUND(rank_cv, 9) AS rank_cv,
  "F_rank", "O_rank" FROM consensus"""


def _aggregated(t: Tables, method: str):
    per_model = N.per_model_ranking(
        N.stable_features(t.brand_stability(), STABLE), t.brand_elimination()
    )
    return rounded(N.aggregate_ranks(per_model, method))


@query("rank_aggregation_geometric", f"WITH {_STABLE_SQL}, {aggregate_sql('EXP(AVG(-LN(rk)))')} {_OUT}")
def _geometric(t: Tables):
    return _aggregated(t, "geometric_mean")


@query("rank_aggregation_borda", f"WITH {_STABLE_SQL}, {aggregate_sql('AVG(worst + 1 - rk + 1)')} {_OUT}")
def _borda(t: Tables):
    return _aggregated(t, "borda")


@query("rank_aggregation_median", f"WITH {_STABLE_SQL}, {aggregate_sql('MAX(MAX(worst)) OVER () + 1 - QUANTILE_CONT(rk, 0.5)')} {_OUT}")
def _median(t: Tables):
    return _aggregated(t, "median")


@query("consensus_panel", f"""WITH RECURSIVE {BRAND_VALUES_SQL}, {_RANKED}, {_CORR.format(t="ranked")},
{_STABLE_SQL}, {aggregate_sql('EXP(AVG(-LN(rk)))')},
{components_sql(0.2, "SELECT feature FROM consensus WHERE consensus_rank <= 15")},
best AS (SELECT feature, consensus_score, ROW_NUMBER() OVER (PARTITION BY component ORDER BY consensus_score DESC, feature) AS rn
  FROM comp JOIN consensus USING (feature)),
pick AS (SELECT feature, consensus_score, ROW_NUMBER() OVER (ORDER BY ROUND(consensus_score, 12) DESC, feature) AS rank
  FROM best WHERE rn = 1)
SELECT feature, ROUND(consensus_score, 9) AS consensus_score, rank FROM pick WHERE rank <= 5""")
def _consensus(t: Tables):
    pairs = R.checkpointed(R.correlation(t.brand_values(), _brands(t), "spearman"))
    out = N.consensus_panel(
        t.brand_stability(), pairs, t.brand_elimination(), STABLE, 0.2, target_size=5
    )
    return rounded(out["panel"])


@query("panel_rank_uncertainty", f"""WITH {_STABLE_SQL}, {aggregate_sql('EXP(AVG(-LN(rk)))')}
SELECT COUNT(*) AS n_features, ROUND(AVG(rank_std), 9) AS rank_std_mean, ROUND(AVG(rank_cv), 9) AS rank_cv_mean,
  ROUND(AVG(agreement_strength), 9) AS agreement_mean, MIN(agreement_strength) AS agreement_min,
  MAX(agreement_strength) AS agreement_max, COUNT(*) FILTER (agreement_strength = 1) AS n_full_agreement
FROM consensus WHERE consensus_rank <= 10""")
def _uncertainty(t: Tables):
    ranking = R.checkpointed(_aggregated(t, "geometric_mean"))
    return rounded(N.panel_uncertainty(ranking.where(F.col("consensus_rank") <= 10), ranking))


@query("coefficient_selection", f"""WITH {FEATURES_SQL}
SELECT feature, ROUND(AVG(value), 9) AS coefficient FROM features GROUP BY feature HAVING ABS(AVG(value)) > 0.005""")
def _coefficients(t: Tables):
    rows = t.features().withColumnRenamed("value", "coefficient")
    return rounded(N.coefficient_selection(rows, 0.005))


@query("importance_selection", f"""WITH {FEATURES_SQL},
a AS (SELECT feature, AVG(value) AS v FROM features GROUP BY feature),
m AS (SELECT feature, v FROM a WHERE v >= 0.002 OR (SELECT MAX(v) FROM a) < 0.002)
SELECT feature, ROUND(v, 9) AS importance, ROW_NUMBER() OVER (ORDER BY v DESC, feature) AS rank FROM m
QUALIFY rank <= 12""")
def _importance(t: Tables):
    rows = t.features().withColumnRenamed("value", "drop")
    return rounded(N.importance_selection(rows, 0.002, 12))


# --- panel sizes and trials ----------------------------------------------------

_CURVE = """curve AS (SELECT l_linestatus AS model, CAST(l_quantity AS INTEGER) AS size,
  AVG(l_extendedprice) / 110000 AS auroc, STDDEV_POP(l_extendedprice) / 3000000 AS auroc_std
  FROM lineitem GROUP BY ALL)"""


def _curve(t: Tables):
    return t.lineitem.groupBy(
        F.col("l_linestatus").alias("model"), F.col("l_quantity").cast("int").alias("size")
    ).agg(
        (F.avg("l_extendedprice") / 110000).alias("auroc"),
        (F.stddev_pop("l_extendedprice") / 3000000).alias("auroc_std"),
    )


_RECOMMENDED = """best AS (SELECT model, MAX(auroc) AS b FROM curve GROUP BY model),
rec AS (SELECT model, fraction, MIN(size) AS size FROM curve JOIN best USING (model)
  CROSS JOIN (SELECT UNNEST([CAST('0.98' AS DOUBLE), CAST('0.95' AS DOUBLE), CAST('0.9' AS DOUBLE)]) AS fraction)
  WHERE auroc >= b * fraction GROUP BY ALL)"""


@query("recommended_panel_sizes", f"WITH {_CURVE}, {_RECOMMENDED} SELECT model, fraction, size FROM rec")
def _recommended(t: Tables):
    return M.recommended_sizes(_curve(t), ["model"], (0.98, 0.95, 0.9))


@query("knee_panel_size", f"""WITH {_CURVE},
e AS (SELECT model, MIN(size) s0, MAX(size) s1, MIN(auroc) a0, MAX(auroc) a1, ARG_MAX(auroc, size) big,
  ARG_MIN(auroc, size) small FROM curve GROUP BY model),
x AS (SELECT model, size, (size - s0) / CAST(s1 - s0 AS DOUBLE) AS x, (auroc - a0) / (a1 - a0) AS y,
  (big - a0) / (a1 - a0) AS y1, (small - a0) / (a1 - a0) AS y0 FROM curve JOIN e USING (model))
SELECT model, ARG_MAX(size, ROW(ROUND(ABS((y1 - y0) * x - y + y0) / SQRT((y1 - y0) ** 2 + 1), 12), size)) AS knee_size
FROM x GROUP BY model""")
def _knee(t: Tables):
    return M.knee_size(_curve(t), ["model"])


@query("compare_adjacent_panel_sizes", f"""WITH {_CURVE}, {_RECOMMENDED},
c AS (SELECT model, size, auroc, auroc_std FROM curve SEMI JOIN rec USING (model, size)),
l AS (SELECT *, LEAD(size) OVER w AS s2, LEAD(auroc) OVER w AS a2, LEAD(auroc_std) OVER w AS d2 FROM c
  WINDOW w AS (PARTITION BY model ORDER BY size DESC))
SELECT model, size AS larger_size, s2 AS smaller_size, ROUND(ABS(auroc - a2), 9) AS auroc_gap,
  ABS(auroc - a2) <= 1.96 * (auroc_std + d2) AS intervals_overlap,
  ROUND(ABS(auroc - a2) / SQRT(auroc_std ** 2 + d2 ** 2), 6) AS z_score,
  ABS(auroc - a2) > 1.96 * (auroc_std + d2) AND ABS(auroc - a2) / SQRT(auroc_std ** 2 + d2 ** 2) > 1.96 AS different
FROM l WHERE s2 IS NOT NULL""")
def _adjacent(t: Tables):
    curve = _curve(t)
    sizes = M.recommended_sizes(curve, ["model"], (0.98, 0.95, 0.9))
    out = M.compare_adjacent_sizes(curve, sizes, ["model"])
    return rounded(out).withColumn("z_score", F.round("z_score", 6))


_FRONT = """trials AS (SELECT model, config, split_seed, auroc, brier,
    config || '-' || CAST(split_seed AS VARCHAR) AS trial FROM metrics),
front AS (SELECT * FROM trials a WHERE NOT EXISTS (SELECT 1 FROM trials b WHERE b.model = a.model
  AND b.auroc >= a.auroc AND b.brier <= a.brier AND (b.auroc > a.auroc OR b.brier < a.brier)))"""


def _trials(t: Tables):
    trial = F.concat_ws("-", "config", F.col("split_seed").cast("string"))
    return t.split_metrics().select("model", trial.alias("trial"), "auroc", "brier")


@query("pareto_frontier", f"""WITH {METRICS_SQL}, {_FRONT}
SELECT model, trial, ROUND(auroc, 9) AS auroc, ROUND(brier, 9) AS brier FROM front""")
def _frontier(t: Tables):
    return rounded(M.pareto_frontier(R.checkpointed(_trials(t)), ["model"]))


def _select_sql(cost: str) -> str:
    return f"""WITH {METRICS_SQL}, {_FRONT},
e AS (SELECT model, MIN(auroc) a0, MAX(auroc) a1, MIN(brier) b0, MAX(brier) b1 FROM front GROUP BY model),
s AS (SELECT front.*, (auroc - a0) / (a1 - a0 + 1e-10) AS g, 1 - (brier - b0) / (b1 - b0 + 1e-10) AS c
  FROM front JOIN e USING (model))
SELECT model, ARG_MIN(trial, ROW(ROUND({cost}, 9), trial)) AS trial,
  ROUND(ARG_MIN(auroc, ROW(ROUND({cost}, 9), trial)), 9) AS auroc,
  ROUND(ARG_MIN(brier, ROW(ROUND({cost}, 9), trial)), 9) AS brier FROM s GROUP BY model"""


def _selected(t: Tables, strategy: str):
    front = M.pareto_frontier(R.checkpointed(_trials(t)), ["model"])
    return rounded(M.select_trial(front, strategy, ["model"]))


@query("knee_trial", _select_sql("SQRT((1 - g) ** 2 + (1 - c) ** 2)"))
def _knee_trial(t: Tables):
    return _selected(t, "knee")


@query("balanced_trial", _select_sql("-(g + c)"))
def _balanced(t: Tables):
    return _selected(t, "balanced")


@query("extreme_trial", _select_sql("-auroc"))
def _extreme(t: Tables):
    return _selected(t, "extreme_auroc")
