"""Preparation, row filters and splits (families B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators.covariates import fit_covariates
from riskloom.operators import prepare as P, splits as S
from riskloom.queries.registry import (
    COHORT_SQL,
    DATED_SQL,
    EVENTS_SQL,
    FEATURES_SQL,
    Tables,
    query,
    rounded,
)

COLS = {"target_col": "target"}
CASES = ["Incident", "Prevalent"]


@query("project_cohort_columns", """SELECT o_orderkey AS eid, o_orderstatus AS "CeD_comparison",
  o_totalprice AS price_resid FROM orders""")
def _project(t: Tables):
    named = t.orders.select(
        F.col("o_orderkey").alias("eid"),
        F.col("o_orderstatus").alias("CeD_comparison"),
        F.col("o_totalprice").alias("price_resid"),
        F.col("o_orderpriority").alias("note"),
    )
    return P.project_cohort(named)


@query("missing_per_feature", f"""WITH {COHORT_SQL}
SELECT 'age' AS feature, COUNT(*) - COUNT(age) AS n_missing FROM cohort
UNION ALL SELECT 'bmi', COUNT(*) - COUNT(bmi) FROM cohort""")
def _missing(t: Tables):
    return P.missing_counts(t.cohort(), ["age", "bmi"])


@query("data_summary", f"""WITH {COHORT_SQL}
SELECT COUNT(*) AS n_rows, 6 AS n_columns, 0 AS n_features,
  COUNT(*) FILTER (target = 'Controls') AS n_controls,
  COUNT(*) FILTER (target = 'Incident') AS n_incident,
  COUNT(*) FILTER (target = 'Prevalent') AS n_prevalent,
  COUNT(*) - COUNT(age) AS missing_age, COUNT(*) - COUNT(sex) AS missing_sex FROM cohort""")
def _summary(t: Tables):
    return P.data_summary(t.cohort(), "target")


_KEPT = """NOT (target = 'Controls' AND event_date IS NOT NULL)"""


@query("filter_rows", f"""WITH {COHORT_SQL}
SELECT id, target, ROUND(age, 9) AS age, ROUND(bmi, 9) AS bmi FROM cohort
WHERE {_KEPT} AND age IS NOT NULL AND bmi IS NOT NULL""")
def _filter(t: Tables):
    out = P.filter_rows(t.cohort(), numeric=["age", "bmi"], target_col="target", date_col="event_date")
    return rounded(out.select("id", "target", "age", "bmi"))


@query("filter_audit", f"""WITH {COHORT_SQL}
SELECT COUNT(*) AS n_in, COUNT(*) FILTER (NOT ({_KEPT})) AS n_removed_uncertain_controls,
  COUNT(*) FILTER ({_KEPT} AND (age IS NULL OR bmi IS NULL)) AS n_removed_dropna_meta_num,
  COUNT(*) FILTER ({_KEPT} AND age IS NOT NULL AND bmi IS NOT NULL) AS n_out FROM cohort""")
def _audit(t: Tables):
    return P.filter_audit(
        t.cohort(), numeric=["age", "bmi"], target_col="target", date_col="event_date"
    )


@query("scenario_outcomes", f"""WITH {COHORT_SQL}
SELECT id, target, CASE WHEN target = 'Incident' THEN 1 ELSE 0 END AS y FROM cohort
WHERE target IN ('Controls', 'Incident')""")
def _scenario(t: Tables):
    rows = P.scenario_rows(t.cohort(), "IncidentOnly", "target")
    return P.with_outcome(rows, P.positive_label("IncidentOnly"), "target").select(
        "id", "target", "y"
    )


@query("scenario_case_labels", f"""WITH {COHORT_SQL}
SELECT target, CASE WHEN target <> 'Controls' THEN 1 ELSE 0 END AS y, COUNT(*) AS n
FROM cohort GROUP BY ALL""")
def _positives(t: Tables):
    positives = P.scenario_positives("IncidentPlusPrevalent")
    rows = P.with_outcome(t.cohort(), positives, "target")
    return rows.groupBy("target", "y").agg(F.count(F.lit(1)).alias("n"))


@query("coerce_to_number", """SELECT doc_id, TRY_CAST(SPLIT_PART(source, 'src', 2) AS DOUBLE) AS a,
  TRY_CAST(lang AS DOUBLE) AS b FROM documents""")
def _coerce(t: Tables):
    docs = t.documents.select(
        "doc_id", F.split_part("source", F.lit("src"), F.lit(2)).alias("a"), F.col("lang").alias("b")
    )
    return P.coerce_numeric(docs, ["a", "b"])


@query("fill_missing_category", f"""WITH {COHORT_SQL}
SELECT COALESCE(sex, 'Missing') AS sex, COUNT(*) AS n FROM cohort GROUP BY 1""")
def _fill(t: Tables):
    return P.fill_missing_category(t.cohort(), ["sex"]).groupBy("sex").agg(
        F.count(F.lit(1)).alias("n")
    )


_CATEGORIES = """COUNT(*) FILTER ({c} = 'Controls') AS controls,
  COUNT(*) FILTER ({c} = 'Incident') AS incident,
  COUNT(*) FILTER ({c} = 'Prevalent') AS prevalent, COUNT(*) AS total"""


@query("category_counts", f"""WITH {COHORT_SQL} SELECT {_CATEGORIES.format(c="target")} FROM cohort""")
def _categories(t: Tables):
    return P.category_counts(t.cohort(), [], "target")


@query("category_counts_per_split", f"""WITH {EVENTS_SQL}
SELECT split_seed, {_CATEGORIES.format(c="category")} FROM pred GROUP BY split_seed""")
def _categories_per_split(t: Tables):
    return P.category_counts(t.event_predictions(), ["split_seed"])


@query("probability_report", f"""WITH {EVENTS_SQL}
SELECT model, 0 AS n_missing, 0 AS n_infinite, COUNT(*) FILTER (q < 0 OR q > 1) AS n_outside,
  ROUND(MIN(q), 9) AS p_min, ROUND(MAX(q), 9) AS p_max
FROM (SELECT model, y_prob * 1.25 AS q FROM pred) GROUP BY model""")
def _probabilities(t: Tables):
    rows = t.event_predictions().withColumn("q", F.col("y_prob") * 1.25)
    return rounded(P.probability_report(rows, ["model"], "q"))


@query("two_class_report", f"""WITH {EVENTS_SQL}
SELECT category, COUNT(*) FILTER (y_true = 1) AS n_pos, COUNT(*) FILTER (y_true = 0) AS n_neg,
  COUNT(DISTINCT y_true) = 2 AS two_classes FROM pred GROUP BY category""")
def _classes(t: Tables):
    return P.class_report(t.event_predictions(), ["category"])


@query("melt_features", f"""WITH {FEATURES_SQL}
SELECT id, feature, ROUND(value, 6) AS value FROM features""")
def _melt(t: Tables):
    return rounded(t.features().select("id", "feature", "value"), 6)


@query("preprocess_features")
def _preprocess(t: Tables):
    from pyspark.ml.functions import vector_to_array

    rows = P.filter_rows(t.cohort(), numeric=["age", "bmi"], target_col="target", date_col="event_date")
    rows = P.fill_missing_category(rows, ["sex"])
    fitted = P.preprocessor(rows, ["age", "bmi"], ["sex"]).fit(rows)
    return fitted.transform(rows).select("id", vector_to_array("features").alias("features"))


@query("holdout_rows", f"""WITH {DATED_SQL}
SELECT id, target FROM dated
QUALIFY ROW_NUMBER() OVER (ORDER BY event_time, id) > COUNT(*) OVER () -
  CAST(ROUND(CAST('0.3' AS DOUBLE) * COUNT(*) OVER ()) AS BIGINT)""")
def _holdout_rows(t: Tables):
    cohort = t.dated_cohort()
    parts = S.carve_holdout(cohort, 0.3, "event_time", target_col="target")
    assigned = parts.where(F.col("part") == "HOLDOUT").select("id", F.col("part").alias("split"))
    return P.split_rows(cohort, assigned, "HOLDOUT").select("id", "target")


_AGED = """m AS (SELECT QUANTILE_CONT(age, 0.5) AS med FROM cohort),
aged AS (SELECT *, COALESCE(age, med) AS a, COALESCE(sex, 'UnknownSex') AS sx FROM cohort, m),
binned AS (SELECT *, CASE WHEN a > 0 AND a <= 150 THEN
    CASE WHEN a <= 40 THEN 'young' WHEN a <= 60 THEN 'middle' ELSE 'old' END ELSE 'nan' END AS b3,
  CASE WHEN a > 0 AND a <= 150 THEN CASE WHEN a <= 60 THEN 'lt60' ELSE 'ge60' END ELSE 'nan' END AS b2
  FROM aged)"""
_FINE = "target || '_' || sx || '_' || b3"


@query("age_bins", f"""WITH {COHORT_SQL}, {_AGED} SELECT id, b3, b2 FROM binned""")
def _age_bins(t: Tables):
    rows = S.with_filled_age(t.cohort())
    return rows.select(
        "id",
        S.age_bin(F.col("__age"), "age3").alias("b3"),
        S.age_bin(F.col("__age"), "age2").alias("b2"),
    )


@query("strata", f"""WITH {COHORT_SQL}, {_AGED} SELECT id, {_FINE} AS stratum FROM binned""")
def _strata(t: Tables):
    return S.with_strata(t.cohort(), "outcome+sex+age3", "target").select("id", "stratum")


@query("collapse_rare_strata", f"""WITH {COHORT_SQL}, {_AGED},
s AS (SELECT id, target, {_FINE} AS stratum FROM binned),
n AS (SELECT stratum, COUNT(*) AS n FROM s GROUP BY stratum)
SELECT id, CASE WHEN n < 20 THEN target || '_RARE' ELSE stratum END AS stratum
FROM s JOIN n USING (stratum)""")
def _collapse(t: Tables):
    rows = S.with_strata(t.cohort(), "outcome+sex+age3", "target")
    return S.collapse_rare(rows, 20, "target").select("id", "stratum")


_SCHEMES = f"""l AS (SELECT target, UNNEST([0, 1, 2, 3, 4]) AS no,
  UNNEST(['outcome+sex+age3', 'outcome+sex+age2', 'outcome+age3', 'outcome+sex', 'outcome']) AS scheme,
  UNNEST([{_FINE}, target || '_' || sx || '_' || b2, target || '_' || b3, target || '_' || sx, target])
    AS stratum FROM binned),
n AS (SELECT no, scheme, target, stratum, COUNT(*) AS n FROM l GROUP BY ALL),
c AS (SELECT no, scheme, CASE WHEN n < 2 THEN target || '_RARE' ELSE stratum END AS stratum,
  SUM(n) AS n FROM n GROUP BY ALL)"""


@query("stratification_schemes", f"""WITH {COHORT_SQL}, {_AGED}, {_SCHEMES}
SELECT no, scheme, CAST(MIN(n) AS BIGINT) AS smallest, COUNT(*) AS n_strata FROM c GROUP BY no, scheme""")
def _schemes(t: Tables):
    return S.scheme_sizes(t.cohort(), 2, "target")


@query("smallest_stratum", f"""WITH {COHORT_SQL}, {_AGED},
n AS (SELECT {_FINE} AS stratum, COUNT(*) AS n FROM binned GROUP BY 1)
SELECT MIN(n) AS smallest, COUNT(*) AS n_strata, MIN(n) >= 2 AS valid FROM n""")
def _smallest(t: Tables):
    return S.smallest_stratum(S.with_strata(t.cohort(), "outcome+sex+age3", "target"))


@query("downsample_controls", f"""WITH {DATED_SQL},
n AS (SELECT COUNT(*) FILTER (target = 'Incident') AS cases FROM dated)
SELECT target, CASE WHEN target = 'Controls' THEN CAST(ROUND_EVEN(cases * 0.5, 0) AS BIGINT)
  ELSE cases END AS n FROM n, (SELECT UNNEST(['Controls', 'Incident']) AS target)""")
def _downsample(t: Tables):
    rows = S.downsample_controls(t.dated_cohort(), ["Incident"], 0.5, target_col="target", seed=7)
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("temporal_order", f"""WITH {DATED_SQL}
SELECT id, CAST(EPOCH_US(event_time) AS DOUBLE) AS order_value FROM dated""")
def _temporal_order(t: Tables):
    return S.in_temporal_order(t.dated_cohort(), "event_time").select("id", "order_value")


@query("temporal_split", f"""WITH {DATED_SQL},
r AS (SELECT id, ROW_NUMBER() OVER (ORDER BY event_time, id) AS rn, COUNT(*) OVER () AS n FROM dated)
SELECT id, CASE WHEN rn <= n - ROUND_EVEN(n * 0.25, 0) - ROUND_EVEN(n * 0.15, 0) THEN 'TRAIN'
  WHEN rn <= n - ROUND_EVEN(n * 0.25, 0) THEN 'VAL' ELSE 'TEST' END AS split FROM r""")
def _temporal_split(t: Tables):
    return S.temporal_split(t.dated_cohort(), "event_time", 0.15, 0.25).select("id", "split")


def _remainder(table: str, n: str, total: str, out: str) -> str:
    """Largest-remainder shares of ``total`` over the strata of ``table``."""
    return f"""(SELECT *, CAST(FLOOR(x) + CASE WHEN ROW_NUMBER() OVER (ORDER BY x - FLOOR(x) DESC, stratum)
      <= total - SUM(FLOOR(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS {out}
    FROM (SELECT *, {total} AS total, {n} * ({total}) / CAST(SUM({n}) OVER () AS DOUBLE) AS x FROM {table}))"""


@query("prevalent_cases_for_training", f"""WITH {DATED_SQL},
n AS (SELECT COUNT(*) AS n FROM dated WHERE target = 'Prevalent')
SELECT UNNEST([0, 1, 2]) AS split_seed, CAST(LEAST(n, GREATEST(1, ROUND_EVEN(n * 0.3, 0))) AS BIGINT) AS n
FROM n""")
def _prevalent(t: Tables):
    rows = S.sample_prevalent(t.dated_cohort(), 0.3, [0, 1, 2], target_col="target")
    return rows.groupBy("split_seed").agg(F.count_distinct("id").alias("n"))


@query("stratified_split_sizes", f"""WITH {COHORT_SQL}, {_AGED},
n0 AS (SELECT {_FINE} AS stratum, target, COUNT(*) AS n FROM binned GROUP BY ALL),
sz AS (SELECT CASE WHEN n < 2 THEN target || '_RARE' ELSE stratum END AS stratum,
  CAST(SUM(n) AS BIGINT) AS n FROM n0 GROUP BY 1),
tr AS (SELECT stratum, n, n_train, n - n_train AS n_rest FROM
  {_remainder("sz", "n", "SUM(n) OVER () - CEIL(0.5 * SUM(n) OVER ())", "n_train")}),
va AS (SELECT stratum, n_train, n_rest, n_val FROM
  {_remainder("tr", "n_rest", "SUM(n_rest) OVER () - CEIL(0.5 * SUM(n_rest) OVER ())", "n_val")}),
u AS (SELECT stratum, UNNEST(['TRAIN', 'VAL', 'TEST']) AS split,
  UNNEST([n_train, n_val, n_rest - n_val]) AS n FROM va)
SELECT seed AS split_seed, stratum, split, n
FROM u CROSS JOIN (SELECT UNNEST([0, 1, 2]) AS seed) WHERE n > 0""")
def _stratified(t: Tables):
    fine = S.with_strata(t.cohort(), "outcome+sex+age3", "target")
    rows = S.collapse_rare(fine, 2, "target")
    out = S.stratified_split(rows, [0, 1, 2], 0.25, 0.25)
    return out.groupBy("split_seed", "stratum", "split").agg(F.count_distinct("id").alias("n"))


@query("holdout_sizes", f"""WITH {DATED_SQL}, n AS (SELECT COUNT(*) AS n FROM dated)
SELECT 'HOLDOUT' AS part, CAST(CEIL(CAST('0.3' AS DOUBLE) * n) AS BIGINT) AS n FROM n
UNION ALL SELECT 'dev', n - CAST(CEIL(CAST('0.3' AS DOUBLE) * n) AS BIGINT) FROM n""")
def _holdout_sizes(t: Tables):
    rows = t.dated_cohort().withColumn("sex", F.lit(None).cast("string")).drop("age")
    parts = S.carve_holdout(rows, 0.3, target_col="target")
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def _split_table(t: Tables):
    table, _ = S.repeated_splits(
        t.cohort(),
        P.scenario_positives("IncidentPlusPrevalent"),
        [0, 1, 2],
        prevalent_train_only=True,
        prevalent_fraction=0.5,
        train_controls_per_case=2.0,
        target_col="target",
    )
    return table


@query("repeated_splits")
def _repeated(t: Tables):
    return _split_table(t)


@query("split_summary")
def _split_summary(t: Tables):
    return S.summarize_splits(_split_table(t), ["split_seed", "split"])


def _with_violations(t: Tables):
    """The split table and a seed 900 that breaks both rules on known rows."""
    known = t.cohort().select("id", "target", F.lit(900).alias("split_seed"))
    extra = F.when(F.col("id") % 10 == 0, F.lit("TEST")).when(F.col("id") % 10 == 3, F.lit("VAL"))
    planted = known.select("*", F.explode(F.array_compact(F.array(F.lit("TRAIN"), extra))).alias("split"))
    columns = ["split_seed", "id", "target", "split"]
    return _split_table(t).select(*columns).unionByName(planted.select(*columns))


@query("split_overlap", """SELECT 900 AS split_seed, c_custkey AS id,
  CASE WHEN c_custkey % 10 = 0 THEN 'TEST,TRAIN' ELSE 'TRAIN,VAL' END AS splits
FROM customer WHERE c_custkey % 10 IN (0, 3)""")
def _overlap(t: Tables):
    out = S.split_overlap(_with_violations(t))
    return out.withColumn("splits", F.array_join("splits", ","))


@query("prevalent_leakage", """SELECT 900 AS split_seed, c_custkey AS id,
  CASE WHEN c_custkey % 10 = 0 THEN 'TEST' ELSE 'VAL' END AS split
FROM customer WHERE c_custkey % 10 IN (0, 3) AND c_nationkey >= 22""")
def _leakage(t: Tables):
    found = S.prevalent_in_evaluation(_with_violations(t), "target")
    return found.select("split_seed", "id", "split")


@query("stratified_folds", f"""WITH {DATED_SQL},
n AS (SELECT target, COUNT(*) AS n FROM dated GROUP BY target)
SELECT r.repeat, target, f.fold, (n - f.fold + 4) // 5 AS n
FROM n, (SELECT UNNEST([0, 1, 2]) AS repeat) r, (SELECT UNNEST([0, 1, 2, 3, 4]) AS fold) f""")
def _folds(t: Tables):
    out = S.fold_column(t.dated_cohort(), 5, 3, 11, stratum_col="target")
    return out.groupBy("repeat", "target", "fold").agg(F.count_distinct("id").alias("n"))


@query("training_size_prefixes", f"""WITH {DATED_SQL},
n AS (SELECT target, COUNT(*) AS n FROM dated GROUP BY target)
SELECT target, frac AS fraction, CAST(CEIL(frac * n) AS BIGINT) AS n
FROM n, (SELECT UNNEST([CAST('0.25' AS DOUBLE), CAST('0.5' AS DOUBLE), CAST('1' AS DOUBLE)]) AS frac)""")
def _prefixes(t: Tables):
    out = S.training_prefix(t.dated_cohort(), [0.25, 0.5, 1.0], 3, stratum_col="target")
    return out.groupBy("target", "fraction").agg(F.count_distinct("id").alias("n"))


@query("covariate_values", f"""WITH {COHORT_SQL}, train AS (SELECT * FROM cohort WHERE id % 2 = 0),
m AS (SELECT AVG(age) AS age, AVG(bmi) AS bmi FROM train),
v AS (SELECT sex AS level, ROW_NUMBER() OVER (ORDER BY sex) AS place FROM (SELECT DISTINCT sex FROM train WHERE sex IS NOT NULL))
SELECT id, 'age' AS feature, ROUND(COALESCE(cohort.age, m.age), 9) AS value FROM cohort, m
UNION ALL SELECT id, 'bmi', ROUND(COALESCE(cohort.bmi, m.bmi), 9) FROM cohort, m
UNION ALL SELECT id, 'sex_' || level, CASE WHEN sex = level THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM cohort, v WHERE place > 1""")
def _covariate_values(t: Tables):
    rows = t.cohort()
    fitted = fit_covariates(rows.where("id % 2 = 0"), ["age", "bmi"], ["sex"])
    return rounded(P.melt_array(rows.select("id", fitted.values().alias("a")), "a", ["id"], names=fitted.names))
