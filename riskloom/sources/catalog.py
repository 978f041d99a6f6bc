"""Results catalog: Parquet tables keyed by scenario, model and split seed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.dca import dca_summary
from riskloom.operators.panels import panel_uncertainty, stable_features
from riskloom.operators.prepare import CONTROL
from riskloom.operators.splits import HOLDOUT, same_splits, validate_splits
from riskloom.operators.summarize import ENSEMBLE, fill_from_repeats, long_parameters
from riskloom.sources.cohort import exists

KEYS = ("scenario", "model", "split_seed")


class Catalog:
    """Tables under one root folder, each partitioned by its key columns."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        return exists(self.spark, self.path(name))

    def read(self, name: str, **keys) -> DataFrame:
        """A table, restricted to the given key values (partition pruning)."""
        df = self.spark.read.option("mergeSchema", True).parquet(self.path(name))
        for key, value in keys.items():
            df = df.where(F.col(key) == value)
        return df

    def write(self, name: str, df: DataFrame, keys: Sequence[str] = ()) -> None:
        """Replace the partitions that ``df`` holds; other partitions stay."""
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*keys) if keys else writer).parquet(self.path(name))

    def append(self, name: str, df: DataFrame, keys: Sequence[str] = ()) -> None:
        writer = df.write.mode("append")
        (writer.partitionBy(*keys) if keys else writer).parquet(self.path(name))

    def partitions(self, name: str, key: str, **keys) -> list:
        """Values of a partition column, sorted."""
        if not self.has(name):
            return []
        rows = self.read(name, **keys).select(key).distinct().orderBy(key).collect()
        return [r[0] for r in rows]

    # -- splits --------------------------------------------------------------

    def save_splits(self, splits: DataFrame, overwrite: bool = False) -> bool:
        """Write (scenario, split_seed, split, id); False if the same is there.

        Different rows under the same scenario and seed are an error unless
        ``overwrite``.
        """
        keys = ["scenario", "split_seed"]
        rows = splits.select(*keys, "split", "id")
        if self.has("splits"):
            mine = rows.select(*keys).distinct()
            stored = self.read("splits").select(*rows.columns).join(mine, keys, "left_semi")
            if not stored.isEmpty():
                if same_splits(rows, stored):
                    return False
                if not overwrite:
                    raise FileExistsError("different splits exist for this scenario and seed")
        self.write("splits", rows, keys)
        return True

    def load_splits(
        self, scenario: str, split_seed: int | None = None, base: DataFrame | None = None
    ) -> DataFrame:
        """Validated split rows without the holdout."""
        rows = self.read("splits", scenario=scenario).where(F.col("split") != HOLDOUT)
        if split_seed is not None:
            rows = rows.where(F.col("split_seed") == split_seed)
        validate_splits(rows, base)
        return rows

    def save_holdout(self, ids: DataFrame, scenario: str, overwrite: bool = False) -> bool:
        """Write holdout ids as split HOLDOUT of seed −1."""
        rows = ids.select("id").withColumns(
            {
                "scenario": F.lit(scenario),
                "split_seed": F.lit(-1),
                "split": F.lit(HOLDOUT),
            }
        )
        return self.save_splits(rows, overwrite)

    def load_holdout(self, scenario: str) -> DataFrame:
        rows = self.read("splits", scenario=scenario).where(F.col("split") == HOLDOUT).select("id")
        if rows.isEmpty():
            raise ValueError(f"no holdout for scenario {scenario}")
        return rows

    def save_split_metadata(
        self, summary: DataFrame, scenario: str, extra: Mapping[str, str] | None = None
    ) -> None:
        """Replace the scenario's rows, one per split: counts, prevalence, digest and settings."""
        entries = [F.lit(str(x)) for kv in (extra or {}).items() for x in kv]
        settings = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
        rows = summary.withColumns({"scenario": F.lit(scenario), "settings": settings})
        self.write("split_metadata", rows, ["scenario"])

    def save_holdout_metadata(
        self, summary: DataFrame, scenario: str, extra: Mapping[str, str] | None = None
    ) -> None:
        """One row of the holdout: counts, prevalence, digest and free settings."""
        entries = [F.lit(str(x)) for kv in (extra or {}).items() for x in kv]
        settings = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
        rows = summary.withColumns({"scenario": F.lit(scenario), "settings": settings})
        self.write("holdout_metadata", rows, ["scenario"])

    def load_split_metadata(self, scenario: str, split_seed: int | None = None) -> DataFrame | None:
        if not self.has("split_metadata"):
            return None
        rows = self.read("split_metadata", scenario=scenario)
        if split_seed is not None:
            rows = rows.where(F.col("split_seed") == split_seed)
        return None if rows.isEmpty() else rows

    # -- predictions and metrics ----------------------------------------------

    def save_predictions(self, predictions: DataFrame) -> None:
        self.write("predictions", predictions, ["scenario", "split", "model", "split_seed"])

    def predictions(self, **keys) -> DataFrame:
        return self.read("predictions", **keys)

    def ensemble_predictions(self, **keys) -> DataFrame:
        return self.read("predictions", **{**keys, "model": ENSEMBLE})

    def metrics(self, **keys) -> DataFrame:
        return self.read("metrics", **keys)

    def feature_reports(self, **keys) -> DataFrame:
        return self.read("feature_reports", **keys)

    def best_parameters(self, **keys) -> DataFrame:
        """(model, split_seed, param, value) of the parameter log."""
        return long_parameters(self.read("param_log", **keys), ["model", "split_seed"])

    def ensemble_parameters(self, **keys) -> DataFrame:
        """Settings of every stacked model."""
        return self.read("model_metadata", **{**keys, "model": ENSEMBLE})

    def models_with_results(
        self,
        only: Sequence[str] | None = None,
        skip_ensemble: bool = True,
        scenario: str | None = None,
    ) -> list[str]:
        where = {} if scenario is None else {"scenario": scenario}
        found = self.partitions("stability", "model", **where)
        if only:
            found = [m for m in found if m in set(only)]
        return [m for m in found if not (skip_ensemble and m == ENSEMBLE)]

    def stability(self, threshold: float = 0.0, **keys) -> DataFrame:
        return stable_features(self.read("stability", **keys), threshold)

    def elimination_ranking(self, **keys) -> DataFrame | None:
        if not self.has("rfe_ranking"):
            return None
        rows = self.read("rfe_ranking", **keys)
        return None if rows.isEmpty() else rows

    def append_cv_metrics(self, metrics: DataFrame) -> None:
        """Add metrics of new scenarios, models and seeds; a rerun replaces its own rows."""
        self.write("cv_metrics", metrics, [k for k in KEYS if k in metrics.columns])

    def save_pooled(self, pooled: DataFrame, name: str = "pooled_predictions") -> None:
        """Pooled rows by model; a missing score is the mean over repeat columns."""
        self.write(name, fill_from_repeats(pooled), ["model"])

    def save_thresholds(self, thresholds: DataFrame) -> None:
        """Thresholds by model, and by scenario and seed where the rows have them."""
        self.write("thresholds", thresholds, [k for k in KEYS if k in thresholds.columns])

    def save_consensus(self, result: Mapping[str, DataFrame], scenario: str = "") -> None:
        """Tables of one scenario's consensus; those of other scenarios stay."""
        parts = {name: result[name] for name in ("panel", "ranking", "per_model", "clusters")}
        parts["uncertainty"] = panel_uncertainty(result["panel"], result["ranking"])
        for name, table in parts.items():
            self.write(
                f"consensus_{name}", table.withColumn("scenario", F.lit(scenario)), ["scenario"]
            )

    def save_decision_curve(self, curve: DataFrame, group_cols: Sequence[str]) -> None:
        self.write("decision_curve", curve, list(group_cols))
        self.write("decision_summary", dca_summary(curve, group_cols), list(group_cols))

    def save_elimination(self, result, split_seed: int = 0, scenario: str = "") -> None:
        from riskloom.operators.pareto import knee_size, recommended_sizes

        keys = list(KEYS)
        key = {"scenario": F.lit(scenario), "split_seed": F.lit(split_seed)}
        curve = result.curve.withColumns(key)
        self.write("rfe_curve", curve, keys)
        self.write("rfe_ranking", result.ranking.withColumns(key), keys)
        sizes = curve.withColumnRenamed("auroc_val", "auroc")
        chosen = recommended_sizes(sizes, keys).join(knee_size(sizes, keys), keys)
        self.write("rfe_recommended", chosen, keys)

    def save_fold_eliminations(
        self, folds: Sequence[Mapping], model: str, split_seed: int = 0, scenario: str = ""
    ) -> None:
        """Tables of cross-validated elimination: folds, CV scores, consensus, summary."""
        from riskloom.operators.panels import fold_consensus, fold_summary

        keys = list(KEYS)
        named = "scenario string, model string, split_seed int, fold int"
        rows = [
            (scenario, model, split_seed, f["fold"], f["features"], f["val_auroc"]) for f in folds
        ]
        table = self.spark.createDataFrame(
            rows, f"{named}, features array<string>, val_auroc double"
        )
        scores = [
            (scenario, model, split_seed, f["fold"], int(size), score)
            for f in folds
            for size, score in f["cv_scores"].items()
        ]
        self.write("rfecv_folds", table, keys)
        self.write(
            "rfecv_scores",
            self.spark.createDataFrame(scores, f"{named}, size int, score double"),
            keys,
        )
        self.write("rfecv_consensus", fold_consensus(table, group_cols=keys), keys)
        self.write("rfecv_summary", fold_summary(table, keys), keys)

    # -- models ----------------------------------------------------------------

    def model_path(self, scenario: str, model: str, split_seed: int) -> str:
        return f"{self.root}/models/{scenario}/{model}/split_seed={split_seed}"

    def save_model(
        self,
        fitted: PipelineModel,
        scenario: str,
        model: str,
        split_seed: int,
        settings: Mapping[str, object] | None = None,
        calibrator=None,
    ) -> None:
        """Pipeline, calibrator and one metadata row."""
        path = self.model_path(scenario, model, split_seed)
        fitted.write().overwrite().save(f"{path}/pipeline")
        values = {k: str(v) for k, v in (settings or {}).items()}
        if calibrator is not None:
            values["calibrator"] = calibrator.method
            if calibrator.method == "isotonic":
                calibrator.model.write().overwrite().save(f"{path}/isotonic")
            else:
                values["calibrator_intercept"] = repr(calibrator.intercept)
                values["calibrator_slope"] = repr(calibrator.slope)
        row = self.spark.createDataFrame(
            [(scenario, model, split_seed, values)],
            "scenario string, model string, split_seed int, settings map<string,string>",
        )
        self.write("model_metadata", row, list(KEYS))

    def load_model(self, scenario: str, model: str, split_seed: int):
        """(pipeline, calibrator or None, settings)."""
        from pyspark.ml.regression import IsotonicRegressionModel

        from riskloom.operators.calibrate import OOFCalibrator

        path = self.model_path(scenario, model, split_seed)
        row = self.read("model_metadata", scenario=scenario, model=model, split_seed=split_seed).first()
        if row is None:
            raise FileNotFoundError(path)
        settings = dict(row["settings"])
        calibrator = None
        if settings.get("calibrator") == "isotonic":
            calibrator = OOFCalibrator("isotonic")
            calibrator.model = IsotonicRegressionModel.load(f"{path}/isotonic")
        elif settings.get("calibrator") == "sigmoid":
            calibrator = OOFCalibrator("sigmoid")
            calibrator.intercept = float(settings["calibrator_intercept"])
            calibrator.slope = float(settings["calibrator_slope"])
        return PipelineModel.load(f"{path}/pipeline"), calibrator, settings


def collect_prediction_files(
    spark: SparkSession, pattern: str, model: str | None = None
) -> DataFrame:
    """Per-split prediction CSVs as one table.

    ``split_seed`` comes from the folder ``split_seed<N>``, ``model`` from the
    file name after the last ``__`` (or as given), ``source_file`` is the path.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(pattern)
    file = F.input_file_name()
    name = F.lit(model) if model else F.regexp_extract(file, r"__([^/]+)\.csv$", 1)
    numbers = [c for c in raw.columns if c.startswith("y_")]
    return raw.withColumns({c: F.col(c).try_cast("double") for c in numbers}).withColumns(
        {
            "split_seed": F.regexp_extract(file, r"split_seed=?(\d+)", 1).cast("int"),
            "model": name,
            "source_file": file,
        }
    )


def collect_metric_files(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """Union by name of metric CSVs whose columns may differ."""
    out = None
    for pattern in patterns:
        part = spark.read.option("header", True).csv(pattern)
        part = part.withColumn(
            "split_seed", F.regexp_extract(F.input_file_name(), r"split_seed=?(\d+)", 1).cast("int")
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def collect_ensemble_metric_files(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON files with objects ``test`` and ``val`` as columns ``test_*`` and ``val_*``."""
    raw = spark.read.option("multiLine", True).json(pattern)
    columns: list[Column] = [
        F.regexp_extract(F.input_file_name(), r"split_seed=?(\d+)", 1).cast("int").alias("split_seed")
    ]
    for part in ("test", "val"):
        if part in raw.columns:
            columns += [
                F.col(f"{part}.{f.name}").alias(f"{part}_{f.name}")
                for f in raw.schema[part].dataType.fields
            ]
    return raw.select(*columns, F.lit(ENSEMBLE).alias("model"))


def export_table(
    predictions: DataFrame,
    risk_cols: Mapping[str, str],
    active: str = "adjusted",
    percentile: bool = True,
    keep: Sequence[str] = ("id", "y_true"),
) -> DataFrame:
    """Columns ``risk_<key>``, ``risk_<key>_pct`` and ``risk`` from the active key."""
    if active not in risk_cols:
        raise ValueError(f"unknown active risk {active!r}")
    out = [*[F.col(k) for k in keep]]
    for key, source in risk_cols.items():
        out.append(F.col(source).alias(f"risk_{key}"))
        if percentile:
            out.append((F.col(source) * 100.0).alias(f"risk_{key}_pct"))
    out.append(F.col(risk_cols[active]).alias("risk"))
    if percentile:
        out.append((F.col(risk_cols[active]) * 100.0).alias("risk_pct"))
    return predictions.select(*out)


def holdout_export(predictions: DataFrame, target_col: str = "target") -> DataFrame:
    """Holdout rows: id, target, outcome, raw and adjusted risk."""
    return predictions.select(
        "id",
        F.coalesce(F.col(target_col), F.lit(CONTROL)).alias("target"),
        "y_true",
        F.col("y_prob").alias("risk_raw"),
        F.col("y_prob_adjusted").alias("risk_adjusted"),
    )
