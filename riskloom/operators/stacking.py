"""Stacking of base models on their out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.joins import join_on_keys
from riskloom.functions.prob import logit
from riskloom.operators.calibrate import OOFCalibrator, apply_base_calibration, positive_probability
from riskloom.operators.splits import fold_column
from riskloom.operators.train import with_class_weights
from riskloom.session import checkpointed


def id_mismatches(
    predictions: DataFrame, models: Sequence[str], keys: Sequence[str] = (), id_col: str = "id"
) -> DataFrame:
    """Rows that some of the models lack, with the models that have them."""
    rows = predictions.where(F.col("model").isin(*models))
    return (
        rows.groupBy(*keys, id_col)
        .agg(F.array_sort(F.collect_set("model")).alias("models"))
        .where(F.size("models") != len(set(models)))
    )


def require_same_ids(predictions: DataFrame, models: Sequence[str], **kw) -> None:
    row = id_mismatches(predictions, models, **kw).first()
    if row is not None:
        raise ValueError(f"models disagree on rows: {row.asDict()}")


def meta_features(
    predictions: DataFrame,
    models: Sequence[str],
    keep: Sequence[str] = (),
    use_logits: bool = True,
    id_col: str = "id",
) -> DataFrame:
    """One row per id and one column ``oof_<model>``: the mean over repeats.

    ``keep`` names columns that are constant per id, such as ``y_true``.
    """
    rows = predictions.where(F.col("model").isin(*models))
    mean = lambda m: F.avg(F.when(F.col("model") == m, F.col("y_prob")))
    value = (lambda c: logit(c)) if use_logits else (lambda c: c)
    return rows.groupBy(id_col).agg(
        *[F.max(k).alias(k) for k in keep], *[value(mean(m)).alias(f"oof_{m}") for m in models]
    )


def collect_meta(
    predictions: DataFrame,
    models: Sequence[str],
    calibrators: dict[str, OOFCalibrator] | None = None,
    keep: Sequence[str] = ("y_true",),
    use_logits: bool = True,
) -> DataFrame:
    """Meta features after base calibration; all models must cover the same rows."""
    require_same_ids(predictions, models)
    rows = apply_base_calibration(predictions, calibrators) if calibrators else predictions
    return meta_features(rows, models, keep, use_logits)


@dataclass
class Stacker:
    """Fitted meta-model with its optional isotonic map."""

    models: list[str]
    use_logits: bool
    pipeline: PipelineModel
    calibrator: OOFCalibrator | None = None

    def predict(self, meta: DataFrame) -> DataFrame:
        """Add ``y_prob``; a row that lacks a base score gets NULL."""
        columns = [f"oof_{m}" for m in self.models]
        complete = meta.dropna(subset=columns)
        scored = self.pipeline.transform(complete).select(
            *meta.columns, positive_probability().alias("y_prob")
        )
        if self.calibrator is not None:
            scored = self.calibrator.transform(scored)
        lacking = meta.where(
            F.greatest(*[F.col(c).isNull() for c in columns])
            if len(columns) > 1
            else F.col(columns[0]).isNull()
        )
        return scored.unionByName(lacking.withColumn("y_prob", F.lit(None).cast("double")))

    def coefficients(self, spark) -> DataFrame:
        """(base_model, coefficient) of the meta-model."""
        values = self.pipeline.stages[-1].coefficients.toArray()
        rows = [(m, float(v)) for m, v in zip(self.models, values, strict=True)]
        return spark.createDataFrame(rows, "base_model string, coefficient double")


def fit_stacker(
    meta: DataFrame,
    models: Sequence[str],
    penalty: str = "l2",
    c: float = 1.0,
    calibrate: bool = True,
    calibration_folds: int = 5,
    use_logits: bool = True,
    seed: int = 42,
    id_col: str = "id",
    y_col: str = "y_true",
) -> Stacker:
    """Scaled, balanced logistic regression over base scores.

    With ``calibrate`` an isotonic map is fitted on meta scores of rows held
    out from the meta-model.
    """
    columns = [f"oof_{m}" for m in models]
    rows = meta.dropna(subset=[*columns, y_col]).select(
        F.col(id_col).alias("id"), F.col(y_col).cast("int").alias("y"), *columns
    )
    rows = checkpointed(with_class_weights(rows))
    n = rows.count()
    ratio = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.5}[penalty]
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="features"),
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
            LogisticRegression(
                featuresCol="scaled",
                labelCol="y",
                weightCol="weight",
                regParam=1.0 / (c * max(1, n)),
                elasticNetParam=ratio,
                standardization=False,
            ),
        ]
    )
    calibrator = None
    if calibrate and n >= 2 * calibration_folds:
        folds = fold_column(rows, calibration_folds, 1, seed).select("id", "fold")
        split = checkpointed(rows.join(folds, "id"))
        held_out = None
        for k in range(calibration_folds):
            part = pipeline.fit(split.where(F.col("fold") != k)).transform(
                split.where(F.col("fold") == k)
            )
            part = part.select(F.col("y").alias("y_true"), positive_probability().alias("y_prob"))
            held_out = part if held_out is None else held_out.unionByName(part)
        calibrator = OOFCalibrator("isotonic").fit(checkpointed(held_out))
    return Stacker(list(models), use_logits, pipeline.fit(rows), calibrator)


def stack_from_run(
    oof: DataFrame,
    split_predictions: DataFrame,
    models: Sequence[str],
    calibrators: dict[str, OOFCalibrator] | None = None,
    **kw,
) -> tuple[Stacker, DataFrame]:
    """Fit on out-of-fold rows and score every other split.

    ``split_predictions`` has a ``split`` column (VAL, TEST); returns the
    stacker and the ensemble's prediction rows.
    """
    use_logits = kw.get("use_logits", True)
    stacker = fit_stacker(
        collect_meta(oof, models, calibrators, use_logits=use_logits), models, **kw
    )
    rows = apply_base_calibration(split_predictions, calibrators) if calibrators else split_predictions
    mismatch = id_mismatches(rows, models, keys=["split"]).first()
    if mismatch is not None:
        raise ValueError(f"models disagree on rows: {mismatch.asDict()}")
    keyed = rows.withColumn("__row", F.struct("split", "id"))
    meta = meta_features(keyed, models, ["y_true", "split"], use_logits, "__row")
    scored = stacker.predict(meta.withColumn("id", F.col("__row.id")).drop("__row"))
    return stacker, scored.select("id", "split", "y_true", "y_prob", F.lit("ENSEMBLE").alias("model"))


def same_rows(a: DataFrame, b: DataFrame, id_col: str = "id") -> bool:
    """True if two prediction tables cover the same ids."""
    left, right = a.select(id_col).distinct(), b.select(id_col).distinct()
    return (
        join_on_keys(left, right, [id_col], "left_anti").isEmpty()
        and join_on_keys(right, left, [id_col], "left_anti").isEmpty()
    )
