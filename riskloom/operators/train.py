"""Model training, search, nested cross-validation and feature elimination.

Frames here hold one row per person with ``id``, ``y`` and a vector column
``features``; ``names`` lists the features in vector order. Loops run over
folds, candidates and panel sizes, never over rows.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVCModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import (
    SQLTransformer,
    StandardScaler,
    StandardScalerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import curves as C
from riskloom.operators import linear_cv
from riskloom.operators import screen as S
from riskloom.operators.boosting import GBTClassifier
from riskloom.operators.calibrate import OOFCalibrator, positive_probability
from riskloom.operators.discrimination import discrimination_aggregates, brier_of_counts
from riskloom.operators.fits import MAX_FEATURES, Fit, fit_many, moments, pack
from riskloom.operators.forest import RandomForestClassifier
from riskloom.operators.machines import LinearSVC
from riskloom.operators.panels import importance_selection
from riskloom.operators.prepare import melt_array
from riskloom.operators.splits import even_fractions, fold_column, hash_ranked, training_prefix
from riskloom.session import checkpointed, ensure_checkpoint_dir, in_order

MODELS = ("LR_EN", "LR_L1", "LinSVM_cal", "RF", "XGBoost")
MAX_TREE_DEPTH = 30
#: Rows that one task of a tree fit reads at least.
TREE_TASK_ROWS = 10_000
#: Forests of a cross-validation that grow side by side.
FORESTS_AT_ONCE = 4
#: Terms of a margin that a row carries while features are shuffled.
TERMS = 256

# Default search grids per model.
LR_C = (1e-4, 100.0, 7)
LR_L1_RATIO = (0.1, 0.5, 0.9)
SVM_C = (0.01, 10.0, 4)
RF_GRID = {
    "n_estimators": [100, 300, 500],
    "max_depth": [None, 10, 20, 30],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2", 0.5],
}
BOOST_GRID = {
    "n_estimators": [100, 300, 500],
    "max_depth": [3, 5, 7, 10],
    "learning_rate": [0.01, 0.05, 0.1, 0.3],
    "subsample": [0.7, 0.8, 1.0],
    "colsample": [0.7, 0.8, 1.0],
    "min_child_weight": [1, 3, 5],
}


def log_spaced(low: float, high: float, n: int) -> list[float]:
    if n < 1:
        return []
    if n == 1:
        return [math.sqrt(low * high)]
    return [float(v) for v in np.logspace(math.log10(low), math.log10(high), n)]


def parameter_grid(
    model_name: str, overrides: Mapping[str, Sequence] | None = None, jitter_seed: int | None = None
) -> dict[str, list]:
    """Value lists per parameter; a jitter seed scales float values by ±20%."""
    if model_name == "LR_EN":
        grid = {"C": log_spaced(*LR_C), "l1_ratio": list(LR_L1_RATIO)}
    elif model_name == "LR_L1":
        grid = {"C": log_spaced(*LR_C)}
    elif model_name == "LinSVM_cal":
        grid = {"C": log_spaced(*SVM_C)}
    elif model_name == "RF":
        grid = {k: list(v) for k, v in RF_GRID.items()}
    elif model_name == "XGBoost":
        grid = {k: list(v) for k, v in BOOST_GRID.items()}
    else:
        raise ValueError(f"unknown model {model_name!r}, one of {MODELS}")
    grid.update({k: list(v) for k, v in (overrides or {}).items()})
    if jitter_seed is not None:
        rng = random.Random(jitter_seed)
        bounded = {"l1_ratio": 1.0, "subsample": 1.0, "colsample": 1.0, "max_features": 1.0}

        def shake(name: str, value):
            if not isinstance(value, float):
                return value
            return min(value * rng.uniform(0.8, 1.2), bounded.get(name, math.inf))

        grid = {k: [shake(k, v) for v in vs] for k, vs in grid.items()}
    return grid


def candidates(grid: Mapping[str, Sequence], n_iter: int | None = None, seed: int = 0) -> list[dict]:
    """All combinations, or ``n_iter`` distinct random ones."""
    names = list(grid)
    size = math.prod(len(grid[n]) for n in names)
    if n_iter is None or n_iter >= size:
        return [dict(zip(names, c, strict=True)) for c in itertools.product(*grid.values())]
    out = []
    for number in random.Random(seed).sample(range(size), n_iter):
        choice = {}
        for n in names:
            number, k = divmod(number, len(grid[n]))
            choice[n] = grid[n][k]
        out.append(choice)
    return out


def class_weight(df: DataFrame, y_col: str = "y") -> float:
    """Negatives per positive, at least one."""
    row = df.agg(F.count_if(F.col(y_col) == 1).alias("p"), F.count_if(F.col(y_col) != 1).alias("n")).first()
    return max(1.0, row["n"] / row["p"]) if row["p"] else 1.0


def with_class_weights(
    df: DataFrame, mode: str | Mapping | None = "balanced", y_col: str = "y", out_col: str = "weight"
) -> DataFrame:
    """Weights per row: n / (2 · class size), neg/pos for cases only, given ones, or one."""
    if mode is None or mode == "none":
        return df.withColumn(out_col, F.lit(1.0))
    row = df.agg(F.count_if(F.col(y_col) == 1).alias("p"), F.count_if(F.col(y_col) != 1).alias("n")).first()
    p, n = max(row["p"], 1), max(row["n"], 1)
    if mode == "balanced":
        case, control = (p + n) / (2.0 * p), (p + n) / (2.0 * n)
    elif mode == "scale_pos":
        case, control = max(1.0, n / p), 1.0
    elif isinstance(mode, Mapping):
        case, control = float(mode.get(1, 1.0)), float(mode.get(0, 1.0))
    else:
        raise ValueError(f"unknown class weight mode: {mode}")
    return df.withColumn(out_col, F.when(F.col(y_col) == 1, case).otherwise(control))


def vectors(
    df: DataFrame, array_col: str, keep: Sequence[str] = ("id", "y"), weights: str | None = "balanced"
) -> DataFrame:
    """(keep…, weight, features) from an array column."""
    rows = df.select(*keep, array_to_vector(F.col(array_col).cast("array<double>")).alias("features"))
    return with_class_weights(rows, weights)


def classifier(model_name: str, params: Mapping | None = None, n_rows: int = 1, seed: int = 42):
    """Spark estimator of a model name with the reference parameter names.

    ``C`` becomes ``regParam = 1 / (C · n_rows)``. Boosting has Spark's own
    regularisation, so its numbers differ from other libraries'.
    """
    p = dict(params or {})
    shared = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    if model_name in ("LR_EN", "LR_L1"):
        ratio = 1.0 if model_name == "LR_L1" else p.get("l1_ratio", 0.5)
        return LogisticRegression(
            **shared,
            regParam=1.0 / (p.get("C", 1.0) * max(1, n_rows)),
            elasticNetParam=ratio,
            maxIter=p.get("max_iter", 1000),
            tol=p.get("tol", 1e-4),
            standardization=False,
        )
    if model_name == "LinSVM_cal":
        return LinearSVC(
            **shared,
            regParam=1.0 / (p.get("C", 1.0) * max(1, n_rows)),
            # The hinge loss has no smooth optimum: beyond one block of rows, an iteration
            # costs many passes over them; ``tol`` may end them sooner.
            maxIter=p.get("max_iter", 5000),
            tol=p.get("tol", 1e-3),
            standardization=False,
            rawPredictionCol="svm_raw",
            predictionCol="svm_label",
        )
    if model_name == "RF":
        depth = p.get("max_depth")
        if depth is None:
            warnings.warn(f"trees are cut at Spark's depth limit {MAX_TREE_DEPTH}", stacklevel=2)
        return RandomForestClassifier(
            **shared,
            numTrees=p.get("n_estimators", 500),
            maxDepth=MAX_TREE_DEPTH if depth is None else depth,
            minInstancesPerNode=p.get("min_samples_leaf", 5),
            featureSubsetStrategy=str(p.get("max_features", "sqrt")),
            subsamplingRate=p.get("max_samples") or 1.0,
            bootstrap=p.get("bootstrap", True),
            seed=seed,
        )
    if model_name == "XGBoost":
        estimator = GBTClassifier(
            **shared,
            maxIter=p.get("n_estimators", 1000),
            maxDepth=p.get("max_depth", 5),
            stepSize=p.get("learning_rate", 0.05),
            subsamplingRate=p.get("subsample", 0.8),
            featureSubsetStrategy=str(p.get("colsample", 0.8)),
            minInstancesPerNode=p.get("min_child_weight", 1),
            seed=seed,
        )
        estimator.in_files = True
        return estimator
    raise ValueError(f"unknown model {model_name!r}, one of {MODELS}")


def fit_model(
    train: DataFrame,
    model_name: str,
    params: Mapping | None = None,
    indices: Sequence[int] | None = None,
    scale: bool = True,
    seed: int = 42,
    calibration_folds: int = 5,
) -> PipelineModel:
    """Scale, restrict to ``indices`` and fit; the result has a ``probability`` column.

    A linear SVM gets its probability from a logistic fit on cross-fitted
    margins, or from a monotone one with ``calibration_method`` "isotonic" among its
    parameters, so no row calibrates the machine that saw it.
    """
    method = dict(params or {}).get("calibration_method", "sigmoid")
    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"unknown calibration method: {method}")
    if model_name == "XGBoost":
        ensure_checkpoint_dir(train.sparkSession)  # rounds cut their lineage only there
    stages = []
    source = "features"
    rows = train
    if indices is not None:
        stages.append(VectorSlicer(inputCol=source, outputCol="sliced", indices=sorted(indices)))
        source = "sliced"
    if scale:
        stages.append(
            StandardScaler(inputCol=source, outputCol="scaled", withMean=True, withStd=True)
        )
        source = "scaled"
    n = train.count()
    estimator = classifier(model_name, params, n, seed).setFeaturesCol(source)
    if model_name in ("RF", "XGBoost"):
        rows = _tree_rows(train, n, estimator.getNumTrees() if model_name == "RF" else 1)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        fitted = Pipeline(stages=[*stages, estimator]).fit(rows)
        rows.unpersist()
        return fitted
    if model_name != "LinSVM_cal":
        return Pipeline(stages=[*stages, estimator]).fit(rows)
    base = Pipeline(stages=[*stages, estimator])
    margin = VectorSlicer(inputCol="svm_raw", outputCol="margin", indices=[1])
    own = train.drop("fold", "repeat")
    folds = fold_column(own, calibration_folds, 1, seed).select("id", "fold")
    # An iteration is a job or more: few rows in many tasks cost only waiting.
    tasks = max(1, n // TREE_TASK_ROWS)
    with_fold = own.join(folds, "id").coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    parts = [with_fold.where(F.col("fold") != k) for k in range(calibration_folds)]
    *machines, whole = in_order(
        train.sparkSession,
        [functools.partial(base.fit, part) for part in [*parts, with_fold]],
        _fits_at_once(train.sparkSession, tasks),
    )
    held_out = None
    for k, machine in enumerate(machines):
        part = margin.transform(machine.transform(with_fold.where(F.col("fold") == k))).select("y", "margin")
        held_out = part if held_out is None else held_out.unionByName(part)
    held_out = held_out.coalesce(tasks)
    if method == "isotonic":
        last = _monotone_probability(held_out)
    else:
        last = [LogisticRegression(featuresCol="margin", labelCol="y", regParam=0.0).fit(held_out)]
    with_fold.unpersist()
    return PipelineModel(stages=[*whole.stages, margin, *last])


def _fits_at_once(spark, tasks: int) -> int:
    """Fits of ``tasks`` tasks each that the session's cores run side by side."""
    return max(1, spark.sparkContext.defaultParallelism // tasks)


def _tree_rows(train: DataFrame, n: int, trees: int) -> DataFrame:
    """Rows in as many tasks as ``trees`` that grow side by side keep busy.

    Trees read the rows once a level: few rows in many tasks cost only waiting. A forest
    walks every tree for every row, so its rows are dealt to more tasks, by their ids:
    draws go by a row's place, which is the same in a rerun.
    """
    at_once = train.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, n // TREE_TASK_ROWS, min(at_once, n * trees // TREE_TASK_ROWS))
    if tasks <= train.rdd.getNumPartitions():
        return train.coalesce(tasks)
    return train.repartition(tasks, "id").sortWithinPartitions("id")


def _monotone_probability(margins: DataFrame) -> list:
    """Stages from a ``margin`` vector to a ``probability`` that rises with it."""
    value = vector_to_array("margin")[0].alias("p")
    fitted = OOFCalibrator("isotonic").fit(margins.select("y", value), "p", "y").model
    fitted.setFeaturesCol("margin").setPredictionCol("svm_rate")
    other = SQLTransformer(statement="SELECT *, 1 - svm_rate AS svm_other FROM __THIS__")
    both = VectorAssembler(inputCols=["svm_other", "svm_rate"], outputCol="probability")
    return [fitted, other, both]


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("id", "y")) -> DataFrame:
    """(keep…, y_prob) with y renamed to y_true."""
    scored = model.transform(df).select(*keep, positive_probability().alias("y_prob"))
    return scored.withColumnRenamed("y", "y_true") if "y" in keep else scored


def prevalence(df: DataFrame, y_col: str = "y") -> float:
    return float(df.agg(F.avg(F.col(y_col).cast("double"))).first()[0] or 0.0)


@dataclass(frozen=True)
class CalibratedModel:
    """Fitted pipeline followed by an out-of-fold calibrator."""

    pipeline: PipelineModel
    calibrator: OOFCalibrator | None = None

    def predict(self, df: DataFrame, keep: Sequence[str] = ("id", "y")) -> DataFrame:
        """(keep…, y_prob, label) with the label at 0.5."""
        scored = predict(self.pipeline, df, keep)
        if self.calibrator is not None:
            scored = self.calibrator.transform(scored)
        return scored.withColumn("label", (F.col("y_prob") >= 0.5).cast("int"))


class RocEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Exact metric of a probability column for tuning, larger is better."""

    metricName = Param(Params._dummy(), "metricName", "auroc, prauc, tpr_at_fpr, neg_brier",
                       TypeConverters.toString)
    targetFpr = Param(Params._dummy(), "targetFpr", "FPR of tpr_at_fpr", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, metricName: str = "auroc", targetFpr: float = 0.05):
        super().__init__()
        self._setDefault(metricName="auroc", targetFpr=0.05)
        self._set(**self._input_kwargs)

    def isLargerBetter(self) -> bool:
        return True

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(F.col("y").alias("y_true"), positive_probability().alias("y_prob"))
        roc = C.roc_table(rows, [])
        value = {
            "auroc": C.auroc_of_roc,
            "prauc": C.average_precision_of_roc,
            "tpr_at_fpr": lambda: C.tpr_at_fpr_of_roc(self.getOrDefault(self.targetFpr)),
            "neg_brier": lambda: -brier_of_counts(),
        }[self.getOrDefault(self.metricName)]()
        result = roc.agg(C.only_two_class(value)).first()[0]
        return float("nan") if result is None else float(result)


def scorer(name: str, target_fpr: float = 0.05) -> Evaluator:
    """Evaluator by scoring name; ``roc_auc`` uses the built-in one without bins."""
    if name == "roc_auc":
        return BinaryClassificationEvaluator(labelCol="y", numBins=0)
    table = {"average_precision": "prauc", "tpr_at_fpr": "tpr_at_fpr", "neg_brier_score": "neg_brier"}
    if name not in table:
        raise ValueError(f"unknown scoring {name!r}")
    return RocEvaluator(metricName=table[name], targetFpr=target_fpr)


_SPARK_PARAM = {
    "C": ("regParam", lambda v, n: 1.0 / (v * max(1, n))),
    "l1_ratio": ("elasticNetParam", lambda v, n: v),
    "n_estimators": (None, lambda v, n: v),
    "max_depth": ("maxDepth", lambda v, n: MAX_TREE_DEPTH if v is None else v),
    "min_samples_leaf": ("minInstancesPerNode", lambda v, n: v),
    "max_features": ("featureSubsetStrategy", lambda v, n: str(v)),
    "learning_rate": ("stepSize", lambda v, n: v),
    "subsample": ("subsamplingRate", lambda v, n: v),
    "colsample": ("featureSubsetStrategy", lambda v, n: str(v)),
    "min_child_weight": ("minInstancesPerNode", lambda v, n: v),
}


def search(
    train: DataFrame,
    model_name: str,
    choices: Sequence[Mapping],
    inner_folds: int = 3,
    scoring: str = "roc_auc",
    seed: int = 42,
    parallelism: int = 4,
    indices: Sequence[int] | None = None,
) -> tuple[dict, float, list[float]]:
    """Best of the candidate parameters by inner cross-validation on the features ``indices``.

    Returns the choice, its mean score and all mean scores. Logistic models are fitted
    for all folds and candidates together and may search ``k`` and ``class_weight``.
    """
    if linear_cv.batched(train, model_name):
        metric = {"v": linear_cv.METRICS[scoring]()}
        found = linear_cv.candidate_scores(train, model_name, choices, inner_folds, metric, seed, indices)["v"]
        place = linear_cv.best_of(found)
        scores = [float("nan") if s is None else float(s) for s in found]
        return dict(choices[place]), scores[place], scores
    if indices is not None:
        sliced = VectorSlicer(inputCol="features", outputCol="part", indices=sorted(indices)).transform(train)
        train = sliced.drop("features").withColumnRenamed("part", "features")
    n = train.count()
    estimator = classifier(model_name, None, n, seed).setFeaturesCol("scaled")
    if model_name == "LinSVM_cal":
        estimator = estimator.setRawPredictionCol("rawPrediction")
    pipeline = Pipeline(
        stages=[
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
            estimator,
        ]
    )
    maps = []
    for choice in choices:
        builder = ParamGridBuilder()
        for key, value in choice.items():
            if key not in _SPARK_PARAM:
                raise ValueError(f"{key!r} cannot be searched: Spark's estimators have no such parameter")
            name, convert = _SPARK_PARAM[key]
            if name is None:
                name = "numTrees" if model_name == "RF" else "maxIter"
            builder = builder.baseOn({estimator.getParam(name): convert(value, n)})
        maps += builder.build()
    folds = fold_column(train, inner_folds, 1, seed).select("id", "fold")
    rows = train.join(folds, "id").persist(StorageLevel.MEMORY_AND_DISK)
    validator = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=maps,
        evaluator=scorer(scoring),
        numFolds=inner_folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=seed,
    )
    scores = validator.fit(rows).avgMetrics
    rows.unpersist()
    best = max(range(len(choices)), key=lambda k: (scores[k] == scores[k], scores[k], -k))
    return dict(choices[best]), float(scores[best]), [float(s) for s in scores]


def two_objective_scores(
    train: DataFrame, model_name: str, choices: Sequence[Mapping], n_folds: int = 3, seed: int = 42
) -> DataFrame:
    """(trial, params, auroc, brier): means over folds of every candidate.

    All held-out scores go into one table, so both metrics of all trials and
    folds come from a single grouped job.
    """
    listed = [(k, {n: str(v) for n, v in c.items()}) for k, c in enumerate(choices)]
    if linear_cv.batched(train, model_name):
        metrics = {"auroc": C.auroc_of_roc(), "brier": brier_of_counts()}
        found = linear_cv.candidate_scores(train, model_name, choices, n_folds, metrics, seed)
        rows = [(k, found["auroc"][k], found["brier"][k], params) for k, params in listed]
        return train.sparkSession.createDataFrame(
            rows, "trial int, auroc double, brier double, params map<string,string>"
        )
    folds = fold_column(train, n_folds, 1, seed).select("id", "fold")
    rows = train.join(folds, "id").persist(StorageLevel.MEMORY_AND_DISK)
    scored = None
    for trial, choice in enumerate(choices):
        for k in range(n_folds):
            model = fit_model(rows.where(F.col("fold") != k), model_name, choice, seed=seed)
            part = predict(model, rows.where(F.col("fold") == k)).select(
                F.lit(trial).alias("trial"), F.lit(k).alias("fold"), "y_true", "y_prob"
            )
            scored = part if scored is None else scored.unionByName(part)
    scored = checkpointed(scored)
    rows.unpersist()
    roc = C.roc_table(scored, ["trial", "fold"])
    per_fold = roc.groupBy("trial", "fold").agg(
        C.only_two_class(C.auroc_of_roc()).alias("auroc"), brier_of_counts().alias("brier")
    )
    means = per_fold.groupBy("trial").agg(
        F.avg("auroc").alias("auroc"), F.avg("brier").alias("brier")
    )
    params = train.sparkSession.createDataFrame(listed, "trial int, params map<string,string>")
    return means.join(params, "trial")


# --- importance and selection ---------------------------------------------------


def coefficient_importance(model: PipelineModel, names: Sequence[str]) -> dict[str, float]:
    """Absolute coefficients (or tree importances) of the final estimator by name."""
    for stage in reversed(model.stages):
        if hasattr(stage, "featureImportances"):
            values = stage.featureImportances.toArray()
        elif hasattr(stage, "coefficients") and len(stage.coefficients) == len(names):
            values = np.abs(stage.coefficients.toArray())
        else:
            continue
        return {n: float(v) for n, v in zip(names, values, strict=True)}
    raise ValueError("the model has neither coefficients nor importances")


def coefficient_table(model: PipelineModel, names: Sequence[str], spark) -> DataFrame:
    """(feature, coefficient) of a linear model."""
    for stage in reversed(model.stages):
        if hasattr(stage, "coefficients") and len(stage.coefficients) == len(names):
            rows = list(zip(names, [float(v) for v in stage.coefficients.toArray()], strict=True))
            return spark.createDataFrame(rows, "feature string, coefficient double")
    raise ValueError("not a linear model")


def _read_places(model: PipelineModel, width: int) -> list[int]:
    """Places of the feature vector that the final estimator gets."""
    for stage in model.stages:
        if isinstance(stage, VectorSlicer) and stage.getInputCol() == "features":
            return list(stage.getIndices())
    return list(range(width))


def _used_places(model: PipelineModel, width: int) -> set[int]:
    """Places whose values can change a score: in a tree, or with a coefficient."""
    places = _read_places(model, width)
    values = coefficient_importance(model, [str(i) for i in places])
    return {i for i in places if values[str(i)] != 0.0}


def _margin_slopes(model: PipelineModel, width: int) -> tuple[int, dict[int, float]] | None:
    """Position of a linear estimator among the stages, and its margin's slope in each place."""
    places = _read_places(model, width)
    sd = np.ones(len(places))
    for position, stage in enumerate(model.stages):
        if isinstance(stage, StandardScalerModel):
            sd = stage.std.toArray()
        elif isinstance(stage, (LogisticRegressionModel, LinearSVCModel)):
            slopes = np.divide(stage.coefficients.toArray(), sd, out=np.zeros(len(sd)), where=sd > 0)
            return position, dict(zip(places, slopes.tolist(), strict=True))
    return None


def _lent(
    rows: DataFrame, repeats: int, seed: int, receiver: Sequence[str], donor: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Row k of one hash order beside row k of another, in every repeat (and of each key)."""
    groups = [*keys, "repeat"]
    every = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    order = F.lit(seed) + F.col("repeat")
    receivers = hash_ranked(rows.select("id", *keys, *receiver, every), groups, "id", order, salt=6)
    donors = hash_ranked(rows.select("id", *keys, *donor, every), groups, "id", order, salt=7)
    return receivers.join(donors.select(*groups, "rank", *donor), [*groups, "rank"])


def _shuffled_by_margin(model, df, names, used, position, slopes, repeats, seed) -> DataFrame:
    """(y, repeat, feature, y_prob): the margin moves by slope × (lent - own value).

    A row carries its margin and the terms of at most ``TERMS`` features.
    """
    estimator = model.stages[position]
    raw = "svm_raw" if isinstance(estimator, LinearSVCModel) else "rawPrediction"
    scored = PipelineModel(stages=model.stages[: position + 1]).transform(df)
    value = vector_to_array("features")
    blocks = [used[i : i + TERMS] for i in range(0, len(used), TERMS)]
    pieces = F.array(
        *[
            F.struct(
                F.lit(b).alias("block"), F.array(*[value[j] * slopes[j] for j in block]).alias("terms")
            )
            for b, block in enumerate(blocks)
        ]
    )
    rows = scored.select("id", "y", vector_to_array(raw)[1].alias("margin"), F.inline(pieces))
    labels = F.element_at(
        F.array(*[F.array(*[F.lit(names[j]) for j in block]) for block in blocks]), F.col("block") + 1
    )
    rows = rows.withColumn("lent", F.col("terms"))
    paired = _lent(rows, repeats, seed, ["y", "margin", "terms"], ["lent"], ["block"])
    change = F.zip_with("lent", "terms", lambda a, b: a - b)
    moved = paired.select("y", "repeat", "margin", labels.alias("feature"), change.alias("change")).select(
        "y", "repeat", "margin", F.inline(F.arrays_zip("feature", "change"))
    )
    moved = moved.select("y", "repeat", "feature", (F.col("margin") + F.col("change")).alias("m"))
    if raw == "rawPrediction":
        probability = 1.0 / (1.0 + F.exp(-F.col("m")))
        return moved.select("y", "repeat", "feature", probability.alias("y_prob")).withColumnRenamed("y", "y_true")
    rest = PipelineModel(stages=model.stages[position + 1 :])
    moved = moved.withColumn("svm_raw", array_to_vector(F.array(-F.col("m"), F.col("m"))))
    return predict(rest, moved, ["y", "repeat", "feature"])


def _shuffled_by_vector(model, df, names, used, repeats, seed) -> DataFrame:
    """(y, repeat, feature, y_prob) of whole vectors with one place lent, scored by the model."""
    value = vector_to_array("features")
    rows = df.select("id", "y", value.alias("own"), value.alias("lent"))
    paired = _lent(rows, repeats, seed, ["y", "own"], ["lent"])
    label = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(names[j]).alias("feature")) for j in used])
    changed = F.transform("own", lambda v, i: F.when(i == F.col("j"), F.col("lent")[i]).otherwise(v))
    mixed = paired.select("id", "y", "repeat", "own", "lent", F.inline(label)).select(
        "id", "y", "repeat", "feature", array_to_vector(changed).alias("features")
    )
    return predict(model, mixed.withColumn("weight", F.lit(1.0)), ["y", "repeat", "feature"])


def permutation_drops(
    model: PipelineModel,
    df: DataFrame,
    names: Sequence[str],
    repeats: int = 5,
    seed: int = 42,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """(repeat, feature, drop): AUROC lost when a feature (one of ``only``) is shuffled.

    Row k of one hash order lends its values to row k of another, which
    shuffles every feature; the feature in turn takes the lent value. The
    scores of all features and repeats are measured in one grouped job. Of a linear
    model only the margin moves; of trees, features that no tree reads lose nothing.
    """
    full = C.roc_table(predict(model, df), []).agg(C.only_two_class(C.auroc_of_roc()).alias("full"))
    wanted = set(names if only is None else only)
    reads = _used_places(model, len(names))
    used = [j for j, n in enumerate(names) if n in wanted and j in reads]
    idle = [n for j, n in enumerate(names) if n in wanted and j not in reads]
    one = F.broadcast(full)  # one number
    every = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    nothing = full.select("full", every).select(
        "repeat",
        F.explode(F.array(*[F.lit(n) for n in idle]).cast("array<string>")).alias("feature"),
        (F.col("full") * 0.0).alias("drop"),
    )
    if not used:
        return nothing
    linear = _margin_slopes(model, len(names))
    if linear is None:
        scored = _shuffled_by_vector(model, df, names, used, repeats, seed)
    else:
        scored = _shuffled_by_margin(model, df, names, used, *linear, repeats, seed)
    shuffled = C.roc_table(scored, ["repeat", "feature"]).groupBy("repeat", "feature").agg(
        C.only_two_class(C.auroc_of_roc()).alias("auroc")
    )
    drops = shuffled.crossJoin(one).select(
        "repeat", "feature", (F.col("full") - F.col("auroc")).alias("drop")
    )
    return drops.unionByName(nothing) if idle else drops


def importance(
    model: PipelineModel,
    model_name: str,
    df: DataFrame,
    names: Sequence[str],
    repeats: int = 5,
    seed: int = 42,
) -> dict[str, float]:
    """Absolute coefficients for linear models, permutation drops for the others."""
    if model_name in ("LR_EN", "LR_L1", "LinSVM_cal"):
        return coefficient_importance(model, names)
    drops = permutation_drops(model, df, names, repeats, seed)
    rows = drops.groupBy("feature").agg(F.avg("drop").alias("v")).collect()
    return {r["feature"]: float(r["v"] or 0.0) for r in rows}


def hinge_weights(train: DataFrame, names: Sequence[str], c: float = 1.0) -> dict[str, float]:
    """Absolute coefficients of a linear machine: |β|₁ + C · Σ weight · max(0, 1 - margin)²."""
    blocks = pack(train.drop("fold", "repeat").withColumn("member", F.array(F.lit(0))), 1)
    sums = moments(blocks)
    penalty = 1.0 / (c * max(float(sums.weights.sum()), 1e-300))
    fitted = fit_many(blocks, sums, [Fit(penalty=penalty, ratio=1.0)], loss="squared_hinge")
    blocks.release()
    return {n: abs(float(v)) for n, v in zip(names, fitted.standardised[0], strict=False)}


def model_selection(
    train: DataFrame,
    names: Sequence[str],
    model_name: str,
    threshold: str | float = "median",
    max_features: int | None = None,
    min_features: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Features whose importance in a light model of the type reaches a threshold.

    At most ``max_features``; with fewer than ``min_features`` the most
    important ones are taken instead.
    """
    light = {
        "LR_EN": ("LR_L1", {"C": 1.0}),
        "LR_L1": ("LR_L1", {"C": 1.0}),
        "LinSVM_cal": ("LinSVM_cal", {"C": 1.0}),
        "RF": ("RF", {"n_estimators": 200, "max_depth": 8, "min_samples_leaf": 5}),
        "XGBoost": ("XGBoost", {"n_estimators": 200, "max_depth": 5, "learning_rate": 0.3}),
    }
    if model_name not in light:
        raise ValueError(f"unknown model {model_name!r}, one of {MODELS}")
    kind, params = light[model_name]
    if kind == "LinSVM_cal" and len(names) <= MAX_FEATURES:
        values = hinge_weights(train, names, params["C"])
    else:
        values = coefficient_importance(fit_model(train, kind, params, seed=seed), names)
    ordered = sorted(values.items(), key=lambda e: (-e[1], e[0]))
    if threshold == "median":
        level = float(np.median(list(values.values())))
    elif threshold == "mean":
        level = float(np.mean(list(values.values())))
    else:
        level = float(threshold)
    chosen = [e for e in ordered if e[1] >= level][: max_features or len(ordered)]
    if len(chosen) < min_features <= len(ordered):
        chosen = ordered[:min_features]
    if not chosen:
        chosen = ordered
    return train.sparkSession.createDataFrame(chosen, "feature string, importance double")


def selected_names(model: PipelineModel, names: Sequence[str]) -> list[str]:
    """Names that pass the slicing and selecting stages of a fitted pipeline."""
    current = list(names)
    for stage in model.stages:
        if isinstance(stage, VectorSlicer) and stage.getInputCol() == "features":
            current = [current[i] for i in stage.getIndices()]
        elif hasattr(stage, "selectedFeatures"):
            current = [current[i] for i in stage.selectedFeatures]
    return current


@dataclass(frozen=True)
class FeatureStrategy:
    """How features are chosen inside a training fold."""

    screen_method: str | None = "mannwhitney"
    screen_top_n: int = 0
    k_best: int | None = None
    model_selector: bool = False
    selector_threshold: str | float = "median"
    selector_min_features: int = 10
    fixed_panel: tuple[str, ...] = ()
    #: Names that neither the screen nor a fixed panel leaves out.
    covariates: tuple[str, ...] = ()


def fold_features(
    train: DataFrame,
    names: Sequence[str],
    model_name: str,
    strategy: FeatureStrategy,
    seed: int = 42,
    columns: Sequence[str] | None = None,
) -> list[str]:
    """Names kept by screening, then k best, then the model selector; or a fixed panel.

    ``columns`` names the vector's features where ``names`` are only some of them.
    """
    if columns is not None and list(columns) != list(names):
        at = {n: i for i, n in enumerate(columns)}
        part = VectorSlicer(inputCol="features", outputCol="part", indices=[at[n] for n in names])
        train = part.transform(train).drop("features").withColumnRenamed("part", "features")
    if strategy.fixed_panel:
        missing = sorted(set(strategy.fixed_panel) - set(names))
        if missing:
            raise ValueError(f"panel features not in the data: {missing}")
        return [n for n in names if n in {*strategy.fixed_panel, *strategy.covariates}]
    current = list(names)
    label = {f"f{i:04d}": n for i, n in enumerate(names)}
    long = melt_array(
        train.select("y", vector_to_array("features").alias("a")), "a", ["y"]
    )
    if strategy.screen_method and strategy.screen_top_n > 0:
        exempt = [code for code, n in label.items() if n in strategy.covariates]
        measured = long.where(~F.col("feature").isin(exempt)) if exempt else long
        top = S.screen(measured, strategy.screen_method, strategy.screen_top_n)
        kept = {label[r["feature"]] for r in top.select("feature").collect()} | set(strategy.covariates)
        current = [n for n in current if n in kept]
    if strategy.k_best and strategy.k_best < len(current):
        back = {n: k for k, n in label.items()}
        inside = long.where(F.col("feature").isin([back[n] for n in current]))
        kept = {label[r["feature"]] for r in S.select_k_best(inside, strategy.k_best).collect()}
        current = [n for n in current if n in kept]
    if strategy.model_selector:
        position = {n: i for i, n in enumerate(names)}
        sliced = VectorSlicer(
            inputCol="features", outputCol="part", indices=[position[n] for n in current]
        ).transform(train)
        part = sliced.drop("features").withColumnRenamed("part", "features")
        kept = {
            r["feature"]
            for r in model_selection(
                part, current, model_name, strategy.selector_threshold,
                min_features=strategy.selector_min_features, seed=seed,
            ).collect()
        }
        current = [n for n in current if n in kept]
    return current


def training_pipeline(
    model_name: str, names: Sequence[str], chosen: Sequence[str], params: Mapping | None = None,
    n_rows: int = 1, seed: int = 42,
) -> Pipeline:
    """Unfitted pipeline: chosen features → scaling → classifier."""
    position = {n: i for i, n in enumerate(names)}
    return Pipeline(
        stages=[
            VectorSlicer(inputCol="features", outputCol="sliced",
                         indices=sorted(position[n] for n in chosen)),
            StandardScaler(inputCol="sliced", outputCol="scaled", withMean=True),
            classifier(model_name, params, n_rows, seed).setFeaturesCol("scaled"),
        ]
    )


# --- nested cross-validation ----------------------------------------------------


@dataclass
class NestedCV:
    """Out-of-fold rows and the logs of every outer fold."""

    oof: DataFrame
    selection_log: DataFrame
    param_log: DataFrame
    calibrator: OOFCalibrator | None = None
    coefficients: DataFrame | None = None


def nested_cv(
    df: DataFrame,
    names: Sequence[str],
    model_name: str,
    folds: int = 5,
    repeats: int = 1,
    inner_folds: int = 3,
    choices: Sequence[Mapping] | None = None,
    strategy: FeatureStrategy | None = None,
    calibration: str = "oof_posthoc",
    calibration_method: str = "isotonic",
    scoring: str = "roc_auc",
    seed: int = 42,
) -> NestedCV:
    """Repeated stratified outer folds with an inner search in each.

    ``calibration``: ``none``, ``per_fold`` (a map fitted on cross-fitted inner
    scores) or ``oof_posthoc`` (one map fitted on all out-of-fold rows).

    Logistic models take the k best features (``strategy.k_best`` or a candidate's own
    ``k``) inside every inner training set, and all their fits share the passes over
    the rows; ``coefficients`` then has a row per outer split and feature taken.
    """
    spark = df.sparkSession
    strategy = strategy or FeatureStrategy()
    if linear_cv.batched(df, model_name):
        return _nested_linear(
            df, names, model_name, folds, repeats, inner_folds, choices, strategy, calibration,
            calibration_method, scoring, seed,
        )
    assigned = fold_column(df, folds, repeats, seed).select("id", "repeat", "fold")
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)
    assigned = checkpointed(assigned)
    position = {n: i for i, n in enumerate(names)}

    def outer(repeat: int, fold: int) -> tuple[DataFrame, list[str], dict, float | None]:
        split = rows.join(assigned.where(F.col("repeat") == repeat), "id")
        train = split.where(F.col("fold") != fold)
        held_out = split.where(F.col("fold") == fold)
        chosen = fold_features(train, names, model_name, strategy, seed)
        indices = [position[n] for n in chosen]
        best, score = {}, None
        if choices:
            sliced = VectorSlicer(inputCol="features", outputCol="part", indices=indices)
            part = sliced.transform(train).drop("features", "fold", "repeat")
            part = part.withColumnRenamed("part", "features")
            best, score, _ = search(part, model_name, choices, inner_folds, scoring, seed)
        model = fit_model(train, model_name, best, indices, seed=seed)
        scores = predict(model, held_out, ["id", "y"])
        if calibration == "per_fold" and model_name != "LinSVM_cal":
            inner = cross_fitted(train, model_name, best, indices, inner_folds, seed)
            scores = OOFCalibrator(calibration_method).fit(inner).transform(scores)
        scores = scores.select(
            "id", "y_true", F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), "y_prob"
        )
        # Scored here, so that the trees of few fits are held at a time.
        return checkpointed(scores), chosen, best, score

    # Outer folds do not wait for each other: a fit on few rows keeps few cores busy.
    # The driver holds the trees of the forests that grow, so these are few.
    at_once = _fits_at_once(spark, max(1, rows.count() // TREE_TASK_ROWS))
    places = [(repeat, fold) for repeat in range(repeats) for fold in range(folds)]
    done = in_order(
        spark,
        [functools.partial(outer, *place) for place in places],
        min(at_once, FORESTS_AT_ONCE) if model_name == "RF" else at_once,
    )
    oof, selections, parameters = None, [], []
    for (repeat, fold), (scores, chosen, best, score) in zip(places, done, strict=True):
        oof = scores if oof is None else oof.unionByName(scores)
        number = repeat * folds + fold
        selections.append((model_name, repeat, number, sorted(chosen)))
        parameters.append((model_name, repeat, number, score, {k: str(v) for k, v in best.items()}))
    oof = checkpointed(oof)
    rows.unpersist()
    calibrator = None
    if calibration == "oof_posthoc":
        calibrator = OOFCalibrator(calibration_method).fit(oof)
    return NestedCV(
        oof=oof,
        selection_log=spark.createDataFrame(
            selections, "model string, repeat int, outer_split int, features array<string>"
        ),
        param_log=spark.createDataFrame(
            parameters,
            "model string, repeat int, outer_split int, best_score double, params map<string,string>",
        ),
        calibrator=calibrator,
    )


def _nested_linear(
    df, names, model_name, folds, repeats, inner_folds, choices, strategy, calibration, method, scoring, seed
) -> NestedCV:
    spark = df.sparkSession
    base = None
    if strategy.fixed_panel or strategy.model_selector or strategy.screen_top_n > 0:

        def base(train: DataFrame) -> list[str]:
            return fold_features(train, names, model_name, strategy, seed)

    k = None if strategy.fixed_panel else strategy.k_best
    found = linear_cv.nested(
        df, names, model_name, folds, repeats, inner_folds, choices, k, base, scoring, seed
    )
    oof, calibrator = found["oof"], None
    if calibration == "per_fold":
        parts = []
        for o in range(folds * repeats):
            one = OOFCalibrator(method).fit(found["inner"].where(F.col("column") == o))
            mine = (F.col("repeat") == o // folds) & (F.col("fold") == o % folds)
            parts.append(one.transform(oof.where(mine)))
        oof = checkpointed(functools.reduce(DataFrame.unionByName, parts))
    elif calibration == "oof_posthoc":
        calibrator = OOFCalibrator(method).fit(oof)
    numbered = [(model_name, o // folds, o) for o in range(folds * repeats)]
    used = [(*key, sorted(f)) for key, f in zip(numbered, found["features"], strict=True)]
    params = [
        (*key, score, {n: str(v) for n, v in choice.items()})
        for key, score, choice in zip(numbered, found["scores"], found["choices"], strict=True)
    ]
    position = {n: i for i, n in enumerate(names)}
    weights = [
        (*key, n, float(row[position[n]]))
        for key, row, chosen in zip(numbered, found["coefficients"], found["features"], strict=True)
        for n in chosen
    ]
    keys = "model string, repeat int, outer_split int, "
    return NestedCV(
        oof=oof.select("id", "y_true", "repeat", "fold", "y_prob"),
        selection_log=spark.createDataFrame(used, keys + "features array<string>"),
        param_log=spark.createDataFrame(params, keys + "best_score double, params map<string,string>"),
        calibrator=calibrator,
        coefficients=spark.createDataFrame(weights, keys + "feature string, coefficient double"),
    )


def cross_fitted(
    df: DataFrame,
    model_name: str,
    params: Mapping | None,
    indices: Sequence[int] | None,
    n_folds: int,
    seed: int = 42,
) -> DataFrame:
    """(id, y_true, y_prob) with every row scored by a model that did not see it."""
    if linear_cv.batched(df, model_name):
        return linear_cv.cross_fitted(df, model_name, params or {}, indices, n_folds, seed)
    base = df.drop("fold", "repeat")
    folds = fold_column(base, n_folds, 1, seed).select("id", "fold")
    rows = base.join(folds, "id").persist(StorageLevel.MEMORY_AND_DISK)
    out = None
    for k in range(n_folds):
        model = fit_model(rows.where(F.col("fold") != k), model_name, params, indices, seed=seed)
        part = predict(model, rows.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    out = checkpointed(out)
    rows.unpersist()
    return out


# --- elimination ----------------------------------------------------------------


def evaluation_sizes(largest: int, smallest: int, strategy: str = "geometric") -> list[int]:
    """Panel sizes to measure: halving, halving with three-quarter steps, or each."""
    if strategy not in ("geometric", "fine", "linear"):
        raise ValueError(f"unknown step strategy: {strategy}")
    if largest <= smallest:
        return [largest]
    if strategy == "linear":
        return list(range(largest, smallest - 1, -1))
    sizes, current = {smallest}, largest
    while current > smallest:
        sizes.add(current)
        if strategy == "fine":
            sizes.add(max(smallest, current * 3 // 4))
        current = max(smallest, current // 2)
    return sorted(sizes, reverse=True)


def _metrics(scores: DataFrame, suffix: str) -> dict:
    roc = C.roc_table(scores, [])
    row = roc.agg(*discrimination_aggregates(include_youden=False), brier_of_counts().alias("b")).first()
    return {
        f"auroc_{suffix}": row["auroc"],
        f"prauc_{suffix}": row["prauc"],
        f"brier_{suffix}": row["b"],
        f"sens95_{suffix}": row["sensitivity_at_spec"],
    }


@dataclass
class Elimination:
    """Curve by panel size, order of removal, and the best validation AUROC."""

    curve: DataFrame
    ranking: DataFrame
    best_auroc: float


def recursive_elimination(
    train: DataFrame,
    validation: DataFrame,
    names: Sequence[str],
    start: Sequence[str],
    model_name: str,
    params: Mapping | None = None,
    min_size: int = 5,
    cv_folds: int = 5,
    step_strategy: str = "geometric",
    min_auroc_frac: float = 0.9,
    n_perm_repeats: int = 5,
    n_boot: int = 50,
    seed: int = 42,
    always: Sequence[str] = (),
) -> Elimination:
    """Drop the least important feature again and again, measuring at set sizes.

    Stops early once validation AUROC falls below a fraction of the best seen. Names in
    ``always`` (covariates) are in every model and count in no size.
    """
    from riskloom.operators.resample import bootstrap_sd

    spark = train.sparkSession
    sizes = evaluation_sizes(len(start), min_size, step_strategy)
    if linear_cv.batched(train, model_name):
        measured, gone = linear_cv.elimination_curve(
            train, validation, names, start, model_name, params or {}, sizes, cv_folds, n_boot, seed, always
        )
        points, best = [], 0.0
        for point in measured:
            points.append({"auroc_cv_std": 0.0, **point})
            best = max(best, point["auroc_val"] or 0.0)
            if (point["auroc_val"] or 0.0) < best * min_auroc_frac:
                break
        gone = gone[: len(start) - points[-1]["size"]]
        removed = [(model_name, n, i) for i, n in enumerate(gone)]
        return _elimination(spark, model_name, points, removed, best)
    position = {n: i for i, n in enumerate(names)}
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    validation = validation.persist(StorageLevel.MEMORY_AND_DISK)
    current, removed, points, best = list(start), [], [], 0.0
    for size in sizes:
        while len(current) > max(size, min_size):
            ordered = sorted([*current, *always], key=position.__getitem__)
            model = fit_model(train, model_name, params, [position[n] for n in ordered], seed=seed)
            if model_name in ("LR_EN", "LR_L1", "LinSVM_cal"):
                weight = coefficient_importance(model, ordered)
            else:
                # The slicer of the model reads the full vector.
                drops = permutation_drops(model, train, names, n_perm_repeats, seed, current)
                mean = importance_selection(drops, -1.0, len(names)).collect()
                weight = {r["feature"]: r["importance"] for r in mean}
            worst = min(current, key=lambda n: (weight.get(n, 0.0), n))
            removed.append((model_name, worst, len(removed)))
            current.remove(worst)
        indices = [position[n] for n in (*current, *always)]
        model = fit_model(train, model_name, params, indices, seed=seed)
        if cv_folds > 1:
            inner = cross_fitted(train, model_name, params, indices, cv_folds, seed)
            spread = bootstrap_sd(inner, [], n_boot, seed).first()["auroc_sd"]
        else:
            inner, spread = predict(model, train), 0.0
        point = {"size": len(current), "auroc_cv_std": float(spread or 0.0)}
        point.update(_metrics(inner, "cv"))
        point.update(_metrics(predict(model, validation), "val"))
        point["features"] = sorted(current)
        points.append(point)
        reached = point["auroc_val"] or 0.0
        best = max(best, reached)
        if reached < best * min_auroc_frac:
            break
    train.unpersist()
    validation.unpersist()
    return _elimination(spark, model_name, points, removed, best)


def _elimination(spark, model_name, points, removed, best) -> Elimination:
    fields = [
        f"{m}_{s}" for s in ("cv", "val") for m in ("auroc", "prauc", "brier", "sens95")
    ]
    schema = "model string, size int, auroc_cv_std double, " + ", ".join(
        f"{f} double" for f in fields
    )
    curve = spark.createDataFrame(
        [
            (model_name, p["size"], p["auroc_cv_std"], *[p[f] for f in fields], p["features"])
            for p in points
        ],
        schema + ", features array<string>",
    )
    ranking = spark.createDataFrame(
        removed, "model string, feature string, elimination_order int"
    )
    return Elimination(curve, ranking, best)


def _eliminate_path(
    train: DataFrame,
    names: Sequence[str],
    start: Sequence[str],
    model_name: str,
    params: Mapping | None,
    min_features: int,
    step: int,
    seed: int,
) -> list[list[str]]:
    """Feature sets from all of ``start`` down to ``min_features``."""
    position = {n: i for i, n in enumerate(names)}
    sets = [list(start)]
    while len(sets[-1]) > min_features:
        current = sorted(sets[-1], key=position.__getitem__)
        model = fit_model(train, model_name, params, [position[n] for n in current], seed=seed)
        weight = coefficient_importance(model, current)
        drop = min(step, len(current) - min_features)
        worst = set(sorted(current, key=lambda n: (weight[n], n))[:drop])
        sets.append([n for n in current if n not in worst])
    return sets


def cross_validated_elimination(
    train: DataFrame,
    validation: DataFrame,
    names: Sequence[str],
    start: Sequence[str],
    model_name: str = "LR_EN",
    params: Mapping | None = None,
    min_features: int = 5,
    step: int = 1,
    cv_folds: int = 3,
    fold: int = 0,
    seed: int = 42,
) -> dict:
    """Best panel size by inner folds, then that size on all training rows.

    Held-out scores of all sizes and inner folds are measured in one grouped
    job. Equal means go to the smaller size. Returns the chosen features, mean
    score per size, the ranking (1 = chosen) and the validation AUROC.
    """
    if linear_cv.batched(train, model_name):
        found = linear_cv.eliminated(
            train, validation, names, start, model_name, params or {}, min_features, step, cv_folds, seed
        )
        sizes = [len(s) for s in found["sets"]]
        at = max(range(len(sizes)), key=lambda i: (found["scores"][sizes[i]] or 0.0, -sizes[i]))
        ranking = {n: at + 2 - max(i for i in range(at + 1) if n in found["sets"][i]) - 1 for n in start}
        return {
            "fold": fold,
            "features": sorted(found["sets"][at]),
            "optimal_size": sizes[at],
            "cv_scores": found["scores"],
            "ranking": ranking,
            "val_auroc": found["validation"][at],
        }
    position = {n: i for i, n in enumerate(names)}
    folds = fold_column(train.drop("fold", "repeat"), cv_folds, 1, seed).select("id", "fold")
    rows = train.drop("fold", "repeat").join(folds, "id").persist(StorageLevel.MEMORY_AND_DISK)
    scored = None
    for k in range(cv_folds):
        inside, outside = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        for chosen in _eliminate_path(inside, names, start, model_name, params, min_features, step, seed):
            model = fit_model(inside, model_name, params, [position[n] for n in chosen], seed=seed)
            part = predict(model, outside).select(
                F.lit(len(chosen)).alias("size"), F.lit(k).alias("fold"), "y_true", "y_prob"
            )
            scored = part if scored is None else scored.unionByName(part)
    roc = C.roc_table(checkpointed(scored), ["size", "fold"])
    per_fold = roc.groupBy("size", "fold").agg(C.only_two_class(C.auroc_of_roc()).alias("auroc"))
    means = per_fold.groupBy("size").agg(F.avg("auroc").alias("score")).orderBy("size").collect()
    best = max(means, key=lambda r: (r["score"] or 0.0, -r["size"]))["size"]
    path = _eliminate_path(rows, names, start, model_name, params, best, step, seed)
    chosen = path[-1]
    ranking = {n: 1 for n in chosen}
    for level, (larger, smaller) in enumerate(zip(path[::-1][1:], path[::-1][:-1]), start=2):
        ranking.update({n: level for n in set(larger) - set(smaller)})
    model = fit_model(rows, model_name, params, [position[n] for n in chosen], seed=seed)
    reached = _metrics(predict(model, validation), "val")["auroc_val"]
    rows.unpersist()
    return {
        "fold": fold,
        "features": sorted(chosen),
        "optimal_size": len(chosen),
        "cv_scores": {r["size"]: r["score"] for r in means},
        "ranking": ranking,
        "val_auroc": reached,
    }


def learning_curve(
    df: DataFrame,
    model_name: str,
    params: Mapping | None = None,
    folds: int = 5,
    min_frac: float = 0.3,
    n_points: int = 5,
    metric: str = "auroc",
    seed: int = 0,
) -> DataFrame:
    """(train_size, fold, train_score, val_score) at growing training sizes.

    Training sets of a fold grow by hash order, each containing the last.
    """
    column = {"auroc": C.auroc_of_roc, "prauc": C.average_precision_of_roc, "brier": brier_of_counts}
    assigned = fold_column(df, folds, 1, seed).select("id", "fold")
    rows = df.join(assigned, "id").persist(StorageLevel.MEMORY_AND_DISK)
    scored, sizes = None, []
    fractions = even_fractions(min_frac, n_points)
    for k in range(folds):
        pool = rows.where(F.col("fold") != k)
        grown = checkpointed(training_prefix(pool.select("id", "y"), fractions, seed))
        for f in fractions:
            ids = grown.where(F.col("fraction") == float(f)).select("id")
            part = pool.join(ids, "id", "left_semi")
            size = part.count()
            sizes.append((k, float(f), size))
            model = fit_model(part, model_name, params, seed=seed)
            for role, target in (("train", part), ("val", rows.where(F.col("fold") == k))):
                scores = predict(model, target).select(
                    F.lit(k).alias("fold"), F.lit(float(f)).alias("fraction"),
                    F.lit(role).alias("role"), "y_true", "y_prob",
                )
                scored = scores if scored is None else scored.unionByName(scores)
    roc = C.roc_table(checkpointed(scored), ["fold", "fraction", "role"])
    rows.unpersist()
    values = roc.groupBy("fold", "fraction", "role").agg(
        C.only_two_class(column[metric]()).alias("v")
    )
    wide = values.groupBy("fold", "fraction").agg(
        F.max(F.when(F.col("role") == "train", F.col("v"))).alias("train_score"),
        F.max(F.when(F.col("role") == "val", F.col("v"))).alias("val_score"),
    )
    table = df.sparkSession.createDataFrame(sizes, "fold int, fraction double, train_size bigint")
    return wide.join(table, ["fold", "fraction"]).select(
        "train_size", "fraction", "fold", "train_score", "val_score"
    )
