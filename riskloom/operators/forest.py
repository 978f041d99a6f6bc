"""Random forests whose trees need no Spark job per level while the rows' bins fit one block.

Spark's ``RandomForestClassifier`` shuffles the histograms of all open nodes of all trees,
level by level; with deep trees these outweigh the rows many times. Here Spark cuts every
feature into bins (a byte each), and while these bytes fit ``BLOCK_BYTES`` the trees are
dealt to tasks that read them all and grow a tree after the other. More rows take Spark's
own forest. Both follow the same rule, up to the draws of rows and features.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, classification
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.boosting import ROUNDING, features_per_node, thresholds
from riskloom.session import ensure_checkpoint_dir, read_folder, ship_package

#: Bins that a task holds, a byte each: 1,048,576 rows of 64 features.
BLOCK_BYTES = 1 << 26
#: Histogram cells, or rows of features, that are counted at once.
CELLS = 1 << 20

EDGES = "feature int, edges binary"
ROWS = "y double, w double, bins binary"
#: A tree is a row: of a node's two children, ``left`` is the first and the next one the other.
TREES = (
    "tree int, weight double, nodes int, feature binary, threshold binary, left binary, rate binary, "
    "importance array<double>"
)


class RandomForestClassifier(classification.RandomForestClassifier):
    """Spark's forest of two classes; trees whose rows fit one block are grown by whole tasks.

    Labels are 0 and 1, features complete. The model is a ``ForestModel``, or Spark's
    where the rows, the labels or the settings need Spark's forest.
    """

    def _fit(self, dataset: DataFrame) -> Model:
        features = self.getFeaturesCol()
        first = dataset.select(features).first()
        n_features = 0 if first is None else first[0].size
        label = F.col(self.getLabelCol()).cast("double")
        odd = F.count_if(label.isNull() | ~label.isin(0.0, 1.0))
        n, others = dataset.agg(F.count(F.lit(1)), odd).first()
        if (
            not n_features
            or n * n_features > BLOCK_BYTES
            or others
            or self.getMaxBins() > 256
            or self.getImpurity() != "gini"
            or self.isDefined(self.thresholds)
        ):
            return super()._fit(dataset)
        spark = dataset.sparkSession
        ship_package(spark)
        weight = F.col(self.getWeightCol()) if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = dataset.select(label.alias("y"), weight.cast("double").alias("w"), vector_to_array(features).alias("x"))
        path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
        max_bins = self.getMaxBins()

        def cut(table: pa.Table) -> pa.Table:
            return _edges(table, max_bins)

        columns = rows.mapInArrow(lambda batches: _columns(batches, n_features), "feature int, x binary, w binary")
        columns.groupBy("feature").applyInArrow(cut, EDGES).write.parquet(f"{path}/edges")
        rows.mapInArrow(lambda batches: _binned(batches, path, n_features), ROWS).write.parquet(f"{path}/rows")
        strategy = self.getFeatureSubsetStrategy()
        trees = self.getNumTrees()
        if strategy == "auto":
            strategy = "all" if trees == 1 else "sqrt"
        settings = {
            "depth": self.getMaxDepth(),
            "bootstrap": self.getBootstrap(),
            "rate": self.getSubsamplingRate(),
            "tries": features_per_node(strategy, n_features),
            "least": self.getMinInstancesPerNode(),
            "least_share": self.getMinWeightFractionPerNode(),
            "least_gain": self.getMinInfoGain(),
            "seed": self.getSeed(),
        }
        tasks = min(trees, 2 * spark.sparkContext.defaultParallelism)
        numbers = spark.range(0, trees, 1, tasks)
        numbers.mapInArrow(lambda batches: _grown(batches, path, n_features, settings), TREES).write.parquet(
            f"{path}/trees"
        )
        return tree_model(self, path, n_features, trees)


def tree_model(estimator, path: str, n_features: int, trees: int, boosted: bool = False) -> ForestModel:
    """The model of an estimator whose trees lie in ``path``."""
    model = ForestModel(path, n_features, trees, boosted)
    for name in ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
        model._set(**{name: estimator.getOrDefault(name)})
    return model._resetUid(estimator.uid)


class ForestModel(
    Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLWritable, MLReadable
):
    """Grown trees that stay in files of the shared folder; the driver never holds them.

    Trees of a forest vote with their leaves' shares, ``boosted`` ones add up to a margin.
    """

    numClasses = 2

    def __init__(self, path: str = "", n_features: int = 0, trees: int = 0, boosted: bool = False):
        super().__init__()
        self.path, self.numFeatures, self.getNumTrees, self.boosted = path, n_features, trees, boosted

    def _trees(self) -> DataFrame:
        return SparkSession.active().read.schema(TREES).parquet(f"{self.path}/trees")

    @property
    def totalNumNodes(self) -> int:
        return self._trees().agg(F.sum("nodes")).first()[0]

    @property
    def featureImportances(self) -> DenseVector:
        """Sum over trees of each tree's shares of the gain (boosted: of its gain), scaled to one."""
        each = self._trees().select(F.posexplode("importance").alias("j", "v"))
        values = np.zeros(self.numFeatures)
        for j, v in each.groupBy("j").agg(F.sum("v")).collect():
            values[j] = v
        return DenseVector(values / values.sum() if values.sum() > 0 else values)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        path, n_features, boosted = self.path, self.numFeatures, self.boosted

        @F.arrow_udf("array<double>")
        def votes(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _votes(parts, path, n_features, boosted)

        raw = vector_to_array(self.getRawPredictionCol())
        if boosted:
            probability = F.transform(raw, lambda v: 1.0 / (1.0 + F.exp(-2.0 * v)))
        else:
            total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
            probability = F.transform(raw, lambda v: F.when(total > 0, v / total).otherwise(0.0))
        return (
            dataset.withColumn(
                self.getRawPredictionCol(), array_to_vector(votes(vector_to_array(self.getFeaturesCol())))
            )
            .withColumn(self.getProbabilityCol(), array_to_vector(probability))
            .withColumn(self.getPredictionCol(), (raw[1] > raw[0]).cast("double"))
        )

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, own = self.sparkSession, self.model
        sizes = {"numFeatures": own.numFeatures, "numTrees": own.getNumTrees, "boosted": own.boosted}
        DefaultParamsWriter.saveMetadata(own, path, spark, extraMetadata=sizes)
        spark.read.schema(TREES).parquet(f"{own.path}/trees").write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(path, metadata["numFeatures"], metadata["numTrees"], metadata["boosted"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


# --- bins -------------------------------------------------------------------------


def _matrix(column: pa.Array, n_features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n_features)


def _columns(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[pa.RecordBatch]:
    """The batch's values of each feature, with the rows' weights."""
    for b in batches:
        x, w = _matrix(b.column(2), n_features), b.column(1).to_numpy().tobytes()
        yield pa.RecordBatch.from_pydict(
            {
                "feature": pa.array(np.arange(n_features, dtype=np.int32)),
                "x": pa.array([c.tobytes() for c in x.T], pa.binary()),
                "w": pa.array([w] * n_features, pa.binary()),
            }
        )


def _edges(table: pa.Table, max_bins: int) -> pa.Table:
    """Cuts of one feature, from all its values."""
    x, w = (np.frombuffer(b"".join(table[name].to_pylist())) for name in ("x", "w"))
    order = np.lexsort((w, x))  # sums must not depend on how the rows came
    edges = thresholds(x[order], w[order], max_bins)
    return pa.table(
        {"feature": table["feature"].slice(0, 1), "edges": pa.array([edges.tobytes()], pa.binary())}
    )


def _read_edges(path: str, n_features: int) -> list[np.ndarray]:
    table = read_folder(f"{path}/edges").to_table()
    by_feature = dict(zip(table["feature"].to_pylist(), table["edges"].to_pylist(), strict=True))
    return [np.frombuffer(by_feature[j]) for j in range(n_features)]


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j])
    return out


def _binned(batches: Iterator[pa.RecordBatch], path: str, n_features: int) -> Iterator[pa.RecordBatch]:
    edges = None
    for b in batches:
        if edges is None:
            edges = _read_edges(path, n_features)
        bins = _bins(_matrix(b.column(2), n_features), edges)
        yield pa.RecordBatch.from_pydict(
            {"y": b.column(0), "w": b.column(1), "bins": pa.array([r.tobytes() for r in bins], pa.binary())}
        )


def _read_rows(path: str, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins by feature, labels, weights) of all rows, in an order of their contents."""
    bins, y, w = [np.empty((0, n_features), np.uint8)], [], []
    for b in read_folder(f"{path}/rows").to_batches():
        bins.append(np.frombuffer(b"".join(b["bins"].to_pylist()), np.uint8).reshape(-1, n_features))
        y.append(b["y"].to_numpy())
        w.append(b["w"].to_numpy())
    bins, y, w = np.concatenate(bins), np.concatenate(y), np.concatenate(w)
    if not (w >= 0).all():
        raise ValueError("a forest needs weights from 0")
    # Draws go by a row's place, which must not depend on how the rows came.
    key = np.concatenate([bins, np.column_stack([y, w]).view(np.uint8).reshape(len(y), -1)], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    return np.ascontiguousarray(bins[order].T), y[order].astype(np.intp), w[order]


# --- growing ----------------------------------------------------------------------


def _grown(
    batches: Iterator[pa.RecordBatch], path: str, n_features: int, settings: dict
) -> Iterator[pa.RecordBatch]:
    """One row per tree."""
    block = None
    for b in batches:
        for number in b.column(0).to_pylist():
            if block is None:
                block, edges = _read_rows(path, n_features), _read_edges(path, n_features)
            tree = grow(*block, number=number, **settings)
            tree["threshold"] = node_thresholds(edges, tree)
            yield tree_row(number, tree)


def node_thresholds(edges: list[np.ndarray], tree: dict) -> np.ndarray:
    """Value of each inner node's cut, zero in leaves."""
    starts = np.concatenate(([0], np.cumsum([len(e) for e in edges])))
    inner = tree["left"] >= 0
    out = np.zeros(len(inner))
    out[inner] = np.concatenate(edges)[starts[tree["feature"][inner]] + tree["cut"][inner]]
    return out


def tree_row(number: int, tree: dict) -> pa.RecordBatch:
    kinds = (("feature", "<i4"), ("threshold", "<f8"), ("left", "<i4"), ("rate", "<f8"))
    return pa.RecordBatch.from_pydict(
        {
            "tree": pa.array([number], pa.int32()),
            "weight": pa.array([tree["weight"]], pa.float64()),
            "nodes": pa.array([len(tree["left"])], pa.int32()),
            **{name: pa.array([tree[name].astype(kind).tobytes()], pa.binary()) for name, kind in kinds},
            "importance": pa.array([tree["importance"]], pa.list_(pa.float64())),
        }
    )


def grow(
    bins, y, w, number, depth, bootstrap, rate, tries, least, least_share, least_gain, seed
) -> dict:
    """One classification tree, level by level, on rows drawn with the tree's own seed."""
    n_features, n = bins.shape
    rng = np.random.default_rng([seed & 0xFFFFFFFFFFFFFFFF, number])
    if bootstrap:
        drawn = rng.poisson(rate, n)
    else:
        drawn = (rng.random(n) < rate).astype(np.intp) if rate < 1.0 else np.ones(n, np.intp)
    row = np.flatnonzero(drawn)
    times, label = drawn[row].astype(float), y[row]
    weight = times * w[row]
    # Counts give the weights where each class has one weight.
    of_class = [np.unique(w[y == k]) for k in (0, 1)]
    rates = np.array([u[0] if len(u) else 0.0 for u in of_class]) if max(map(len, of_class)) < 2 else None
    low = max(least_share * w.sum(), np.finfo(float).tiny)
    stride = int(bins.max(initial=0)) + 1
    slot, m, made, levels = np.zeros(len(row), np.intp), 1, 1, []
    flat_bins = bins.ravel()
    for level in range(depth + 1):
        at = slot * 2 + label
        count = np.bincount(at, times, 2 * m).reshape(m, 2).sum(1)
        sums = np.bincount(at, weight, 2 * m).reshape(m, 2)
        total = sums.sum(1)
        safe = np.where(total > 0, total, 1.0)
        spread = 1.0 - np.where(total > 0, ((sums / safe[:, None]) ** 2).sum(1), 1.0)
        node = {
            "sums": sums, "feature": np.full(m, -1), "cut": np.zeros(m, np.intp), "left": np.full(m, -1),
            "gain": np.zeros(m),
        }
        levels.append(node)
        open_ = np.flatnonzero((count >= 2 * least) & (sums > 0).all(1) & (spread > ROUNDING))
        if level == depth or not len(open_) or stride < 2:
            break
        place = np.full(m, -1)
        place[open_] = np.arange(len(open_))
        keep = place[slot] >= 0
        row, times, label, weight, slot = row[keep], times[keep], label[keep], weight[keep], place[slot[keep]]
        m = len(open_)
        sums, count, total = sums[open_], count[open_], total[open_]
        if tries < n_features:
            subset = np.sort(rng.random((m, n_features)).argpartition(tries - 1, axis=1)[:, :tries], axis=1)
        else:
            subset = np.broadcast_to(np.arange(n_features), (m, n_features))
        best, where = np.full(m, -np.inf), np.zeros(m, np.intp)
        step = max(1, CELLS // max(len(row), 2 * m * stride))
        for k in range(0, tries, step):
            tried = np.ascontiguousarray(subset[:, k : k + step].T)
            score = _scores(
                flat_bins, n, stride, tried, row, slot, label, times, weight, rates, count, sums, least, low
            )
            top = score.argmax(1)
            value = score[np.arange(m), top]
            better = value > best
            best[better], where[better] = value[better], top[better] + k * (stride - 1)
        gain = (best - (sums**2).sum(1) / total) / total
        parted = (gain > ROUNDING * spread[open_]) & (gain >= least_gain)
        kept = np.flatnonzero(parted)
        if not len(kept):
            break
        nth, cut = np.divmod(where, stride - 1)
        feature = subset[np.arange(m), nth]
        out = open_[kept]
        node["feature"][out], node["cut"][out], node["gain"][out] = feature[kept], cut[kept], gain[kept]
        node["left"][out] = made + 2 * np.arange(len(kept))
        place = np.full(m, -1)
        place[kept] = np.arange(len(kept))
        keep = parted[slot]
        row, times, label, weight, slot = row[keep], times[keep], label[keep], weight[keep], slot[keep]
        right = flat_bins[feature[slot] * n + row] > cut[slot]
        slot = 2 * place[slot] + right
        m = 2 * len(kept)
        made += m
    return _merged(levels, n_features)


def _scores(
    flat_bins, n, stride, tried, row, slot, label, times, weight, rates, count, sums, least, low
) -> np.ndarray:
    """Purity behind every cut of the ``tried`` features (feature × node), a row per node."""
    width, m = tried.shape
    cell = flat_bins[tried[:, slot] * n + row].astype(np.intp)
    cell += (np.arange(width)[:, None] * m + slot) * stride
    cell *= 2
    cell += label
    cell, cells = cell.ravel(), width * m * stride * 2

    def left_of(values: np.ndarray) -> np.ndarray:
        repeated = np.broadcast_to(values, (width, len(values))).ravel()
        hist = np.bincount(cell, repeated, cells).reshape(width, m, stride, 2)
        return hist.cumsum(2)[:, :, :-1]

    counted = left_of(times)
    left = counted * rates if rates is not None else left_of(weight)
    counted = counted.sum(3)
    right = sums[:, None] - left
    left_sum, right_sum = left.sum(3), right.sum(3)
    valid = (counted >= least) & (count[:, None] - counted >= least) & (left_sum >= low) & (right_sum >= low)
    score = np.divide((left**2).sum(3), left_sum, out=np.full(valid.shape, -np.inf), where=valid)
    score += np.divide((right**2).sum(3), right_sum, out=np.zeros(valid.shape), where=valid)
    return score.transpose(1, 0, 2).reshape(m, -1)


def _merged(levels: list[dict], n_features: int) -> dict:
    """Nodes of a tree after Spark's merging: sister leaves of one class are their parent."""
    at = {name: np.concatenate([node[name] for node in levels]) for name in levels[0]}
    left, sums = at["left"], at["sums"]
    class_ = sums.argmax(1)
    ends = np.cumsum([len(node["left"]) for node in levels])
    for start, end in zip(ends[-2::-1] - np.diff(ends, prepend=0)[-2::-1], ends[-2::-1], strict=True):
        inner = start + np.flatnonzero(left[start:end] >= 0)
        a, b = left[inner], left[inner] + 1
        one = inner[(left[a] < 0) & (left[b] < 0) & (class_[a] == class_[b])]
        left[one] = -1
    kept = np.zeros(len(left), bool)
    kept[0] = True
    starts = np.concatenate(([0], ends[:-1]))
    for start, end in zip(starts, ends, strict=True):
        inner = start + np.flatnonzero((left[start:end] >= 0) & kept[start:end])
        kept[left[inner]] = kept[left[inner] + 1] = True
    renumbered = np.cumsum(kept) - 1
    total = sums.sum(1)
    inner = left >= 0
    importance = np.bincount(
        at["feature"][inner & kept], (at["gain"] * total)[inner & kept], n_features
    )
    whole = importance.sum()
    return {
        "weight": float(total[0] > 0),
        "feature": np.where(inner, at["feature"], -1)[kept],
        "cut": at["cut"][kept],
        "left": np.where(inner, renumbered[left], -1)[kept],
        "rate": (sums[:, 1] / np.where(total > 0, total, 1.0))[kept],
        "importance": importance / whole if whole > 0 else importance,
    }


# --- scoring ----------------------------------------------------------------------


def _votes(parts: Iterator[pa.Array], path: str, n_features: int, boosted: bool) -> Iterator[pa.Array]:
    """Raw scores of both classes; trees are read again for every batch."""
    names = ["weight", "feature", "threshold", "left", "rate"]
    for part in parts:
        n = len(part)
        flat = _matrix(part, n_features).ravel()
        out = np.zeros((n, 2))
        if n:
            for b in read_folder(f"{path}/trees").to_batches(columns=names):
                for t in b.to_pylist():
                    rate = _leaf_rates(flat, n, n_features, t)
                    out[:, 0] += t["weight"] * (-rate if boosted else 1.0 - rate)
                    out[:, 1] += t["weight"] * rate
        yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 2), pa.array(out.ravel()))


def _leaf_rates(flat: np.ndarray, n: int, n_features: int, tree: dict) -> np.ndarray:
    feature, left = np.frombuffer(tree["feature"], "<i4"), np.frombuffer(tree["left"], "<i4")
    threshold, rate = np.frombuffer(tree["threshold"], "<f8"), np.frombuffer(tree["rate"], "<f8")
    node = np.zeros(n, np.intp)
    moving = np.arange(n) if left[0] >= 0 else np.arange(0)
    at = node[moving]
    while len(moving):
        # Not "greater": missing values go right, as in Spark.
        at = left[at] + ~(flat[moving * n_features + feature[at]] <= threshold[at])
        node[moving] = at
        inner = left[at] >= 0
        moving, at = moving[inner], at[inner]
    return rate[node]
