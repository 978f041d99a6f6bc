"""Correlation, correlated groups and panel pruning.

Tables here have one row per feature or per pair of features; people enter only
in ``correlation``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.joins import join_on_keys
from riskloom.functions.ordered import running_totals, with_value_cells
from riskloom.operators.screen import impute
from riskloom.session import checkpointed

POOL_LIMIT = 3000
BLOCK = 256


def average_ranks(melted: DataFrame) -> DataFrame:
    """Replace values by their tie-averaged rank within the feature."""
    counts = melted.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(
        with_value_cells(counts, ["feature"], "value"), ["feature"], ["value"], ["n"]
    )
    ranks = cum.select(
        "feature", "value", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("__rank")
    )
    return (
        join_on_keys(melted, ranks, ["feature", "value"])
        .withColumn("value", F.col("__rank"))
        .drop("__rank")
    )


def _gram_blocks(p: int, block: int):
    """Task body: partial sums of outer products, one row per pair of column blocks."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for frame in batches:
            if frame.empty:
                continue
            x = np.vstack(frame["v"].to_numpy())
            for i in range(0, p, block):
                left = x[:, i : i + block]
                for j in range(i, p, block):
                    part = left.T @ x[:, j : j + block]
                    key = (i, j)
                    sums[key] = sums[key] + part if key in sums else part
        rows = [
            (i, j, left, values)
            for (i, j), m in sums.items()
            for left, values in enumerate(m.tolist())
        ]
        yield pd.DataFrame(rows, columns=["i", "j", "row", "sums"])

    return run


def correlation(
    melted: DataFrame,
    features: Sequence[str],
    method: str = "spearman",
    id_col: str = "id",
) -> DataFrame:
    """Absolute correlation (i, j, r) of every pair i < j of the given features.

    Missing values and absent rows are median-imputed, repeated rows of a person and
    feature count once by their mean; an unknown method means Pearson. Values
    are centred and scaled per feature, gathered to one array per person, and
    each task adds up outer products block by block, so the shuffle carries
    feature × feature sums and never people. The feature list bounds their size.
    What several steps read (filled rows, ranks, arrays) is checkpointed, so each is
    computed once; medians are looked for only where something is missing.
    """
    names = sorted(set(features))
    index = {n: k for k, n in enumerate(names)}
    spark = melted.sparkSession
    keys = spark.createDataFrame(
        [(n, k) for n, k in index.items()], "feature string, __k int"
    )
    rows = _complete_grid(
        melted.select(id_col, "feature", "value").join(F.broadcast(keys), "feature", "left"),
        names,
        id_col,
    ).join(F.broadcast(keys), "feature")
    rows = checkpointed(rows)
    if not rows.where(F.col("value").isNull()).isEmpty():
        rows = checkpointed(impute(rows, "median"))
    if (method or "").strip().lower() == "spearman":
        rows = checkpointed(average_ranks(rows))
    moments = rows.groupBy("feature").agg(
        F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s")
    )
    scaled = join_on_keys(rows, moments, ["feature"]).withColumn(
        "__z", F.try_divide(F.col("value") - F.col("__m"), F.col("__s"))
    )
    p = len(names)
    vectors = scaled.groupBy(id_col).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("__k", F.coalesce("__z", F.lit(0.0)).alias("z")))),
            lambda e: e["z"],
        ).alias("v")
    ).where(F.size("v") == p)
    vectors = checkpointed(vectors.select("v"))
    partial = vectors.mapInPandas(
        _gram_blocks(p, BLOCK), "i int, j int, row int, sums array<double>"
    )
    entries = partial.select(
        (F.col("i") + F.col("row")).alias("a"), "j", F.posexplode("sums").alias("o", "s")
    )
    total = entries.groupBy("a", (F.col("j") + F.col("o")).alias("b")).agg(F.sum("s").alias("s"))
    size = vectors.agg(F.count(F.lit(1)).alias("__n"))
    spread = moments.join(F.broadcast(keys), "feature").where(F.col("__s") > 0).select("__k")
    pairs = total.where(F.col("a") < F.col("b")).crossJoin(F.broadcast(size))
    for side in ("a", "b"):  # a constant feature correlates with nothing
        pairs = pairs.join(
            F.broadcast(spread.withColumnRenamed("__k", side)), side, "left_semi"
        )
    label = F.array(*[F.lit(n) for n in names])
    return pairs.select(
        F.element_at(label, F.col("a") + 1).alias("feature_i"),
        F.element_at(label, F.col("b") + 1).alias("feature_j"),
        F.least(F.abs(F.col("s") / F.col("__n")), F.lit(1.0)).alias("r"),
    )


def _complete_grid(rows: DataFrame, names: Sequence[str], id_col: str) -> DataFrame:
    """(id, feature, value) with a row for every person and feature, absent ones NULL.

    ``rows`` has the feature's number in ``__k``, NULL for features not asked for.
    """
    held = F.map_from_entries(
        F.collect_list(F.when(F.col("__k").isNotNull(), F.struct("__k", "value")))
    )
    label = F.array(*[F.lit(n) for n in names])
    slots = F.transform(
        label, lambda n, k: F.struct(n.alias("feature"), F.try_element_at("__held", k).alias("value"))
    )
    # Both groupings keep the partitions of the one exchange by person.
    once = rows.repartition(id_col).groupBy(id_col, "__k").agg(F.avg("value").alias("value"))
    return (
        once.groupBy(id_col)
        .agg(held.alias("__held"))
        .select(id_col, F.inline(slots))
    )


def correlation_of_vectors(
    df: DataFrame, array_col: str, names: Sequence[str], method: str = "pearson"
) -> DataFrame:
    """Pairs (i, j, r) from one array column without missing values.

    Uses the built-in matrix, which is p × p on the driver, so it is limited to
    ``POOL_LIMIT`` features; ``correlation`` has no such limit.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    if len(names) > POOL_LIMIT:
        raise ValueError(f"at most {POOL_LIMIT} features; use correlation()")
    vectors = df.select(array_to_vector(F.col(array_col).cast("array<double>")).alias("v"))
    matrix = Correlation.corr(vectors, "v", method).first()[0].toArray()
    i, j = np.triu_indices(len(names), k=1)
    label = np.asarray(list(names))
    frame = pd.DataFrame(
        {"feature_i": label[i], "feature_j": label[j], "r": np.abs(matrix[i, j])}
    )
    return df.sparkSession.createDataFrame(
        frame, "feature_i string, feature_j string, r double"
    )


def high_correlation_pairs(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs with r at or above the threshold, strongest first."""
    return pairs.where(F.col("r") >= threshold).orderBy(
        F.col("r").desc(), "feature_i", "feature_j"
    )


def correlation_graph(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Undirected edges (src, dst), both directions."""
    kept = pairs.where(F.col("r") >= threshold)
    forward = kept.select(F.col("feature_i").alias("src"), F.col("feature_j").alias("dst"))
    return forward.unionByName(
        forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )


def connected_components(
    vertices: DataFrame, edges: DataFrame, vertex_col: str = "feature", max_rounds: int = 200
) -> DataFrame:
    """(feature, component): the smallest reachable name, isolated vertices included.

    Every round takes the smallest label among neighbours and then jumps to the
    label's own label, so the number of rounds grows with the logarithm of a
    component's diameter. Each round is checkpointed.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    labels = checkpointed(
        vertices.select(F.col(vertex_col).alias("v")).distinct().withColumn("c", F.col("v"))
    )
    for _ in range(max_rounds):
        near = (
            edges.join(labels, edges.dst == labels.v)
            .groupBy("src")
            .agg(F.min("c").alias("__near"))
        )
        step = labels.join(near, labels.v == near.src, "left").select(
            "v", F.col("c").alias("__old"), F.least("c", F.coalesce("__near", "c")).alias("c")
        )
        target = step.select(F.col("v").alias("__t"), F.col("c").alias("__jump"))
        jumped = step.join(target, F.col("c") == F.col("__t"), "left").select(
            "v", "__old", F.least("c", F.coalesce("__jump", "c")).alias("c")
        )
        jumped = checkpointed(jumped)
        labels = jumped.select("v", "c")
        if jumped.where(F.col("c") != F.col("__old")).isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    return labels.select(F.col("v").alias(vertex_col), F.col("c").alias("component"))


def with_representatives(
    components: DataFrame,
    selection_freq: DataFrame,
    strength: DataFrame | None = None,
) -> DataFrame:
    """Number components and pick each one's representative.

    Highest selection frequency wins; with ``strength`` ties go to the smaller
    p, then the larger effect; then the name.
    """
    rows = components.join(selection_freq.select("feature", "selection_freq"), "feature", "left")
    order = [F.coalesce(F.col("selection_freq"), F.lit(0.0)).desc()]
    if strength is not None:
        rows = rows.join(
            strength.select(
                "feature", F.col("p_value").alias("__p"), F.col("effect_size").alias("__e")
            ),
            "feature",
            "left",
        )
        order += [
            F.coalesce(F.col("__p"), F.lit(1.0)).asc(),
            F.coalesce(F.col("__e"), F.lit(0.0)).desc(),
        ]
    w = W.partitionBy("component").orderBy(*order, F.col("feature"))
    whole = W.partitionBy("component")
    ranked = rows.withColumns(
        {
            "__rn": F.row_number().over(w),
            "rep_feature": F.first("feature").over(w),
            "component_size": F.count(F.lit(1)).over(whole),
        }
    )
    return ranked.select(
        "component",
        "feature",
        "selection_freq",
        (F.col("__rn") == 1).alias("kept"),
        "rep_feature",
        "component_size",
    )


def prune_correlated(
    features: DataFrame,
    pairs: DataFrame,
    selection_freq: DataFrame,
    threshold: float = 0.8,
    strength: DataFrame | None = None,
) -> DataFrame:
    """Component map of the features with one kept representative each."""
    names = features.select("feature").distinct()
    inside = pairs.join(names.withColumnRenamed("feature", "feature_i"), "feature_i", "left_semi")
    inside = inside.join(names.withColumnRenamed("feature", "feature_j"), "feature_j", "left_semi")
    parts = connected_components(names, correlation_graph(inside, threshold))
    return with_representatives(parts, selection_freq, strength)


def kept_features(component_map: DataFrame) -> DataFrame:
    """Representatives by frequency descending, then name."""
    return component_map.where("kept").orderBy(
        F.coalesce(F.col("selection_freq"), F.lit(0.0)).desc(), "feature"
    ).select("feature", "selection_freq")


#: Names of a ranking that are looked at together when a panel is refilled.
CHUNK = 256


def greedy_refill(
    kept: Sequence[str],
    ranked: Sequence[str],
    conflicts: set[tuple[str, str]],
    target_size: int,
    pool_limit: int | None = None,
) -> list[str]:
    """Walk the ranked names and add each that conflicts with none already in.

    Sequential by nature, so it runs on the driver, over a chunk of names and their pairs
    above the threshold; ``pool_limit`` names of the ranking at most, if given.
    """
    panel = list(kept)[:target_size] if len(kept) >= target_size else list(kept)
    inside = set(panel)
    for name in list(ranked)[:pool_limit]:
        if len(panel) >= target_size:
            break
        if name in inside:
            continue
        if any((min(name, k), max(name, k)) in conflicts for k in panel):
            continue
        panel.append(name)
        inside.add(name)
    return panel


def _refill_in_chunks(
    kept: Sequence[str],
    ranked: Sequence[str],
    pairs: DataFrame,
    threshold: float,
    target_size: int,
) -> list[str]:
    """``greedy_refill`` over a table of pairs, CHUNK names of the ranking at a time.

    Of each chunk, names that conflict with the panel so far drop out on Spark, and only
    pairs among the others come to the driver: at most CHUNK names and CHUNK² / 2 pairs,
    whatever the number of features. The walk ends with the chunk that fills the panel.
    """
    spark = pairs.sparkSession
    near = pairs.where(F.col("r") >= threshold).select("feature_i", "feature_j")
    ways = near.unionByName(
        near.select(F.col("feature_j").alias("feature_i"), F.col("feature_i").alias("feature_j"))
    )

    def names(values: Sequence[str], column: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(v,) for v in values], f"{column} string"))

    panel = greedy_refill(kept, [], set(), target_size)
    for at in range(0, len(ranked), CHUNK):
        if len(panel) >= target_size:
            break
        chunk = [n for n in ranked[at : at + CHUNK] if n not in set(panel)]
        if not chunk:
            continue
        linked = ways.join(names(chunk, "feature_i"), "feature_i", "left_semi")
        blocked = set()
        if panel:
            met = linked.join(names(panel, "feature_j"), "feature_j", "left_semi")
            blocked = {r[0] for r in met.select("feature_i").distinct().collect()}
        free = [n for n in chunk if n not in blocked]
        if len(free) > 1:
            among = (
                ways.where(F.col("feature_i") < F.col("feature_j"))
                .join(names(free, "feature_i"), "feature_i", "left_semi")
                .join(names(free, "feature_j"), "feature_j", "left_semi")
            )
            conflicts = {(r["feature_i"], r["feature_j"]) for r in among.distinct().collect()}
        else:
            conflicts = set()
        panel = greedy_refill(panel, free, conflicts, target_size)
    return panel


def prune_and_refill(
    ranked: Sequence[str],
    pairs: DataFrame,
    selection_freq: DataFrame,
    target_size: int,
    threshold: float = 0.8,
    strength: DataFrame | None = None,
    pool_limit: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Prune the first ``target_size`` names, then refill from the ranking.

    Returns the component map (refilled names are components of their own) and
    the panel in order.
    """
    spark = pairs.sparkSession
    head = spark.createDataFrame([(n,) for n in ranked[:target_size]], "feature string")
    component_map = checkpointed(
        prune_correlated(head, pairs, selection_freq, threshold, strength).withColumn(
            "removed_for", F.when(F.col("kept"), F.lit("")).otherwise(F.col("rep_feature"))
        )
    )
    kept = [r["feature"] for r in kept_features(component_map).collect()]
    panel = _refill_in_chunks(kept, list(ranked)[:pool_limit], pairs, threshold, target_size)
    added = panel[len(kept) :]
    if added:
        extra = (
            spark.createDataFrame([(n,) for n in added], "feature string")
            .join(selection_freq.select("feature", "selection_freq"), "feature", "left")
            .select(
                F.col("feature").alias("component"),
                "feature",
                "selection_freq",
                F.lit(True).alias("kept"),
                F.col("feature").alias("rep_feature"),
                F.lit(1).cast("bigint").alias("component_size"),
                F.lit("").alias("removed_for"),
            )
        )
        component_map = component_map.unionByName(extra)
    return component_map, panel


def multi_size_panels(
    ranked: Sequence[str],
    pairs: DataFrame,
    selection_freq: DataFrame,
    sizes: Sequence[int],
    threshold: float = 0.8,
    strength: DataFrame | None = None,
    pool_limit: int | None = None,
) -> DataFrame:
    """(panel_size, rank, feature) of every size; correlations are computed once."""
    pairs = checkpointed(pairs)
    rows = []
    for size in sizes:
        _, panel = prune_and_refill(
            ranked, pairs, selection_freq, size, threshold, strength, pool_limit
        )
        rows += [(int(size), k, name) for k, name in enumerate(panel, start=1)]
    return pairs.sparkSession.createDataFrame(rows, "panel_size int, rank int, feature string")


def cluster_by_score(
    scores: DataFrame, pairs: DataFrame, threshold: float = 0.85
) -> DataFrame:
    """Correlation components with the best consensus score as representative."""
    as_freq = scores.select("feature", F.col("consensus_score").alias("selection_freq"))
    return prune_correlated(scores, pairs, as_freq, threshold).withColumnRenamed(
        "selection_freq", "consensus_score"
    )
