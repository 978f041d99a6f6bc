"""Panel-size curves and choice among tuning trials.

Curves and trial tables have a row per panel size or trial, so windows over one
group are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.joins import join_on_keys

FRACTIONS = (0.95, 0.90, 0.85)


def recommended_sizes(
    curve: DataFrame, group_cols: Sequence[str] = (), fractions: Sequence[float] = FRACTIONS
) -> DataFrame:
    """Smallest size whose AUROC reaches each fraction of the best AUROC."""
    best = curve.groupBy(*group_cols).agg(F.max("auroc").alias("__best"))
    rows = join_on_keys(curve, best, list(group_cols)).withColumn(
        "fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    )
    return (
        rows.where(F.col("auroc") >= F.col("__best") * F.col("fraction"))
        .groupBy(*group_cols, "fraction")
        .agg(F.min("size").alias("size"))
    )


def knee_size(curve: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Size farthest from the chord of the scaled curve.

    A flat curve or one of fewer than three points gives its largest size.
    """
    keys = list(group_cols)
    ends = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max("size").alias("__s1"),
        F.min("size").alias("__s0"),
        F.max("auroc").alias("__a1"),
        F.min("auroc").alias("__a0"),
        F.max_by("auroc", "size").alias("__big"),
        F.min_by("auroc", "size").alias("__small"),
    )
    rows = join_on_keys(curve, ends, keys)
    width = F.col("__s1") - F.col("__s0")
    height = F.col("__a1") - F.col("__a0")
    x = F.try_divide(F.col("size") - F.col("__s0"), width)
    y = F.try_divide(F.col("auroc") - F.col("__a0"), height)
    y_big = F.try_divide(F.col("__big") - F.col("__a0"), height)
    y_small = F.try_divide(F.col("__small") - F.col("__a0"), height)
    # The chord runs from (0, y_small) to (1, y_big).
    rise = y_big - y_small
    distance = F.abs(rise * x - y + y_small) / F.sqrt(rise * rise + 1.0)
    scored = rows.withColumn(
        "__d",
        F.when((F.col("__n") >= 3) & (width > 0) & (height > 0), distance).otherwise(F.lit(0.0)),
    )
    # Distances that are equal up to rounding count as a tie; the larger size wins.
    return scored.groupBy(*keys).agg(
        F.max_by("size", F.struct(F.round("__d", 12), F.col("size"))).alias("knee_size")
    )


def compare_adjacent_sizes(
    curve: DataFrame, sizes: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Adjacent recommended sizes: do the 95% intervals overlap, and the z score."""
    keys = list(group_cols)
    chosen = sizes.select(*keys, "size").distinct()
    rows = join_on_keys(curve, chosen, [*keys, "size"])
    part = [F.col(k) for k in keys] or [F.lit(1)]
    w = W.partitionBy(*part).orderBy(F.col("size").desc())
    rows = rows.withColumns(
        {
            "smaller_size": F.lead("size").over(w),
            "__a": F.lead("auroc").over(w),
            "__s": F.lead("auroc_std").over(w),
        }
    ).where(F.col("smaller_size").isNotNull())
    gap = F.abs(F.col("auroc") - F.col("__a"))
    overlap = gap <= 1.96 * (F.col("auroc_std") + F.col("__s"))
    se = F.sqrt(F.col("auroc_std") * F.col("auroc_std") + F.col("__s") * F.col("__s"))
    z = F.when(
        (F.col("auroc_std") > 0) & (F.col("__s") > 0), F.try_divide(gap, se)
    ).otherwise(F.lit(0.0))
    return rows.where((F.col("auroc_std") > 0) | (F.col("__s") > 0)).select(
        *keys,
        F.col("size").alias("larger_size"),
        "smaller_size",
        gap.alias("auroc_gap"),
        overlap.alias("intervals_overlap"),
        z.alias("z_score"),
        (~overlap & (z > 1.96)).alias("different"),
    )


def pareto_frontier(
    trials: DataFrame, group_cols: Sequence[str] = (), objectives: Sequence[str] = ("auroc", "brier")
) -> DataFrame:
    """Trials no other trial beats: larger AUROC, smaller Brier.

    After a sort by AUROC a trial is dominated exactly if a smaller Brier came
    earlier, so one running minimum decides; no pairs are formed.
    """
    groups = list(group_cols)
    keys = [F.col(c) for c in groups] or [F.lit(1)]
    up, down = objectives
    complete = trials.where(F.col(up).isNotNull() & F.col(down).isNotNull())
    # Per AUROC value only the smallest Brier can survive.
    levels = complete.groupBy(*groups, up).agg(F.min(down).alias("__best"))
    higher = W.partitionBy(*keys).orderBy(F.col(up).desc()).rowsBetween(W.unboundedPreceding, -1)
    levels = levels.withColumn("__before", F.min("__best").over(higher))
    front = levels.where(F.col("__before").isNull() | (F.col("__best") < F.col("__before")))
    front = front.select(*groups, up, F.col("__best").alias(down))
    return join_on_keys(trials, front, [*groups, up, down], "left_semi")


def _scaled(frontier: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    ends = frontier.groupBy(*group_cols).agg(
        F.min("auroc").alias("__a0"),
        F.max("auroc").alias("__a1"),
        F.min("brier").alias("__b0"),
        F.max("brier").alias("__b1"),
    )
    rows = join_on_keys(frontier, ends, list(group_cols))
    gain = (F.col("auroc") - F.col("__a0")) / (F.col("__a1") - F.col("__a0") + 1e-10)
    loss = (F.col("brier") - F.col("__b0")) / (F.col("__b1") - F.col("__b0") + 1e-10)
    return rows.withColumns({"__gain": gain, "__calm": F.lit(1.0) - loss})


def select_trial(
    frontier: DataFrame,
    strategy: str = "knee",
    group_cols: Sequence[str] = (),
    trial_col: str = "trial",
) -> DataFrame:
    """One trial per group: nearest to the ideal corner, largest sum, or best AUROC.

    Ties (up to rounding) go to the smallest trial.
    """
    rows = _scaled(frontier, group_cols)
    gain, calm = F.col("__gain"), F.col("__calm")
    if strategy == "knee":
        cost = F.sqrt((1.0 - gain) * (1.0 - gain) + (1.0 - calm) * (1.0 - calm))
    elif strategy == "balanced":
        cost = -(gain + calm)
    elif strategy == "extreme_auroc":
        cost = -F.col("auroc")
    else:
        raise ValueError(f"unknown selection strategy: {strategy}")
    picked = F.min_by(
        F.struct(trial_col, "auroc", "brier"), F.struct(F.round(cost, 9), F.col(trial_col))
    )
    return rows.groupBy(*group_cols).agg(picked.alias("t")).select(*group_cols, "t.*")
