"""Bootstrap intervals and two-sample comparisons.

Drawing n rows with replacement is a multinomial draw over distinct scores. It
is done in two exact steps: first how many draws fall into each hash cell of a
group (one small row per replicate), then, cell by cell, how they spread over
the scores inside. Rows are counted first and no group meets in one task. Where
a metric is a sum over ordered scores, a cell gives one row of sums per replicate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.joins import join_on_keys
from riskloom.functions.ordered import CELL, exact_quantiles, probability_cell
from riskloom.functions.prob import finite, safe_div
from riskloom.functions.tails import (
    ks_p,
    normal_p,
    normal_upper_p,
    t_p,
    t_quantile_column,
)
from riskloom.operators import curves as C
from riskloom.operators.calibrate import calibration_intercept_slope, quantile_bins
from riskloom.operators.discrimination import brier_score
from riskloom.session import checkpointed

CELLS = 128
REPS_PER_BLOCK = 25
Z_975 = 1.959963984540054
# Configuration pairs of the factorial comparison.
CONFIG_PAIRS = (
    ("0.5_1", "0.5_5", "Case:control (50% prev)"),
    ("1.0_1", "1.0_5", "Case:control (100% prev)"),
    ("0.5_1", "1.0_1", "Prevalent frac (1:1 ratio)"),
    ("0.5_5", "1.0_5", "Prevalent frac (1:5 ratio)"),
)


def _generator(*parts: int) -> np.random.Generator:
    return np.random.default_rng([int(p) & 0xFFFFFFFFFFFFFFFF for p in parts])


def _cell_draws(stratified: bool):
    """Vectorised: draws per cell and class of one replicate."""

    def run(pos: pd.Series, neg: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        out = []
        for p, n, s in zip(pos, neg, seeds, strict=True):
            p, n = np.asarray(p, dtype=np.int64), np.asarray(n, dtype=np.int64)
            rng = _generator(s)
            if stratified:
                a = rng.multinomial(p.sum(), p / p.sum()) if p.sum() else p
                b = rng.multinomial(n.sum(), n / n.sum()) if n.sum() else n
            else:
                both = np.concatenate([p, n])
                drawn = rng.multinomial(both.sum(), both / both.sum())
                a, b = drawn[: len(p)], drawn[len(p) :]
            out.append((a.tolist(), b.tolist()))
        return pd.DataFrame(out, columns=["pos", "neg"])

    return F.pandas_udf(run, "pos array<bigint>, neg array<bigint>")


def _spread(keys: list[str], groups: list[str]):
    """Grouped: spread a cell's draws over its rows for a block of replicates."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [*groups, "rep", *keys, "pos", "neg"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        left = left.sort_values(keys, kind="mergesort")
        right = right.sort_values("rep")
        rng = _generator(right["seed"].iloc[0])
        drawn = []
        for name in ("pos", "neg"):
            n, k = right[f"d_{name}"].to_numpy(), left[name].to_numpy()
            if k.sum():
                drawn.append(rng.multinomial(n, k / k.sum()))
            else:
                drawn.append(np.zeros((len(n), len(k)), dtype=np.int64))
        at_rep, at_key = np.nonzero(drawn[0] + drawn[1])
        out = {g: left[g].to_numpy()[at_key] for g in (*groups, *keys)}
        out["rep"] = right["rep"].to_numpy()[at_rep]
        out["pos"], out["neg"] = drawn[0][at_rep, at_key], drawn[1][at_rep, at_key]
        return pd.DataFrame(out)[columns]

    return run


def resampled_counts(
    counts: DataFrame,
    group_cols: Sequence[str],
    key_cols: Sequence[str],
    n_boot: int,
    seed: int = 0,
    stratified: bool = True,
) -> DataFrame:
    """(group…, rep, key…, pos, neg): bootstrap samples of a table of counts.

    ``counts`` has one row per key with ``pos`` and ``neg``. With ``stratified``
    cases and controls are drawn separately, so both totals stay as they are.
    """
    groups, keys = list(group_cols), list(key_cols)
    cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS)).cast("int")
    counts = checkpointed(
        counts.select(*groups, *keys, "pos", "neg").withColumn("__c", cell)
    )
    per_cell = counts.groupBy(*groups, "__c").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    # At most CELLS entries per group.
    packed = per_cell.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("__c", "pos", "neg"))).alias("__cells")
    )
    reps = packed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    draws = reps.select(
        *groups,
        "rep",
        "__cells",
        _cell_draws(stratified)(
            F.transform("__cells", lambda c: c["pos"]),
            F.transform("__cells", lambda c: c["neg"]),
            F.xxhash64(F.lit(seed), *groups, F.col("rep")),
        ).alias("d"),
    )
    per_rep = draws.select(
        *groups,
        "rep",
        F.inline(F.arrays_zip(F.col("__cells").alias("c"), F.col("d.pos").alias("p"), F.col("d.neg").alias("n"))),
    ).select(
        *groups,
        "rep",
        F.col("c.__c").alias("__c"),
        F.col("p").alias("d_pos"),
        F.col("n").alias("d_neg"),
    )
    per_rep = per_rep.where((F.col("d_pos") > 0) | (F.col("d_neg") > 0)).withColumn(
        "seed",
        F.xxhash64(F.lit(seed + 1), *groups, F.floor(F.col("rep") / REPS_PER_BLOCK), F.col("__c")),
    )
    block = F.floor(F.col("rep") / REPS_PER_BLOCK).cast("int")
    blocks = list(range((n_boot + REPS_PER_BLOCK - 1) // REPS_PER_BLOCK))
    left = counts.withColumn("__b", F.explode(F.array(*[F.lit(b) for b in blocks])))
    right = per_rep.withColumn("__b", block)
    kind = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    schema = ", ".join(
        [f"`{g}` {kind[g]}" for g in groups]
        + ["rep int"]
        + [f"`{k}` {kind[k]}" for k in keys]
        + ["pos bigint", "neg bigint"]
    )
    at = [*groups, "__c", "__b"]
    return (
        left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(_spread(keys, groups), schema)
    )


# --- metrics of replicates from partial sums --------------------------------------

#: Coarse cells of a group's ordered scores, and replicates that are drawn at once.
ORDERED_CELLS = 128
REPS_AT_ONCE = 50
PARTIALS = "n_pos bigint, n_neg bigint, won double, precision double, youden double"


def with_ordered_cells(
    counts: DataFrame, group_cols: Sequence[str], score_col: str = "score", out_col: str = "__c", n_cells: int = ORDERED_CELLS
) -> DataFrame:
    """Add ``__c``: cells in ascending score order that hold about equally many scores.

    The fixed fine cells of probabilities are counted and neighbours put together,
    so a running sum of at most 4,096 rows per group is all that is ordered.
    """
    groups = list(group_cols)
    fine = counts.withColumn(CELL, probability_cell(F.col(score_col)))
    sizes = fine.groupBy(*groups, CELL).agg(F.count(F.lit(1)).alias("__n"))
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    before = whole.orderBy(CELL).rowsBetween(W.unboundedPreceding, -1)
    share = F.coalesce(F.sum("__n").over(before), F.lit(0)) * n_cells / F.sum("__n").over(whole)
    return join_on_keys(fine, sizes.select(*groups, CELL, F.floor(share).cast("int").alias(out_col)), [*groups, CELL]).drop(CELL)


def _ordered_draws(stratified: bool):
    """Vectorised: a replicate's draws per cell and class, and those in higher cells."""

    def run(pos: pd.Series, neg: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        out = []
        for p, n, s in zip(pos, neg, seeds, strict=True):
            p, n = np.asarray(p, dtype=np.int64), np.asarray(n, dtype=np.int64)
            rng = _generator(s)
            if stratified:
                a = rng.multinomial(p.sum(), p / p.sum()) if p.sum() else p
                b = rng.multinomial(n.sum(), n / n.sum()) if n.sum() else n
            else:
                both = np.concatenate([p, n])
                drawn = rng.multinomial(both.sum(), both / both.sum())
                a, b = drawn[: len(p)], drawn[len(p) :]
            above = [x.sum() - np.cumsum(x) for x in (a, b)]
            out.append((a.tolist(), b.tolist(), above[0].tolist(), above[1].tolist()))
        return pd.DataFrame(out, columns=["pos", "neg", "tp", "fp"])

    return F.pandas_udf(
        run, "pos array<bigint>, neg array<bigint>, tp array<bigint>, fp array<bigint>"
    )


def drawn_counts(rng: np.random.Generator, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How ``n`` draws with replacement (one row each) fall on keys of the given sizes.

    Few draws a key are drawn one by one, many draws a key by their counts: the
    distribution is the same, the cost that of the cheaper way.
    """
    keys, total = len(sizes), int(sizes.sum())
    if not total:
        return np.zeros((len(n), keys), np.int64)
    if total > 4 * keys:
        return rng.multinomial(n, sizes / total)
    key_of = np.repeat(np.arange(keys), sizes)
    row = np.repeat(np.arange(len(n)), n) * keys
    return np.bincount(row + key_of[rng.integers(0, total, len(row))], minlength=len(n) * keys).reshape(-1, keys)


def _cell_partials(groups: list[str]):
    """Grouped: draw all replicates of one cell and sum up what the metrics need of it."""
    columns = [*groups, "rep", "n_pos", "n_neg", "won", "precision", "youden"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        left = left.sort_values("score", ascending=False)
        right = right.sort_values("rep")
        k = {c: left[c].to_numpy().astype(np.int64) for c in ("pos", "neg")}
        cell_seed, parts = int(right["seed"].iloc[0]), []
        for at in range(0, len(right), REPS_AT_ONCE):
            part = right.iloc[at : at + REPS_AT_ONCE]
            rng = _generator(cell_seed, at)
            a, b = (drawn_counts(rng, part[f"d_{c}"].to_numpy(), v) for c, v in k.items())
            n_pos, n_neg = (part[c].to_numpy()[:, None] for c in ("n_pos", "n_neg"))
            # Rows run from the highest score down; the offsets are what higher cells drew.
            tp = part["tp"].to_numpy()[:, None] + np.cumsum(a, axis=1)
            fp = part["fp"].to_numpy()[:, None] + np.cumsum(b, axis=1)
            there = a + b > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                precision = np.where(a > 0, a * (tp / (tp + fp)), 0.0)
                gap = np.where(there, tp / n_pos - fp / n_neg, -np.inf)
            parts.append(
                pd.DataFrame(
                    {
                        "rep": part["rep"].to_numpy(),
                        "n_pos": n_pos[:, 0],
                        "n_neg": n_neg[:, 0],
                        "won": (a * (n_neg - fp + b / 2)).sum(1),
                        "precision": precision.sum(1),
                        "youden": gap.max(1),
                    }
                )
            )
        out = pd.concat(parts, ignore_index=True)
        for g in groups:
            out[g] = left[g].iloc[0]
        return out[columns]

    return run


def replicate_metrics(
    counts: DataFrame,
    group_cols: Sequence[str],
    n_boot: int,
    seed: int = 0,
    stratified: bool = True,
) -> DataFrame:
    """(group…, rep, auroc, prauc, youden) of bootstrap samples of ``score_counts`` rows.

    Draws go to ordered cells first, so every cell knows what lies above it before its
    own scores are drawn: each (replicate, cell) then gives one row of sums, whatever
    the number of scores. Metrics are null for samples of one class.
    """
    groups = list(group_cols)
    cells = checkpointed(
        with_ordered_cells(counts.where((F.col("pos") > 0) | (F.col("neg") > 0)), groups)
    )
    per_cell = cells.groupBy(*groups, "__c").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # At most ORDERED_CELLS entries per group.
    packed = per_cell.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("__c", "pos", "neg"))).alias("__cells")
    )
    reps = packed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    reps = reps.repartition(*groups, "rep")
    drawn = reps.select(
        *groups,
        "rep",
        F.transform("__cells", lambda c: c["__c"]).alias("c"),
        _ordered_draws(stratified)(
            F.transform("__cells", lambda c: c["pos"]),
            F.transform("__cells", lambda c: c["neg"]),
            F.xxhash64(F.lit(seed), *groups, F.col("rep")),
        ).alias("d"),
    )

    def total(name: str) -> Column:
        return F.aggregate(F.col(f"d.{name}"), F.lit(0).cast("bigint"), lambda s, v: s + v)

    entries = F.arrays_zip(
        F.col("c"), F.col("d.pos").alias("p"), F.col("d.neg").alias("n"), F.col("d.tp").alias("tp"), F.col("d.fp").alias("fp")
    )
    right = drawn.select(
        *groups, "rep", total("pos").alias("n_pos"), total("neg").alias("n_neg"), F.explode(entries).alias("e")
    ).select(
        *groups,
        "rep",
        "n_pos",
        "n_neg",
        F.col("e.c").alias("__c"),
        F.col("e.p").alias("d_pos"),
        F.col("e.n").alias("d_neg"),
        F.col("e.tp").alias("tp"),
        F.col("e.fp").alias("fp"),
        F.xxhash64(F.lit(seed + 1), *groups, F.col("e.c")).alias("seed"),
    ).where((F.col("d_pos") > 0) | (F.col("d_neg") > 0))
    kind = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join([*(f"`{g}` {kind[g]}" for g in groups), "rep int", PARTIALS])
    at = [*groups, "__c"]
    partials = (
        cells.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(_cell_partials(groups), schema)
    )
    return _metrics_of_partials(partials, groups)


#: Coarse cells of each of two scores that are resampled together.
PAIR_CELLS = 32


def _paired_partials(groups: list[str], n_boot: int):
    """Grouped: replicate sums of one cell of one of the two scores.

    Draws go to the cells of both scores together first, then to the rows inside, always
    from the same seeds: what one score's cells draw, the other's draw again.
    """
    columns = [*groups, "side", "rep", "n_pos", "n_neg", "won", "precision", "youden"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        side, seed = int(right["side"].iloc[0]), int(right["seed"].iloc[0])
        c1, c2, *sizes = np.array([tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in right["cells"].iloc[0]], np.int64).T
        drawn = []
        for k, size in enumerate(sizes):
            total = int(size.sum())
            rng = _generator(seed, k)
            drawn.append(rng.multinomial(total, size / total, n_boot) if total else np.zeros((n_boot, len(size)), np.int64))
        own, place = (c1, c2)[side - 1], int(right["cell"].iloc[0])
        above = [d[:, own > place].sum(1) for d in drawn]
        n_pos, n_neg = (int(size.sum()) for size in sizes)

        left = left.sort_values(["c1", "c2", "s1", "s2"], kind="mergesort")
        score, at = np.unique(-left[f"s{side}"].to_numpy(), return_inverse=True)
        k = [left[c].to_numpy().astype(np.int64) for c in ("pos", "neg")]
        x, y = left["c1"].to_numpy(), left["c2"].to_numpy()
        starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        parts = []
        for i, j in zip(starts, np.append(starts[1:], len(x)), strict=True):
            here = int(np.flatnonzero((c1 == x[i]) & (c2 == y[i]))[0])
            by = np.argsort(at[i:j], kind="stable")
            ties = np.flatnonzero(np.append(True, np.diff(at[i:j][by]) > 0))
            parts.append((i, j, here, by, ties, at[i:j][by][ties]))
        out = []
        for rep in range(0, n_boot, REPS_PER_BLOCK):
            reps = slice(rep, min(rep + REPS_PER_BLOCK, n_boot))
            n = reps.stop - rep
            # Rows are replicates, columns this score's values from the highest down.
            a, b = table = np.zeros((2, n, len(score)), np.int64)
            for i, j, here, by, ties, to in parts:
                rng = _generator(seed, x[i], y[i], rep)
                for c in (0, 1):
                    inside = drawn_counts(rng, drawn[c][reps, here], k[c][i:j])
                    table[c][:, to] += np.add.reduceat(inside[:, by], ties, axis=1)
            tp = above[0][reps, None] + np.cumsum(a, axis=1)
            fp = above[1][reps, None] + np.cumsum(b, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                precision = np.where(a > 0, a * (tp / (tp + fp)), 0.0)
                gap = np.where(a + b > 0, tp / n_pos - fp / n_neg, -np.inf)
            out.append(
                pd.DataFrame(
                    {
                        "rep": np.arange(rep, reps.stop),
                        "won": (a * (n_neg - fp + b / 2)).sum(1),
                        "precision": precision.sum(1),
                        "youden": gap.max(1),
                    }
                )
            )
        frame = pd.concat(out, ignore_index=True).assign(side=side, n_pos=n_pos, n_neg=n_neg)
        for g in groups:
            frame[g] = left[g].iloc[0]
        return frame[columns]

    return run


def paired_replicate_metrics(
    counts: DataFrame, group_cols: Sequence[str], n_boot: int, seed: int = 0
) -> DataFrame:
    """(group…, side, rep, auroc, prauc, youden) of samples of pairs of scores.

    ``counts`` has a row per pair (``s1``, ``s2``) with ``pos`` and ``neg``; cases and
    controls are drawn separately, and both sides of a replicate are the same sample.
    A pair goes to one cell of either score, whose task draws it for all replicates and
    gives one row of sums each: no row of a sample leaves a task.
    """
    groups = list(group_cols)
    cells = counts.where((F.col("pos") > 0) | (F.col("neg") > 0))
    for k in (1, 2):
        cells = with_ordered_cells(cells, groups, f"s{k}", f"c{k}", PAIR_CELLS)
    cells = checkpointed(cells)
    per_cell = cells.groupBy(*groups, "c1", "c2").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # At most PAIR_CELLS squared entries per group.
    packed = per_cell.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("c1", "c2", "pos", "neg"))).alias("cells"))

    def places(k: int) -> Column:
        cell = F.array_distinct(F.col(f"cells.c{k}"))
        return F.transform(cell, lambda c: F.struct(F.lit(k).alias("side"), c.alias("cell")))

    right = packed.select(
        *groups, "cells", F.xxhash64(F.lit(seed), *groups).alias("seed"), F.inline(F.concat(places(1), places(2)))
    )
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"c{k}").alias("cell")) for k in (1, 2)])
    left = cells.select(*groups, "s1", "s2", "pos", "neg", "c1", "c2", F.inline(sides))
    kind = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join([*(f"`{g}` {kind[g]}" for g in groups), "side int", "rep int", PARTIALS])
    at = [*groups, "side", "cell"]
    partials = (
        left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(_paired_partials(groups, n_boot), schema)
    )
    return _metrics_of_partials(partials, [*groups, "side"])


def _metrics_of_partials(partials: DataFrame, groups: list[str]) -> DataFrame:
    p, n = F.max("n_pos").cast("double"), F.max("n_neg").cast("double")

    def both(value: Column) -> Column:
        return F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), value)

    return partials.groupBy(*groups, "rep").agg(
        both(F.sum("won") / (p * n)).alias("auroc"),
        both(F.sum("precision") / p).alias("prauc"),
        both(F.greatest(F.max("youden"), F.lit(0.0))).alias("youden"),
    )


def interval_of_replicates(
    values: DataFrame,
    group_cols: Sequence[str],
    n_boot: int,
    min_valid_frac: float = 0.1,
    value_col: str = "value",
) -> DataFrame:
    """2.5 and 97.5 percentiles over replicates; NULL if too few are defined."""
    needed = max(20, int(n_boot * min_valid_frac))
    ok = F.count(value_col) >= needed
    return values.groupBy(*group_cols).agg(
        F.when(ok, F.percentile(value_col, F.lit(0.025))).alias("ci_lower"),
        F.when(ok, F.percentile(value_col, F.lit(0.975))).alias("ci_upper"),
        F.count(value_col).alias("n_valid"),
    )


METRICS = {
    "auroc": C.auroc_of_roc,
    "prauc": C.average_precision_of_roc,
    "youden": C.youden_of_roc,
}


def bootstrap_replicates(
    df: DataFrame,
    group_cols: Sequence[str],
    metric: str | Column = "auroc",
    n_boot: int = 1000,
    seed: int = 0,
    stratified: bool = True,
    **cols,
) -> DataFrame:
    """(group…, rep, value): the metric of every bootstrap sample.

    ``metric`` names one of ``METRICS`` or is any aggregate over ROC rows.
    """
    return _replicates_of_counts(
        C.score_counts(df, list(group_cols), **cols), group_cols, metric, n_boot, seed, stratified
    )


def _replicates_of_counts(counts, group_cols, metric, n_boot, seed, stratified=True) -> DataFrame:
    groups = list(group_cols)
    if isinstance(metric, str):
        values = replicate_metrics(counts, groups, n_boot, seed, stratified)
        return values.select(*groups, "rep", F.col(metric).alias("value"))
    sampled = resampled_counts(counts, groups, ["score"], n_boot, seed, stratified)
    roc = C.roc_from_counts(sampled, [*groups, "rep"])
    return roc.groupBy(*groups, "rep").agg(C.only_two_class(metric).alias("value"))


def stratified_bootstrap_ci(
    df: DataFrame,
    group_cols: Sequence[str],
    metric: str | Column = "auroc",
    n_boot: int = 1000,
    seed: int = 0,
    min_valid_frac: float = 0.1,
    **cols,
) -> DataFrame:
    """Percentile interval with cases and controls resampled separately.

    Groups with fewer than two cases or two controls get no interval.
    """
    groups = list(group_cols)
    counts = checkpointed(C.score_counts(df, groups, **cols))
    sizes = counts.groupBy(*groups).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    values = _replicates_of_counts(counts, groups, metric, n_boot, seed)
    out = interval_of_replicates(values, groups, n_boot, min_valid_frac)
    enough = (F.col("__p") >= 2) & (F.col("__n") >= 2)
    return (
        join_on_keys(sizes, out, groups, "left")
        .withColumns(
            {c: F.when(enough, F.col(c)) for c in ("ci_lower", "ci_upper")}
        )
        .drop("__p", "__n")
    )


def bootstrap_difference_ci(
    df: DataFrame,
    group_cols: Sequence[str],
    p1_col: str,
    p2_col: str,
    metric: str = "auroc",
    n_boot: int = 500,
    seed: int = 0,
    min_valid_frac: float = 0.1,
    y_col: str = "y_true",
) -> DataFrame:
    """Difference of a metric between two scores with a paired bootstrap interval.

    Pairs of scores are resampled together; both metrics then come from the
    same samples.
    """
    groups = list(group_cols)
    value = METRICS[metric]
    y, a, b = F.col(y_col), F.col(p1_col).cast("double"), F.col(p2_col).cast("double")
    counts = checkpointed(
        df.where(finite(a) & finite(b) & y.isNotNull())
        .groupBy(*groups, a.alias("s1"), b.alias("s2"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    )

    def metric_of(table: DataFrame, keys: list[str], score: str, out: str) -> DataFrame:
        one = table.groupBy(*keys, F.col(score).alias("score")).agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
        )
        roc = C.roc_from_counts(one, keys)
        return roc.groupBy(*keys).agg(C.only_two_class(value()).alias(out))

    def difference(table: DataFrame, keys: list[str], out: str) -> DataFrame:
        m1, m2 = metric_of(table, keys, "s1", "m1"), metric_of(table, keys, "s2", "m2")
        return join_on_keys(m1, m2, keys).select(*keys, (F.col("m1") - F.col("m2")).alias(out))

    sampled = paired_replicate_metrics(counts, groups, n_boot, seed).groupBy(*groups, "rep")
    first, second = (F.max(F.when(F.col("side") == k, F.col(metric))) for k in (1, 2))
    replicates = sampled.agg((first - second).alias("value"))
    interval = interval_of_replicates(replicates, groups, n_boot, min_valid_frac)
    return join_on_keys(difference(counts, groups, "difference"), interval, groups)


def bootstrap_sd(
    df: DataFrame, group_cols: Sequence[str], n_boot: int = 50, seed: int = 42, **cols
) -> DataFrame:
    """Population SD of AUROC over plain (unstratified) bootstrap samples."""
    values = bootstrap_replicates(df, group_cols, "auroc", n_boot, seed, False, **cols)
    return values.groupBy(*group_cols).agg(
        F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("auroc_sd"),
        F.count("value").alias("n_valid"),
    )


def test_set_intervals(
    df: DataFrame,
    group_cols: Sequence[str],
    max_rows: int | None = None,
    n_boot: int = 1000,
    seed: int = 0,
    **cols,
) -> DataFrame:
    """AUROC and PR-AUC intervals of all groups, or of those with fewer than ``max_rows`` rows."""
    groups = list(group_cols)
    rows = df
    if max_rows is not None:
        sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"))
        rows = join_on_keys(df, sizes.where(F.col("n_rows") < max_rows), groups)
    counts = C.score_counts(rows, groups, **cols)
    values = checkpointed(replicate_metrics(counts, groups, n_boot, seed))
    out = None
    for name in ("auroc", "prauc"):
        part = interval_of_replicates(values, groups, n_boot, value_col=name).withColumn(
            "metric", F.lit(name)
        )
        out = part if out is None else out.unionByName(part)
    return out


def paired_comparison(
    metrics: DataFrame,
    metric_col: str = "auroc",
    pairs: Sequence[tuple[str, str, str]] = CONFIG_PAIRS,
    config_col: str = "config",
    seed_col: str = "split_seed",
) -> DataFrame:
    """Paired t test of configuration pairs per model, Bonferroni-adjusted.

    Runs are paired by seed. The number of tests is pairs × models.
    """
    spark = metrics.sparkSession
    wanted = spark.createDataFrame(list(pairs), "config1 string, config2 string, label string")
    rows = metrics.select("model", F.col(seed_col).alias("__seed"), F.col(config_col).alias("__c"),
                          F.col(metric_col).alias("__v"))
    left = rows.join(F.broadcast(wanted), rows["__c"] == wanted["config1"]).select(
        "model", "__seed", "config1", "config2", "label", F.col("__v").alias("__a")
    )
    right = rows.select(
        "model", "__seed", F.col("__c").alias("config2"), F.col("__v").alias("__b")
    )
    both = join_on_keys(left, right, ["model", "__seed", "config2"])
    diff = F.col("__a") - F.col("__b")
    stats = both.groupBy("model", "config1", "config2", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(diff).alias("mean_diff"),
        F.stddev_samp(diff).alias("__sd"),
        F.avg("__a").alias("__ma"),
        F.avg("__b").alias("__mb"),
        F.var_pop("__a").alias("__va"),
        F.var_pop("__b").alias("__vb"),
    )
    tests = rows.agg((F.count_distinct("model") * len(pairs)).alias("__tests"))
    pooled = F.sqrt((F.col("__va") + F.col("__vb")) / 2.0)
    t = F.try_divide(F.col("mean_diff"), F.col("__sd") / F.sqrt(F.col("n").cast("double")))
    out = stats.crossJoin(F.broadcast(tests)).select(
        "model",
        "config1",
        "config2",
        "label",
        "n",
        "mean_diff",
        F.coalesce(F.try_divide(F.col("__ma") - F.col("__mb"), pooled), F.lit(0.0)).alias("cohen_d"),
        t.alias("t_stat"),
        (F.lit(0.05) / F.col("__tests")).alias("alpha_corrected"),
        "__tests",
    )
    out = out.withColumn("p_value", t_p(F.col("t_stat"), (F.col("n") - 1).cast("double")))
    return out.withColumns(
        {
            "p_adj": F.col("p_value") * F.col("__tests"),
            "significant": F.col("p_value") < F.col("alpha_corrected"),
        }
    ).drop("__tests")


def effect_size(
    df: DataFrame, group_cols: Sequence[str], arm_col: str, value_col: str
) -> DataFrame:
    """Mean difference of two arms (smaller name minus larger) over their pooled population SD."""
    arms = df.groupBy(*group_cols, arm_col).agg(
        F.avg(value_col).alias("__m"), F.var_pop(value_col).alias("__v")
    )
    both = arms.groupBy(*group_cols).agg(
        F.min_by("__m", arm_col).alias("__m1"),
        F.max_by("__m", arm_col).alias("__m2"),
        F.avg("__v").alias("__v"),
    )
    return both.select(
        *group_cols,
        F.coalesce(
            F.try_divide(F.col("__m1") - F.col("__m2"), F.sqrt("__v")), F.lit(0.0)
        ).alias("effect_size"),
    )


def factorial_summary(
    metrics: DataFrame,
    metric_cols: Sequence[str],
    group_cols: Sequence[str] = ("config", "model"),
) -> DataFrame:
    """Mean, SD, runs and 95% t interval of every metric per configuration and model."""
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metric_cols]
    )
    stats = (
        metrics.select(*group_cols, F.inline(entries))
        .groupBy(*group_cols, "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("sd"),
            F.count("value").alias("n"),
        )
    )
    half = t_quantile_column(F.col("n") - 1) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return stats.withColumn("__half", half).select(
        *group_cols,
        "metric",
        "mean",
        "sd",
        "n",
        (F.col("mean") - F.col("__half")).alias("ci_lower"),
        (F.col("mean") + F.col("__half")).alias("ci_upper"),
    )


def compare_case_types(
    df: DataFrame,
    group_cols: Sequence[str],
    category_col: str = "category",
    p_col: str = "y_prob",
) -> DataFrame:
    """Scores of incident against prevalent cases: descriptives, tests, power."""
    groups = list(group_cols)
    p = F.col(p_col).cast("double")
    cases = df.where(F.col(category_col).isin("Incident", "Prevalent") & finite(p)).select(
        *groups, (F.col(category_col) == "Incident").cast("int").alias("y"), p.alias("p")
    )
    roc = C.roc_table(cases, groups, "y", "p")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    ties = pos + neg
    ranks = roc.groupBy(*groups).agg(
        F.max("n_pos").alias("n_incident"),
        F.max("n_neg").alias("n_prevalent"),
        F.sum(pos * (F.col("cum_neg") - neg / 2)).alias("mw_stat"),
        F.sum(ties * ties * ties - ties).alias("__ties"),
        F.max(
            F.abs(
                safe_div(F.col("cum_pos"), F.col("n_pos"))
                - safe_div(F.col("cum_neg"), F.col("n_neg"))
            )
        ).alias("ks_stat"),
    )
    moments = cases.groupBy(*groups).agg(
        *[
            fn(F.when(F.col("y") == v, F.col("p"))).alias(f"{name}_{stat}")
            for v, name in ((1, "incident"), (0, "prevalent"))
            for stat, fn in (("mean", F.avg), ("sd", F.stddev_pop), ("__var", F.var_samp))
        ]
    )
    q = exact_quantiles(cases, [*groups, "y"], "p", [0.25, 0.5, 0.75], probabilities=True)
    wide = q.groupBy(*groups).agg(
        *[
            F.max(F.when(F.col("y") == v, F.col(f"q_{i}"))).alias(f"{name}_{stat}")
            for v, name in ((1, "incident"), (0, "prevalent"))
            for i, stat in enumerate(("q25", "median", "q75"))
        ]
    )
    rows = join_on_keys(join_on_keys(ranks, moments, groups), wide, groups)
    rows = rows.where((F.col("n_incident") > 0) & (F.col("n_prevalent") > 0))
    n1, n2 = F.col("n_incident").cast("double"), F.col("n_prevalent").cast("double")
    n = n1 + n2
    mean_diff = F.col("incident_mean") - F.col("prevalent_mean")
    median_diff = F.col("incident_median") - F.col("prevalent_median")
    pooled = F.sqrt(
        F.try_divide(
            (n1 - 1) * F.col("incident___var") + (n2 - 1) * F.col("prevalent___var"), n - 2.0
        )
    )
    larger = F.greatest(F.col("mw_stat"), n1 * n2 - F.col("mw_stat"))
    mw_sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1.0) - F.try_divide(F.col("__ties"), n * (n - 1.0))))
    rows = rows.withColumns(
        {
            "mean_diff": mean_diff,
            "median_diff": median_diff,
            "mean_pct_diff": 100.0 * F.try_divide(mean_diff, F.col("prevalent_mean")),
            "median_pct_diff": 100.0 * F.try_divide(median_diff, F.col("prevalent_median")),
            "cohens_d": F.try_divide(mean_diff, pooled),
            "t_stat": F.try_divide(mean_diff, pooled * F.sqrt(1.0 / n1 + 1.0 / n2)),
            "mw_z": F.try_divide(larger - n1 * n2 / 2.0 - 0.5, mw_sd),
        }
    )
    shift = Z_975 - F.abs("cohens_d") * F.sqrt(n1 * n2 / n / F.lit(np.pi / 3))
    tests = {
        "mw_pval": normal_p(F.greatest(F.col("mw_z"), F.lit(0.0))),
        "t_pval": t_p(F.col("t_stat"), n - 2.0),
        "ks_pval": ks_p(F.col("ks_stat"), n1, n2),
        "power": normal_upper_p(F.when(F.col("cohens_d") != 0, shift)),
    }
    return rows.withColumns(tests).drop("__ties", "incident___var", "prevalent___var")


def _with_controls(
    df: DataFrame, group_cols: Sequence[str], category_col: str, p_col: str
) -> DataFrame:
    """Each case type together with all controls: (group…, case_type, y, p)."""
    category = F.col(category_col)
    both = F.array(F.lit("incident"), F.lit("prevalent"))
    types = F.when(category == "Controls", both).when(
        category.isin("Incident", "Prevalent"), F.array(F.lower(category))
    )
    return df.select(
        *group_cols,
        F.explode(types).alias("case_type"),
        (category != "Controls").cast("int").alias("y_true"),
        F.col(p_col).alias("y_prob"),
    )


def calibration_by_case_type(
    df: DataFrame,
    group_cols: Sequence[str],
    category_col: str = "category",
    p_col: str = "y_prob",
) -> DataFrame:
    """Intercept, slope and Brier of each case type against the controls."""
    keys = [*group_cols, "case_type"]
    rows = _with_controls(df, group_cols, category_col, p_col)
    fits = calibration_intercept_slope(rows, keys)
    return join_on_keys(brier_score(rows, keys), fits, keys)


def calibration_curve_by_case_type(
    df: DataFrame,
    group_cols: Sequence[str],
    n_bins: int = 10,
    category_col: str = "category",
    p_col: str = "y_prob",
) -> DataFrame:
    """Quantile calibration curve of each case type against the controls."""
    rows = _with_controls(df, group_cols, category_col, p_col)
    bins = quantile_bins(rows, [*group_cols, "case_type"], n_bins)
    return bins.withColumn("observed_freq", F.col("k") / F.col("n"))


def summarize_comparisons(runs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Case-type comparisons over runs, one row per model."""
    return runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum("n_incident").alias("n_incident"),
        F.sum("n_prevalent").alias("n_prevalent"),
        F.avg("median_diff").alias("median_diff_mean"),
        F.stddev_samp("median_diff").alias("median_diff_sd"),
        F.avg("cohens_d").alias("cohens_d_mean"),
        F.stddev_samp("cohens_d").alias("cohens_d_sd"),
        F.count_if(F.col("mw_pval") < alpha).alias("n_significant"),
    )


def compare_configurations(
    predictions: DataFrame, runs: DataFrame, run_col: str = "run_id"
) -> DataFrame:
    """Case-type comparison per run and model, joined with the run's settings."""
    stats = compare_case_types(predictions, [run_col, "model"])
    return stats.join(runs, run_col, "left")
