"""Search, nested cross-validation and elimination of penalised logistic models.

Every function collects the fits that it needs over all folds, candidates and panel
sizes and has them fitted together (see ``fits``); held-out rows then get the scores
of all candidates or sizes as one array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import curves as C
from riskloom.operators.discrimination import brier_of_counts, discrimination_aggregates
from riskloom.operators.fits import (
    MAX_FEATURES,
    NOBODY,
    OUTSIDE,
    Blocks,
    Fit,
    Fitted,
    Moments,
    elimination_paths,
    fit_many,
    fold_scores,
    moments,
    pack,
)
from riskloom.operators.splits import fold_column, hash_ranked
from riskloom.session import checkpointed

LINEAR = ("LR_EN", "LR_L1")
#: What a candidate may name: inverse penalty, share of the absolute penalty, number
#: of features taken by F inside each training set, and weights of the classes.
SEARCHED = ("C", "l1_ratio", "k", "class_weight")

METRICS = {
    "roc_auc": C.auroc_of_roc,
    "average_precision": C.average_precision_of_roc,
    "tpr_at_fpr": lambda: C.tpr_at_fpr_of_roc(0.05),
    "neg_brier_score": lambda: -brier_of_counts(),
}


def batched(df: DataFrame, model_name: str) -> bool:
    """Whether fits of this model on these rows can share their passes."""
    if model_name not in LINEAR:
        return False
    first = df.select("features").first()
    return first is not None and first["features"].size <= MAX_FEATURES


def checked(choices: Sequence[Mapping]) -> None:
    for key in sorted({k for c in choices for k in c} - {*SEARCHED, "max_iter", "tol"}):
        raise ValueError(f"{key!r} cannot be searched: one of {SEARCHED}")


def with_inner_folds(df: DataFrame, folds: int, repeats: int, inner_folds: int, seed: int) -> DataFrame:
    """(id, member): the inner fold of a row in each outer training set, -1 where it is held out.

    Outer splits are numbered repeat · folds + fold. Inner folds are dealt by hash order
    inside each outer training set and class.
    """
    assigned = fold_column(df, folds, repeats, seed).select("id", "y", "repeat", "fold")
    every = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("out")
    spread = assigned.select("id", "y", "repeat", "fold", every).select(
        "id", "y", (F.col("repeat") * folds + F.col("out")).alias("outer"), (F.col("fold") != F.col("out")).alias("inside")
    )
    ranked = hash_ranked(
        spread.where("inside"), ["outer", "y"], "id", F.lit(seed) + F.col("outer"), salt=8
    )
    inside = ranked.select("id", "outer", ((F.col("rank") - 1) % inner_folds).cast("int").alias("fold"))
    outside = spread.where(~F.col("inside")).select("id", "outer", F.lit(OUTSIDE).alias("fold"))
    packed = inside.unionByName(outside).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("outer", "fold"))).alias("m")
    )
    return packed.select("id", F.transform("m", lambda e: e["fold"]).alias("member"))


def with_folds(df: DataFrame, n_folds: int, seed: int) -> DataFrame:
    """The rows with ``member``: one column of stratified folds."""
    own = df.drop("fold", "repeat", "member")
    folds = fold_column(own, n_folds, 1, seed).select("id", F.array("fold").alias("member"))
    return own.join(folds, "id")


def candidate_fit(
    sums: Moments,
    base: Fit,
    model_name: str,
    choice: Mapping,
    n_rows: int,
    within: frozenset[int] | None = None,
    k: int | None = None,
) -> Fit:
    """``base`` with a candidate's penalty, features and class weights."""
    k = choice.get("k", k)
    allowed = sums.best(base, int(k), within) if k else within
    case, control = class_weights(sums, base, choice["class_weight"]) if "class_weight" in choice else (1.0, 1.0)
    return replace(
        base,
        penalty=1.0 / (choice.get("C", 1.0) * max(1, n_rows)),
        ratio=1.0 if model_name == "LR_L1" else choice.get("l1_ratio", 0.5),
        allowed=allowed,
        case=case,
        control=control,
    )


def class_weights(sums: Moments, fit: Fit, mode) -> tuple[float, float]:
    """Weight of a case and of a control: ``balanced``, ``scale_pos``, None, or {0: …, 1: …}."""
    if mode is None or mode == "none":
        return 1.0, 1.0
    if isinstance(mode, Mapping):
        return float(mode.get(1, mode.get("1", 1.0))), float(mode.get(0, mode.get("0", 1.0)))
    n0, n1 = (max(int(v), 1) for v in sums.training(fit).rows)
    if mode == "balanced":
        return (n0 + n1) / (2.0 * n1), (n0 + n1) / (2.0 * n0)
    if mode == "scale_pos":
        return max(1.0, n0 / n1), 1.0
    raise ValueError(f"unknown class weight mode: {mode}")


def _weighted(df: DataFrame, choices: Sequence[Mapping]) -> DataFrame:
    """Candidates that weigh classes do so on rows that all weigh the same."""
    named = {"class_weight" in c for c in choices}
    if named == {True, False}:
        raise ValueError("either all candidates name class_weight or none does")
    if "weight" not in df.columns or named == {True}:
        return df.withColumn("weight", F.lit(1.0))
    return df


def array_metrics(scored: DataFrame, groups: Sequence[str], place: str, aggregates: Sequence[Column]) -> DataFrame:
    """Metrics of each place in the ``scores`` arrays per group; null with one class only."""
    rows = scored.select(*groups, "y_true", F.posexplode("scores").alias(place, "y_prob"))
    return C.roc_table(rows, [*groups, place]).groupBy(*groups, place).agg(*aggregates)


def _scored_candidates(
    blocks: Blocks, sums: Moments, model_name: str, choices: Sequence[Mapping], sizes: Mapping[int, int],
    inner_folds: int, within: Mapping[int, frozenset[int] | None], k: int | None,
) -> DataFrame:
    """Scores of all candidates for the held-out rows of all inner folds of all columns."""
    fits, plan = [], {}
    for column in range(blocks.columns):
        for g in range(inner_folds):
            plan[column, g] = range(len(fits), len(fits) + len(choices))
            base = Fit(column, g)
            fits += [
                candidate_fit(sums, base, model_name, c, sizes[column], within.get(column), k) for c in choices
            ]
    return fold_scores(blocks, fit_many(blocks, sums, fits), plan)


def candidate_scores(
    train: DataFrame,
    model_name: str,
    choices: Sequence[Mapping],
    inner_folds: int,
    metrics: Mapping[str, Column],
    seed: int,
    indices: Sequence[int] | None = None,
) -> dict[str, list[float | None]]:
    """Mean over inner folds of each metric for each candidate."""
    checked(choices)
    blocks = pack(with_folds(_weighted(train, choices), inner_folds, seed), inner_folds)
    sums = moments(blocks)
    within = {0: None if indices is None else frozenset(indices)}
    sizes = {0: int(sums.rows.sum())}
    scored = _scored_candidates(blocks, sums, model_name, choices, sizes, inner_folds, within, None)
    per_fold = array_metrics(
        scored, ["fold"], "candidate", [C.only_two_class(v).alias(n) for n, v in metrics.items()]
    )
    means = per_fold.groupBy("candidate").agg(*[F.avg(n).alias(n) for n in metrics]).collect()
    blocks.release()
    found = {r["candidate"]: r for r in means}  # a row per candidate
    return {n: [found[c][n] if c in found else None for c in range(len(choices))] for n in metrics}


def best_of(scores: Sequence[float | None]) -> int:
    """Place of the largest score, the first of equal ones; undefined scores come last."""
    return max(range(len(scores)), key=lambda i: (scores[i] is not None, scores[i] or 0.0, -i))


def nested(
    df: DataFrame,
    names: Sequence[str],
    model_name: str,
    folds: int,
    repeats: int,
    inner_folds: int,
    choices: Sequence[Mapping] | None,
    k: int | None,
    base_features,
    scoring: str,
    seed: int,
) -> dict:
    """All fits of a nested cross-validation: inner ones in one batch, outer ones in a second.

    ``k`` features are taken by F inside every inner training set, unless a candidate
    names its own number. ``base_features(train)`` gives the features of an outer
    training set, or is None for all. Returns oof rows, inner scores of the chosen
    candidates, and per outer split the choice, score, features and coefficients.
    """
    choices = [dict(c) for c in choices or [{}]]
    checked(choices)
    rows = _weighted(df.drop("fold", "repeat", "member"), choices)
    member = checkpointed(with_inner_folds(rows, folds, repeats, inner_folds, seed))
    joined = rows.join(member, "id")
    outer = range(folds * repeats)
    within: dict[int, frozenset[int] | None] = dict.fromkeys(outer)
    if base_features is not None:
        position = {n: i for i, n in enumerate(names)}
        for o in outer:
            part = joined.where(F.col("member")[o] != OUTSIDE).drop("member")
            within[o] = frozenset(position[n] for n in base_features(part))
    blocks = pack(joined, inner_folds, len(outer))
    sums = moments(blocks)
    sizes = {o: int(sums.rows[o].sum()) for o in outer}
    scored = checkpointed(
        _scored_candidates(blocks, sums, model_name, choices, sizes, inner_folds, within, k)
    )
    best, score = dict.fromkeys(outer, 0), dict.fromkeys(outer)
    if len(choices) > 1 or choices[0]:
        value = C.only_two_class(METRICS[scoring]()).alias("v")
        per_fold = array_metrics(scored, ["column", "fold"], "candidate", [value])
        means = per_fold.groupBy("column", "candidate").agg(F.avg("v").alias("v")).collect()
        table = {(r["column"], r["candidate"]): r["v"] for r in means}
        for o in outer:
            mine = [table.get((o, c)) for c in range(len(choices))]
            best[o] = best_of(mine)
            score[o] = mine[best[o]]
    final = [
        candidate_fit(sums, Fit(o), model_name, choices[best[o]], sizes[o], within[o], k) for o in outer
    ]
    fitted = fit_many(blocks, sums, final)
    oof = checkpointed(fold_scores(blocks, fitted, {(o, OUTSIDE): [o] for o in outer}))
    blocks.release()
    oof = oof.select(
        "id",
        "y_true",
        F.expr(f"column div {folds}").cast("int").alias("repeat"),
        (F.col("column") % folds).cast("int").alias("fold"),
        F.col("scores")[0].alias("y_prob"),
    )
    chosen = F.element_at(F.create_map(*[F.lit(v) for o in outer for v in (o, best[o])]), F.col("column"))
    inner = scored.select("column", "id", "y_true", F.get("scores", chosen).alias("y_prob"))
    everything = frozenset(range(len(names)))
    return {
        "oof": oof,
        "inner": inner,
        "choices": [choices[best[o]] for o in outer],
        "scores": [score[o] for o in outer],
        "features": [[n for i, n in enumerate(names) if i in (f.allowed or everything)] for f in final],
        "coefficients": fitted.standardised[:, :-1],
    }


def cross_fitted(
    df: DataFrame, model_name: str, params: Mapping, indices: Sequence[int] | None, n_folds: int, seed: int
) -> DataFrame:
    """(id, y_true, y_prob) by the fold models that did not see the row."""
    blocks = pack(with_folds(_weighted(df, [params]), n_folds, seed), n_folds)
    sums = moments(blocks)
    within = None if indices is None else frozenset(indices)
    fits = []
    for g in range(n_folds):
        base = Fit(0, g)
        fits.append(
            candidate_fit(sums, base, model_name, params, int(sums.training(base).rows.sum()), within)
        )
    scored = fold_scores(blocks, fit_many(blocks, sums, fits), {(0, g): [g] for g in range(n_folds)})
    out = checkpointed(scored.select("id", "y_true", F.col("scores")[0].alias("y_prob")))
    blocks.release()
    return out


def _all_rows(df: DataFrame) -> DataFrame:
    return df.drop("fold", "repeat").withColumn("member", F.array(F.lit(0)))


def eliminated(
    train: DataFrame,
    validation: DataFrame,
    names: Sequence[str],
    start: Sequence[str],
    model_name: str,
    params: Mapping,
    smallest: int,
    step: int,
    cv_folds: int,
    seed: int,
) -> dict:
    """Elimination inside each fold and on all rows, all paths together.

    Returns the mean held-out AUROC per size, the sets of the path on all rows, and
    the validation AUROC of each of these.
    """
    blocks = pack(with_folds(_weighted(train, [params]), cv_folds, seed), cv_folds)
    sums = moments(blocks)
    position = {n: i for i, n in enumerate(names)}
    within = frozenset(position[n] for n in start)
    bases = [Fit(0, g) for g in (*range(cv_folds), NOBODY)]
    fits = [
        candidate_fit(sums, b, model_name, params, int(sums.training(b).rows.sum()), within) for b in bases
    ]
    paths = elimination_paths(blocks, sums, fits, names, smallest, step)
    sizes = [len(s) for s in paths[0][0]]
    together = _joined([p for _, p in paths])
    plan = {(0, g): range(g * len(sizes), (g + 1) * len(sizes)) for g in range(cv_folds)}
    auroc = C.only_two_class(C.auroc_of_roc()).alias("auroc")
    per_fold = array_metrics(fold_scores(blocks, together, plan), ["fold"], "place", [auroc])
    means = {r["place"]: r["v"] for r in per_fold.groupBy("place").agg(F.avg("auroc").alias("v")).collect()}
    blocks.release()
    held = pack(_all_rows(_weighted(validation, [params])), 1)
    on_validation = array_metrics(
        fold_scores(held, paths[-1][1], {(0, 0): range(len(sizes))}), ["column"], "place", [auroc]
    )
    reached = {r["place"]: r["auroc"] for r in on_validation.collect()}
    held.release()
    return {
        "scores": {size: means.get(i) for i, size in enumerate(sizes)},
        "sets": [[n for n in names if position[n] in s] for s in paths[-1][0]],
        "validation": [reached.get(i) for i in range(len(sizes))],
    }


def _joined(parts: Sequence[Fitted]) -> Fitted:
    return Fitted(
        np.concatenate([p.coefficients for p in parts]),
        np.concatenate([p.intercepts for p in parts]),
        np.concatenate([p.standardised for p in parts]),
        0,
    )


def elimination_curve(
    train: DataFrame,
    validation: DataFrame,
    names: Sequence[str],
    start: Sequence[str],
    model_name: str,
    params: Mapping,
    sizes: Sequence[int],
    cv_folds: int,
    n_boot: int,
    seed: int,
    always: Sequence[str] = (),
) -> tuple[list[dict], list[str]]:
    """Points of the curve at ``sizes`` and the names in the order in which they left.

    Names in ``always`` are in every fit; neither sizes nor points count them.
    """
    from riskloom.operators.resample import bootstrap_sd

    position = {n: i for i, n in enumerate(names)}
    folds = max(cv_folds, 1)
    rows = _weighted(train, [params])
    blocks = pack(with_folds(rows, folds, seed) if cv_folds > 1 else _all_rows(rows), folds)
    sums = moments(blocks)
    kept = frozenset(position[n] for n in always)
    whole = candidate_fit(
        sums, Fit(0), model_name, params, int(sums.rows.sum()), kept | {position[n] for n in start}
    )
    (sets, path), = elimination_paths(blocks, sums, [whole], names, sizes[-1], always=kept)
    at = [next(i for i, s in enumerate(sets) if len(s - kept) <= size) for size in sizes]
    if cv_folds > 1:
        fits = []
        for g in range(cv_folds):
            base = Fit(0, g)
            n = int(sums.training(base).rows.sum())
            fits += [candidate_fit(sums, base, model_name, params, n, sets[i]) for i in at]
        plan = {(0, g): range(g * len(at), (g + 1) * len(at)) for g in range(cv_folds)}
        scored = fold_scores(blocks, fit_many(blocks, sums, fits), plan)
    else:
        scored = fold_scores(blocks, path, {(0, 0): at})
    inner = checkpointed(scored.select("y_true", F.posexplode("scores").alias("place", "y_prob")))
    blocks.release()
    held = pack(_all_rows(_weighted(validation, [params])), 1)
    outer = fold_scores(held, path, {(0, 0): at})
    outer = checkpointed(outer.select("y_true", F.posexplode("scores").alias("place", "y_prob")))
    held.release()
    free = [sets[i] - kept for i in at]
    points = [{"size": len(s), "features": sorted(names[j] for j in s)} for s in free]
    for suffix, table in (("cv", inner), ("val", outer)):
        aggregates = [*discrimination_aggregates(include_youden=False), brier_of_counts().alias("b")]
        for r in C.roc_table(table, ["place"]).groupBy("place").agg(*aggregates).collect():
            points[r["place"]].update(
                {
                    f"auroc_{suffix}": r["auroc"], f"prauc_{suffix}": r["prauc"],
                    f"brier_{suffix}": r["b"], f"sens95_{suffix}": r["sensitivity_at_spec"],
                }
            )
    if cv_folds > 1:
        for r in bootstrap_sd(inner, ["place"], n_boot, seed).collect():
            points[r["place"]]["auroc_cv_std"] = float(r["auroc_sd"] or 0.0)
    gone = [names[j] for a, b in zip(sets, sets[1:], strict=False) for j in sorted(a - b)]
    return points, gone
