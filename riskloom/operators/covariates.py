"""Metadata beside the measured features: numbers and categories of every person.

Categories become one number per level after the first, in the order of their names. A
level that training did not have, like a missing category, is zero in all of them; a
missing number takes the mean of training.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More levels than this are no category but an id.
MAX_LEVELS = 100


@dataclass(frozen=True)
class Covariates:
    """What training rows say about the metadata: means of numbers, levels of categories."""

    means: tuple[tuple[str, float], ...] = ()
    levels: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def names(self) -> list[str]:
        coded = [f"{column}_{level}" for column, kept in self.levels for level in kept[1:]]
        return [column for column, _ in self.means] + coded

    def values(self) -> Column:
        """An array of doubles in the order of ``names``, without nulls."""
        entries = [
            F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(mean))
            for c, mean in self.means
        ]
        for column, kept in self.levels:
            own = F.col(f"`{column}`").cast("string")
            entries += [F.when(own == level, 1.0).otherwise(0.0) for level in kept[1:]]
        return F.array(*entries).cast("array<double>")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str | None) -> Covariates:
        """What ``to_json`` gave; without a text, no covariates."""
        if not text:
            return Covariates()
        parts = json.loads(text)
        return Covariates(
            tuple((c, float(m)) for c, m in parts["means"]),
            tuple((c, tuple(kept)) for c, kept in parts["levels"]),
        )


def fit_covariates(
    train: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()
) -> Covariates:
    """Means and levels of the given columns, in one pass that returns one row.

    Names that the rows do not have are an error. A category with one level adds
    nothing; one with more than ``MAX_LEVELS`` is refused.
    """
    missing = sorted({*numeric, *categorical} - set(train.columns))
    if missing:
        raise ValueError(f"no metadata columns {missing}")
    if not numeric and not categorical:
        return Covariates()
    wanted = []
    for i, c in enumerate(numeric):
        value = F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))
        wanted.append(F.coalesce(F.avg(value), F.lit(0.0)).alias(f"n{i}"))
    for i, c in enumerate(categorical):
        wanted.append(F.approx_count_distinct(F.col(f"`{c}`")).alias(f"c{i}"))
    row = train.agg(*wanted).first()
    wide = [c for i, c in enumerate(categorical) if row[f"c{i}"] > 2 * MAX_LEVELS]
    levels = []
    if categorical and not wide:
        # Few distinct values each, so their sets fit in one row.
        sets = [F.collect_set(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(categorical)]
        found = train.agg(*sets).first()
        levels = [(c, tuple(sorted(found[f"c{i}"]))) for i, c in enumerate(categorical)]
        wide = [c for c, kept in levels if len(kept) > MAX_LEVELS]
    if wide:
        raise ValueError(f"more than {MAX_LEVELS} levels: {wide}")
    means = tuple((c, float(row[f"n{i}"])) for i, c in enumerate(numeric))
    return Covariates(means, tuple((c, kept) for c, kept in levels if len(kept) > 1))


def with_covariates(cohort: DataFrame, covariates: Covariates, feature_col: str) -> DataFrame:
    """``feature_col`` followed by the covariates."""
    if not covariates.names:
        return cohort
    own = F.col(feature_col).cast("array<double>")
    return cohort.withColumn(feature_col, F.concat(own, covariates.values()))
