"""Column roles, validation, projection and row filters of a cohort table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.joins import join_on_keys

# Names of the cohort table and its labels.
ID = "eid"
TARGET = "CeD_comparison"
EVENT_DATE = "CeD_date"
NUMERIC_METADATA = ("age", "BMI")
CATEGORICAL_METADATA = ("sex", "Genetic ethnic grouping")
FEATURE_SUFFIX = "_resid"
CONTROL, INCIDENT, PREVALENT = "Controls", "Incident", "Prevalent"
SCENARIO_LABELS = {
    "IncidentOnly": (CONTROL, INCIDENT),
    "PrevalentOnly": (CONTROL, PREVALENT),
    "IncidentPlusPrevalent": (CONTROL, INCIDENT, PREVALENT),
}
SCENARIO_POSITIVE = {
    "IncidentOnly": INCIDENT,
    "PrevalentOnly": PREVALENT,
    "IncidentPlusPrevalent": INCIDENT,
}


@dataclass(frozen=True)
class ColumnRoles:
    """Names of features and metadata in a cohort."""

    features: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)

    @property
    def all(self) -> list[str]:
        return [*self.features, *self.numeric, *self.categorical]


def keep_column(
    numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None
):
    """Predicate on a column name: identity, target, date, metadata or feature."""
    meta = {*(NUMERIC_METADATA if numeric is None else numeric)}
    meta |= {*(CATEGORICAL_METADATA if categorical is None else categorical)}
    fixed = {ID, TARGET, EVENT_DATE} | meta
    return lambda name: name in fixed or name.endswith(FEATURE_SUFFIX)


def project_cohort(df: DataFrame, **metadata) -> DataFrame:
    """Keep only the cohort's columns; Catalyst carries this into the scan."""
    keep = keep_column(**metadata)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if keep(c)])


def feature_columns(columns: Sequence[str], suffix: str = FEATURE_SUFFIX) -> list[str]:
    """Feature names in table order, maybe none."""
    return [c for c in columns if c.endswith(suffix)]


def require_feature_columns(columns: Sequence[str], suffix: str = FEATURE_SUFFIX) -> list[str]:
    """Sorted feature names; an error if there are none."""
    found = sorted(feature_columns(columns, suffix))
    if not found:
        raise ValueError(f"no feature columns ending in {suffix!r}")
    return found


def resolve_roles(
    columns: Sequence[str],
    mode: str = "auto",
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
) -> ColumnRoles:
    """Roles by suffix and either the default metadata present or an explicit list."""
    features = feature_columns(columns)
    if not features:
        raise ValueError(f"no feature columns ending in {FEATURE_SUFFIX!r}")
    present = set(columns)
    if mode == "explicit":
        if numeric is None and categorical is None:
            raise ValueError("explicit mode needs numeric or categorical names")
        missing = sorted({*(numeric or ()), *(categorical or ())} - present)
        if missing:
            raise ValueError(f"metadata columns not in the table: {missing}")
        return ColumnRoles(features, list(numeric or ()), list(categorical or ()))
    return ColumnRoles(
        features,
        sorted(present.intersection(NUMERIC_METADATA)),
        sorted(present.intersection(CATEGORICAL_METADATA)),
    )


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def validate_cohort(df: DataFrame, id_col: str = ID, target_col: str = TARGET) -> None:
    """Raise unless identity, target, labels and numeric columns are as required."""
    missing = [c for c in (id_col, target_col) if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    label = F.col(target_col)
    known = label.isin(CONTROL, INCIDENT, PREVALENT)
    found = df.agg(
        F.min(F.when(~known, label)).alias("unknown"),
        F.count_if(label == CONTROL).alias("controls"),
        F.count_if(label.isin(INCIDENT, PREVALENT)).alias("cases"),
    ).first()
    if found["unknown"] is not None:
        raise ValueError(f"invalid target labels, e.g. {found['unknown']!r}")
    if not found["controls"]:
        raise ValueError("the cohort needs at least one control")
    if not found["cases"]:
        raise ValueError("the cohort needs at least one case")
    numeric = [c for c in NUMERIC_METADATA if c in df.columns]
    bad = [c for c in [*numeric, *feature_columns(df.columns)] if not _is_numeric(df, c)]
    if bad:
        raise ValueError(f"columns must be numeric: {bad}")


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its NULL / NaN count, from a single aggregation."""
    bad = [c for c in columns if not _is_numeric(df, c)]
    if bad:
        raise ValueError(f"columns must be numeric: {bad}")
    counts = df.agg(
        *[
            F.count_if(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))).alias(c)
            for c in columns
        ]
    )
    entries = [
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("n_missing")) for c in columns
    ]
    return counts.select(F.inline(F.array(*entries)))


def validate_binary(df: DataFrame, y_col: str) -> None:
    """Raise if a non-missing outcome is neither 0 nor 1."""
    y = F.col(y_col).cast("double")
    odd = df.where(y.isNotNull() & ~F.isnan(y) & ~y.isin(0.0, 1.0)).select(y_col).limit(1)
    row = odd.first()
    if row is not None:
        raise ValueError(f"outcome must be 0 or 1, found {row[0]}")


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast to double; what does not parse, and NaN, become NULL."""
    new = {}
    for c in columns:
        if c in df.columns:
            value = F.col(f"`{c}`").try_cast("double")
            new[c] = F.when(~F.isnan(value), value)
    return df.withColumns(new)


def fill_missing_category(
    df: DataFrame, columns: Sequence[str], value: str = "Missing"
) -> DataFrame:
    return df.fillna(value, subset=[c for c in columns if c in df.columns])


def data_summary(df: DataFrame, target_col: str = TARGET) -> DataFrame:
    """One row: rows, columns, features, rows per label, missing metadata."""
    metadata = [c for c in (*NUMERIC_METADATA, *CATEGORICAL_METADATA) if c in df.columns]
    target = F.col(target_col)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(feature_columns(df.columns))).alias("n_features"),
        F.count_if(target == CONTROL).alias("n_controls"),
        F.count_if(target == INCIDENT).alias("n_incident"),
        F.count_if(target == PREVALENT).alias("n_prevalent"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"missing_{c}") for c in metadata],
    )


def _uncertain_control(df: DataFrame, target_col: str, date_col: str) -> Column:
    if date_col not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col(target_col) == CONTROL, F.lit(False)) & F.col(date_col).isNotNull()


def filter_rows(
    df: DataFrame,
    drop_uncertain_controls: bool = True,
    drop_missing_metadata: bool = True,
    numeric: Sequence[str] | None = None,
    target_col: str = TARGET,
    date_col: str = EVENT_DATE,
) -> DataFrame:
    """Drop controls that carry an event date, then rows with missing metadata."""
    columns = [c for c in (NUMERIC_METADATA if numeric is None else numeric) if c in df.columns]
    out = df
    if drop_uncertain_controls:
        out = out.where(~_uncertain_control(df, target_col, date_col))
    return out.dropna(subset=columns) if drop_missing_metadata and columns else out


def filter_audit(
    df: DataFrame,
    drop_uncertain_controls: bool = True,
    drop_missing_metadata: bool = True,
    numeric: Sequence[str] | None = None,
    target_col: str = TARGET,
    date_col: str = EVENT_DATE,
) -> DataFrame:
    """Removal counts of ``filter_rows``, in one pass over its input."""
    columns = [c for c in (NUMERIC_METADATA if numeric is None else numeric) if c in df.columns]
    uncertain = (
        _uncertain_control(df, target_col, date_col) if drop_uncertain_controls else F.lit(False)
    )
    missing = F.lit(False)
    if drop_missing_metadata:
        for c in columns:
            missing = missing | F.col(c).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(uncertain).alias("n_removed_uncertain_controls"),
        F.count_if(~uncertain & missing).alias("n_removed_dropna_meta_num"),
        F.count_if(~uncertain & ~missing).alias("n_out"),
    )


def scenario_rows(df: DataFrame, scenario: str, target_col: str = TARGET) -> DataFrame:
    """Rows with a label of the scenario."""
    return df.where(F.col(target_col).isin(*scenario_labels(scenario)))


def scenario_labels(scenario: str) -> tuple[str, ...]:
    if scenario not in SCENARIO_LABELS:
        raise ValueError(f"unknown scenario {scenario!r}, one of {sorted(SCENARIO_LABELS)}")
    return SCENARIO_LABELS[scenario]


def positive_label(scenario: str) -> str:
    scenario_labels(scenario)
    return SCENARIO_POSITIVE[scenario]


def scenario_positives(scenario: str) -> list[str]:
    """All case labels of the scenario."""
    return [label for label in scenario_labels(scenario) if label != CONTROL]


def with_outcome(
    df: DataFrame, positives: Sequence[str] | str, target_col: str = TARGET, y_col: str = "y"
) -> DataFrame:
    """Add y = 1 for the given labels, else 0."""
    labels = [positives] if isinstance(positives, str) else list(positives)
    hit = F.coalesce(F.col(target_col).isin(*labels), F.lit(False))
    return df.withColumn(y_col, hit.cast("int"))


def category_counts(
    df: DataFrame, group_cols: Sequence[str] = (), category_col: str = "category"
) -> DataFrame:
    """Controls, incident, prevalent and all rows per group."""
    c = F.col(category_col)
    return df.groupBy(*group_cols).agg(
        F.count_if(c == CONTROL).alias("controls"),
        F.count_if(c == INCIDENT).alias("incident"),
        F.count_if(c == PREVALENT).alias("prevalent"),
        F.count(F.lit(1)).alias("total"),
    )


def probability_report(
    df: DataFrame, group_cols: Sequence[str], p_col: str = "y_prob"
) -> DataFrame:
    """Counts of NULL, NaN, infinite and out-of-range probabilities, and the range."""
    p = F.col(p_col)
    infinite = F.abs(p) == F.lit(float("inf"))
    ordinary = p.isNotNull() & ~F.isnan(p) & ~infinite
    return df.groupBy(*group_cols).agg(
        F.count_if(p.isNull() | F.isnan(p)).alias("n_missing"),
        F.count_if(infinite).alias("n_infinite"),
        F.count_if(ordinary & ((p < 0) | (p > 1))).alias("n_outside"),
        F.min(F.when(ordinary, p)).alias("p_min"),
        F.max(F.when(ordinary, p)).alias("p_max"),
    )


def validate_probabilities(df: DataFrame, p_col: str = "y_prob", name: str = "split") -> None:
    row = probability_report(df, [], p_col).first()
    if row["n_missing"] or row["n_infinite"] or row["n_outside"]:
        raise ValueError(f"invalid probabilities in {name}: {row.asDict()}")


def class_report(df: DataFrame, group_cols: Sequence[str], y_col: str = "y_true") -> DataFrame:
    """Positives, negatives and whether both classes occur."""
    pos, neg = F.count_if(F.col(y_col) == 1), F.count_if(F.col(y_col) == 0)
    return df.groupBy(*group_cols).agg(
        pos.alias("n_pos"), neg.alias("n_neg"), ((pos > 0) & (neg > 0)).alias("two_classes")
    )


def melt_array(
    df: DataFrame,
    array_col: str,
    keep: Sequence[str],
    prefix: str = "f",
    names: Sequence[str] | None = None,
) -> DataFrame:
    """(keep…, feature, value) from one array column; NaN becomes NULL.

    A feature is called by its entry in ``names``, else by the prefix and its
    position, filled up to four digits (``lpad`` alone would cut longer ones).
    """
    value = F.col("__v").cast("double")
    place = F.col("__i").cast("string")
    if names is None:
        width = F.greatest(F.lit(4), F.length(place))
        feature = F.concat(F.lit(prefix), F.lpad(place, width, F.lit("0")))
    else:
        feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__i") + 1)
    return df.select(*keep, F.posexplode(array_col).alias("__i", "__v")).select(
        *keep, feature.alias("feature"), F.when(~F.isnan(value), value).alias("value")
    )


def melt_columns(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep…, feature, value) from wide feature columns; NaN becomes NULL.

    The columns are first packed into one array, so the plan holds one explode
    however many features there are.
    """
    names = F.array(*[F.lit(f) for f in features])
    values = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    long = df.select(*keep, F.posexplode(values).alias("__i", "__v"))
    return long.select(
        *keep,
        F.element_at(names, F.col("__i") + 1).alias("feature"),
        F.when(~F.isnan("__v"), F.col("__v")).alias("value"),
    )


def preprocessing_stages(
    numeric: Sequence[str],
    categorical: Sequence[str],
    category_levels: dict[str, int] | None = None,
    output_col: str = "features",
) -> list:
    """Standardised numbers and one-hot categories without the first level.

    A level unseen in training encodes as all zeros. ``category_levels`` gives
    the number of levels per category, which the slicer needs to drop the
    first level and the slot for unseen ones. Spark scales by the sample SD.
    """
    stages = []
    assembled = VectorAssembler(
        inputCols=list(numeric), outputCol="__num", handleInvalid="keep"
    )
    stages += [
        assembled,
        StandardScaler(inputCol="__num", outputCol="__num_scaled", withMean=True, withStd=True),
    ]
    parts = ["__num_scaled"]
    if categorical:
        index = [f"__idx_{i}" for i in range(len(categorical))]
        onehot = [f"__hot_{i}" for i in range(len(categorical))]
        stages.append(
            StringIndexer(
                inputCols=list(categorical),
                outputCols=index,
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
        )
        stages.append(
            OneHotEncoder(
                inputCols=index, outputCols=onehot, dropLast=False, handleInvalid="keep"
            )
        )
        for i, name in enumerate(categorical):
            levels = (category_levels or {}).get(name)
            if levels is None or levels < 2:
                raise ValueError(f"category_levels must give at least 2 levels for {name!r}")
            stages.append(
                VectorSlicer(
                    inputCol=onehot[i], outputCol=f"__cat_{i}", indices=list(range(1, levels))
                )
            )
            parts.append(f"__cat_{i}")
    stages.append(VectorAssembler(inputCols=parts, outputCol=output_col, handleInvalid="keep"))
    return stages


def preprocessor(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Pipeline of ``preprocessing_stages`` with level counts read from ``df``."""
    levels: dict[str, int] = {}
    if categorical:
        row = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in categorical]).first()
        levels = {c: row[c] for c in categorical}
    usable = [c for c in categorical if levels[c] >= 2]
    return Pipeline(stages=preprocessing_stages(numeric, usable, levels))


def split_rows(
    cohort: DataFrame, assignment: DataFrame, split: str, id_col: str = "id"
) -> DataFrame:
    """Rows of one split; an assigned id that the cohort lacks is an error."""
    chosen = assignment.where(F.col("split") == split).select(id_col).distinct()
    absent = join_on_keys(chosen, cohort.select(id_col), [id_col], "left_anti").limit(1).first()
    if absent is not None:
        raise ValueError(f"id {absent[0]!r} of split {split} is not in the cohort")
    return join_on_keys(cohort, chosen, [id_col], "left_semi")
