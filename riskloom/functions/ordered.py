"""Exact running totals and ranks without a window over a whole group.

A plain ``sum() over (partition by group order by value)`` sends a group to one
task, and a group (one model's predictions, one stratum of controls) may hold a
third of all rows. Here the values of a group are first put into *cells*: a
fixed number of intervals in value order. Totals per cell are small, so their
running sum may use a window over the group; the running sum inside a cell uses
a window over (group, cell). Any monotone cell function gives the same result;
the choice only decides how even the tasks are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.joins import join_on_keys
from riskloom.session import checkpointed

CELL = "__cell"
CELLS = 4096


def probability_cell(p: Column, cells: int = CELLS) -> Column:
    """Cell of a probability, finer towards 0 and 1 where risk scores crowd.

    Only square roots and products are used, which are exactly rounded, so that
    all executors agree. Values outside [0, 1] fall into the edge cells.
    """
    q = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    spread = F.when(q < 0.5, F.sqrt(q / 2)).otherwise(F.lit(1.0) - F.sqrt((F.lit(1.0) - q) / 2))
    return F.least(F.floor(spread * cells), F.lit(cells - 1)).cast("int")


def hash_cell(h: Column) -> Column:
    """Cell of a signed 64-bit hash, in the order of the hash (4,096 cells)."""
    return F.shiftright(h, 52).cast("int")


def with_value_cells(
    df: DataFrame, group_cols: Sequence[str], value_col: str, cells: int = 1024
) -> DataFrame:
    """Add cells for values of any range: two levels of equal-width intervals.

    The first level spans the group's own minimum and maximum, the second the
    minimum and maximum found inside each first-level interval, so one outlier
    does not crowd all other values into one cell. Minimum and maximum do not
    depend on the order of rows, hence neither do the cells. The input is read
    once per level and again by the caller, so it is checkpointed first: the
    source behind it is scanned once.
    """
    groups = list(group_cols)
    df = checkpointed(df)
    value = F.col(value_col).cast("double")

    def level(frame: DataFrame, keys: list[str], out: str) -> DataFrame:
        ends = frame.groupBy(*keys).agg(
            F.min(value).alias("__lo"), F.max(value).alias("__hi")
        )
        place = F.floor(
            F.try_divide(value - F.col("__lo"), F.col("__hi") - F.col("__lo")) * cells
        )
        joined = join_on_keys(frame, ends, keys)
        return joined.withColumn(
            out, F.coalesce(F.least(place, F.lit(cells - 1)), F.lit(0)).cast("int")
        ).drop("__lo", "__hi")

    coarse = level(df, groups, "__coarse")
    fine = level(coarse, [*groups, "__coarse"], "__fine")
    return fine.withColumn(CELL, F.col("__coarse") * cells + F.col("__fine")).drop(
        "__coarse", "__fine"
    )


def running_totals(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    sum_cols: Sequence[str],
    carry_cols: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ascending ``order_cols``.

    ``df`` has one row per (group, order) and a ``__cell`` column. Added are
    ``cum_<c>`` (up to and including the row) and ``total_<c>`` (whole group);
    for every carried column ``prev_<c>``, its value one row below.
    """
    groups, order = list(group_cols), list(order_cols)
    keys = [*groups, CELL]
    aggs = [F.sum(c).alias(f"__in_{c}") for c in sum_cols]
    # Plain columns keep the aggregation hash-based; a struct would need a sort.
    top = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    aggs += [F.max_by(c, top).alias(f"__last_{c}") for c in carry_cols]
    per_cell = df.groupBy(*keys).agg(*aggs)
    by_cell = W.partitionBy(*groups).orderBy(CELL)
    below = by_cell.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    out = [*keys]
    for c in sum_cols:
        out.append(F.coalesce(F.sum(f"__in_{c}").over(below), F.lit(0)).alias(f"__below_{c}"))
        out.append(F.sum(f"__in_{c}").over(whole).alias(f"total_{c}"))
    out += [F.lag(f"__last_{c}").over(by_cell).alias(f"__last_{c}") for c in carry_cols]
    offsets = per_cell.select(*out)

    in_cell = W.partitionBy(*keys).orderBy(*order)
    upto = in_cell.rowsBetween(W.unboundedPreceding, W.currentRow)
    new: dict[str, Column] = {
        f"cum_{c}": F.sum(c).over(upto) + F.col(f"__below_{c}") for c in sum_cols
    }
    for c in carry_cols:
        new[f"prev_{c}"] = F.coalesce(F.lag(c).over(in_cell), F.col(f"__last_{c}"))
    helpers = [f"__below_{c}" for c in sum_cols] + [f"__last_{c}" for c in carry_cols]
    return join_on_keys(df, offsets, keys).withColumns(new).drop(CELL, *helpers)


def exact_rank(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], rank_col: str = "rank"
) -> DataFrame:
    """Number the rows 1, 2, … per group; ``order_cols`` must order them fully.

    Needs a ``__cell`` column that is monotone in ``order_cols``.
    """
    one = df.withColumn("__one", F.lit(1).cast("bigint"))
    ranked = running_totals(one, group_cols, order_cols, ["__one"])
    return ranked.withColumnsRenamed(
        {"cum___one": rank_col, "total___one": "group_size"}
    ).drop("__one")


def exact_quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: Sequence[float],
    probabilities: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles from value counts, one column per prob.

    Replaces ``percentile`` for groups whose distinct values do not fit one
    task. Columns are named ``q_<i>`` by position in ``probs``. Set
    ``probabilities`` where the values lie in [0, 1].
    """
    groups = list(group_cols)
    counts = (
        df.where(F.col(value_col).isNotNull())
        .groupBy(*groups, value_col)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if probabilities:
        celled = counts.withColumn(CELL, probability_cell(F.col(value_col)))
    else:
        celled = with_value_cells(counts, groups, value_col)
    cum = running_totals(celled, groups, [value_col], ["n"])
    aggs = []
    for i, q in enumerate(probs):
        pos = F.lit(float(q)) * (F.col("total_n") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        aggs.append(F.min(F.when(F.col("cum_n") > low, F.col(value_col))).alias(f"__lo{i}"))
        aggs.append(F.min(F.when(F.col("cum_n") > high, F.col(value_col))).alias(f"__hi{i}"))
        aggs.append(F.max(pos - low).alias(f"__f{i}"))
    out = [
        (
            F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")
        ).alias(f"q_{i}")
        for i in range(len(probs))
    ]
    return cum.groupBy(*groups).agg(*aggs).select(*groups, *out)


def with_id_cells(df: DataFrame, group_cols: Sequence[str], id_col: str) -> tuple[DataFrame, list[str]]:
    """Add cells for an id column; numbers keep their order, text uses its hash.

    Returns the frame and the columns that order it.
    """
    if dict(df.dtypes)[id_col] == "string":
        h = F.xxhash64(id_col)
        return df.withColumn("__h", h).withColumn(CELL, hash_cell(h)), ["__h", id_col]
    return with_value_cells(df, group_cols, id_col), [id_col]


def segment_by_rank(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    id_col: str,
    cuts: DataFrame,
    out_col: str = "segment",
) -> DataFrame:
    """Cut every group at given ranks of (value, id).

    ``cuts`` holds the group columns and ``cuts``, an array of ranks. A row gets
    the number of cuts below its rank. Ranks are found from counts per value;
    only rows that share the value at a cut are ranked one by one, so a date or
    score common to a third of all rows costs no oversized task.
    """
    groups = list(group_cols)
    counts = df.groupBy(*groups, value_col).agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(with_value_cells(counts, groups, value_col), groups, [value_col], ["n"])
    wanted = cuts.select(*groups, F.posexplode("cuts").alias("__no", "__k"))
    inside = (F.col("cum_n") >= F.col("__k")) & (F.col("cum_n") - F.col("n") < F.col("__k"))
    points = (
        join_on_keys(cum, wanted, groups)
        .groupBy(*groups, "__no", "__k")
        .agg(
            F.max(F.when(inside, F.col(value_col))).alias("__v"),
            F.max(F.when(inside, F.col("__k") - (F.col("cum_n") - F.col("n")))).alias("__take"),
        )
    )
    per_group = points.groupBy(*groups).agg(
        F.collect_list(F.struct("__k", "__v", "__take")).alias("__cuts")
    )
    rows = join_on_keys(df, per_group, groups)
    value = F.col(value_col)
    on_cut = F.exists("__cuts", lambda c: c["__v"] == value)
    tied, order = with_id_cells(rows.where(on_cut), [*groups, value_col], id_col)
    ranked = exact_rank(tied, [*groups, value_col], order, "__tie").drop("__h", "group_size")
    free = rows.where(~F.coalesce(on_cut, F.lit(False))).withColumn(
        "__tie", F.lit(None).cast("bigint")
    )
    passed = F.size(
        F.filter(
            "__cuts",
            lambda c: (c["__k"] <= 0)
            | (value > c["__v"])
            | ((value == c["__v"]) & (F.col("__tie") > c["__take"])),
        )
    )
    return free.unionByName(ranked).withColumn(out_col, passed).drop("__cuts", "__tie")
