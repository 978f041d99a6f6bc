"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. The words of a source are summed by hash bucket; the
bucket in which the running sum crosses the budget is refined, and only that one,
until the threshold is known. The filter is then ``hash < threshold``: no row is
sorted, and the choice for a smaller budget lies inside that for a larger one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.common import word_count
from riskloom.session import checkpointed

HASH_BITS = 60
LEVEL_BITS = 12
LEVELS = 3


#: A plan of at most so many rows (about 100 bytes each) is broadcast.
BROADCAST_SOURCES = 100_000


def document_hash(doc_id: Column, text: Column | None = None) -> Column:
    """60 bits of the MD5 of the id as text; without an id, of the document's text."""
    instead = F.lit("") if text is None else F.coalesce(text.cast("string"), F.lit(""))
    digest = F.md5(F.coalesce(doc_id.cast("string"), instead))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sized: DataFrame, weights: Sequence[float], cap: float, share: float
) -> DataFrame:
    """One row per source: source, source_size, target, copies, rest.

    Weights repeat over the sources in code-point order, null last. Targets are
    shares of ``share`` times all words by weight, held at ``cap`` times the
    source's words; what is over goes to the others by weight. Sources with the
    smallest cap per weight reach their cap first, so running sums in that order
    give the level at which the rest is filled. One row per source goes through
    the windows, never documents.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    repeated = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(order) - 1
    table = by_source.withColumn(
        "weight", F.element_at(repeated, (rank % len(weights) + 1).cast("int"))
    ).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    filled = W.orderBy(
        F.col("full") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(
        F.sum("full").over(filled), F.lit(0.0)
    )
    weight_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(filled), F.lit(0.0)
    )
    return (
        table.withColumn("open", left / weight_left)
        # Filling a source below its share raises the level for the others, and
        # filling any other lowers it: the highest level is the right one.
        .withColumn("level", F.max("open").over(everything))
        .withColumn("target", F.least("full", F.col("level") * F.col("weight")))
        .withColumn(
            "copies",
            F.when(
                F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
            ).otherwise(0),
        )
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .select("source", "source_size", "target", "copies", "rest")
    )


def _crossing(sums: DataFrame, key: str) -> DataFrame:
    """The row of each source in which the running sum of ``size`` passes ``rest``.

    ``sums`` has one row per source and bucket: at most 2^LEVEL_BITS per source.
    """
    upto = (
        W.partitionBy("source")
        .orderBy(key)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        sums.withColumn("upto", F.sum("size").over(upto))
        .withColumn("before", F.col("upto") - F.col("size"))
        .where((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
        .select(
            "source", key, (F.col("rest") - F.col("before")).alias("rest"), "size"
        )
    )


def _sent(per_source: DataFrame, few: bool) -> DataFrame:
    """A row per source goes to every task if the sources were counted and are few."""
    return F.broadcast(per_source) if few else per_source


def hash_thresholds(hashed: DataFrame, targets: DataFrame, few: bool = False) -> DataFrame:
    """(source, threshold): documents with a smaller hash fill ``rest`` most nearly."""
    edge = targets.where("rest > 0").select(
        "source", F.lit(0).cast("long").alias("prefix"), "rest"
    )
    shift = HASH_BITS
    inside = hashed
    for _ in range(LEVELS):
        used, shift = shift, shift - LEVEL_BITS
        mine = hashed.alias("h").join(
            _sent(edge, few).alias("e"),
            F.col("h.source").eqNullSafe(F.col("e.source"))
            & (F.shiftright("h.hash", used) == F.col("e.prefix")),
        )
        inside = mine.select("h.source", "hash", "h.size", "e.rest")
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("prefix")).agg(
            F.sum("size").alias("size"), F.first("rest").alias("rest")
        )
        edge = checkpointed(_crossing(sums, "prefix").drop("size"))
    last = hashed.alias("h").join(
        _sent(edge, few).alias("e"),
        F.col("h.source").eqNullSafe(F.col("e.source"))
        & (F.shiftright("h.hash", shift) == F.col("e.prefix")),
    )
    # Rows of one hash are repeats of one id: one sum each.
    sums = last.groupBy("h.source", "hash").agg(
        F.sum("h.size").alias("size"), F.first("e.rest").alias("rest")
    )
    over = F.col("size") - F.col("rest")
    return _crossing(sums, "hash").select(
        "source",
        (F.col("hash") + F.when(over < F.col("rest"), 1).otherwise(0)).alias("threshold"),
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        document_hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )


def mix_plan(
    hashed: DataFrame, weights: Sequence[float], cap: float, share: float
) -> DataFrame:
    """One row per source: source, source_size, target, copies, threshold.

    Up to BROADCAST_SOURCES sources it is marked to be broadcast: documents then stay
    where they lie, and no task gets all those of one source.
    """
    targets = checkpointed(source_targets(hashed, weights, cap, share))
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    cuts = hash_thresholds(hashed, targets, few)
    same = F.col("t.source").eqNullSafe(F.col("c.source"))
    plan = targets.alias("t").join(cuts.alias("c"), same, "left").select(
        "t.source", "source_size", "target", "copies", "threshold"
    )
    return _sent(checkpointed(plan), few)


def copies_taken(hash_: Column) -> Column:
    """Copies of a document, beside its source's row of the plan."""
    return (F.col("copies") + F.when(hash_ < F.col("threshold"), 1).otherwise(0)).cast("int")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3,
    share: float = 1.0,
) -> DataFrame:
    """How often each document is taken so that sources come to their targets.

    Returns one row per row of ``docs`` (doc_id, source, text): doc_id, source,
    size (words; null text: 0), source_size, target, copies, taken = copies × size.
    A whole document is taken 0 to ``cap`` times; a source misses its target by
    half of one document at most (repeats of one id count as one). Sources are
    compared by code point, null is a source of its own and comes last. Documents
    without an id are told apart by their text. Ties of the half go to the smaller set. An empty
    table gives an empty result; other columns are ignored. The choice depends on
    ids (or texts, where there is none), so reruns and lost executors give the same rows.
    """
    hashed = checkpointed(sized_documents(docs))
    plan = mix_plan(hashed, weights, cap, share)
    same = F.col("h.source").eqNullSafe(F.col("p.source"))
    return (
        hashed.alias("h")
        .join(plan.alias("p"), same)
        .withColumn("taken_copies", copies_taken(F.col("hash")))
        .select(
            "h.doc_id",
            "h.source",
            "h.size",
            "p.source_size",
            "p.target",
            F.col("taken_copies").alias("copies"),
            (F.col("taken_copies") * F.col("h.size")).cast("long").alias("taken"),
        )
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3,
    share: float = 1.0,
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it, with all columns.

    The plan has one row per source and meets the texts where they lie.
    """
    plan = mix_plan(checkpointed(sized_documents(docs)), weights, cap, share)
    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    taken = copies_taken(document_hash(F.col("d.doc_id"), F.col("d.text")))
    again = F.when(taken > 0, F.sequence(F.lit(1), taken)).otherwise(F.array().cast("array<int>"))
    return docs.alias("d").join(plan.alias("p"), same).select("d.*", F.explode(again).alias("__copy")).drop("__copy")
