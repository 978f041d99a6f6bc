"""Connected components of an edge table, by rounds of joins and minimums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the star contraction on edges (a, b).

    ``large``: every neighbour above a node is tied to the smallest neighbour (or
    the node itself); else every neighbour below it is. The minimum is combined
    before the shuffle, and the join splits a hub that has very many edges.
    """
    if large:
        ties = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ties = edges.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
    low = ties.groupBy("a").agg(F.min("b").alias("low")).withColumn(
        "low", F.least("a", "low")
    )
    joined = ties.join(low, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select("b", F.col("low").alias("m"))
    else:
        out = joined.select("b", F.col("low").alias("m")).union(
            low.select(F.col("a").alias("b"), F.col("low").alias("m"))
        )
    return (
        out.where(F.col("b") != F.col("m"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label: the smallest node reachable.

    Nodes may be numbers or strings. Null ends, loops and repeated edges have no
    effect; an empty table gives an empty result. Each round is cut with a
    checkpoint, and the rounds stop when the edges no longer change: then every
    edge ties a node to its label.
    """
    edges = checkpointed(
        edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()
    )
    last = None
    while True:
        mark = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == last or not mark[0]:
            break
        last = mark
        edges = checkpointed(_star(_star(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select("b", "b").distinct()
    )
