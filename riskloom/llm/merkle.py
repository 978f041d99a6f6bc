"""A Merkle manifest of a dataset: checkpoint and recompute.

Rows are leaves, groups have trees of eight-fold runs, and the groups' roots have a
tree of their own. Of every tree only each third level is written: a block of 512
consecutive nodes is one row, and its aligned subtree is hashed inside that row. A
proof regenerates the two levels between from the stored block, emits the siblings
of each node and keeps none of the regenerated hashes. Everything is DataFrame
functions; the driver sees the largest group's size and the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, stored

#: Nodes of a run, levels between stored ones, and so the nodes of a block.
FAN, STEP = 8, 3
BLOCK = FAN**STEP
#: Counts per range are broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else number of UTF-8 bytes, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _key(group: Column) -> Column:
    """Text that is never null and sorts like the group, null first, by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos``: the place from 0 of each row in its group, in the given order.

    Rows are dealt into ranges and written; a range's rows of a group are counted and
    the counts added up, so no group needs one task.
    """
    dealt = stored(
        df.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("mark", F.monotonically_increasing_id())
    )
    part = F.shiftright("mark", 33)
    counts = dealt.groupBy(group, part.alias("part")).agg(
        F.count("*").alias("n"), F.min("mark").alias("lowest")
    )
    before = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = stored(
        counts.select(group, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lowest")).alias("shift"))
    )
    # A row for each range and each group: few, unless there are very many groups.
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    placed = dealt.withColumn("part", part).join(counts, [group, "part"])
    return placed.withColumn("pos", F.col("mark") + F.col("shift")).drop("mark", "part", "shift")


def _runs(nodes: Column) -> Column:
    """The level above: one hash per run of FAN nodes."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN))
    return F.transform(starts, lambda s: digest(F.array_join(F.slice(nodes, s, FAN), "")))


def _siblings(nodes: Column, i: Column) -> Column:
    """(left, right): the hashes before and behind node ``i`` (from 0) in its run."""
    place = F.pmod(i, F.lit(FAN)).cast("int")
    return F.struct(
        F.array_join(F.slice(nodes, (i - place + 1).cast("int"), place), "").alias("left"),
        F.array_join(F.slice(nodes, (i + 2).cast("int"), F.lit(FAN - 1) - place), "").alias("right"),
    )


def _blocks(nodes: DataFrame) -> DataFrame:
    """Stored level: (grp, block, heights, nodes) from (grp, pos, heights, node).

    ``node`` is a struct that starts with ``hash``; ``heights`` is how many levels the
    group's tree has above this one.
    """
    return stored(
        nodes.groupBy("grp", "heights", F.expr(f"pos div {BLOCK}").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("nodes"))
        .select("grp", "block", "heights", F.transform("nodes", lambda x: x["node"]).alias("nodes"))
    )


def _subtrees(blocks: DataFrame) -> DataFrame:
    """Regenerate the levels inside each block: l0, l1, l2 and top, as far as there are levels."""
    out = blocks.withColumn("l0", F.transform("nodes", lambda x: x["hash"]))
    for k in range(1, STEP + 1):
        below = F.col(f"l{k - 1}")
        out = out.withColumn(f"l{k}", F.when(F.col("heights") >= k, _runs(below)).otherwise(below))
    return out


def tree_levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels from the bottom, and (grp, root), of groups of at most ``most`` nodes.

    ``nodes``: grp, pos, heights, node.
    """
    levels, current = [], nodes
    while True:
        blocks = _blocks(current)
        levels.append(blocks)
        tops = _subtrees(blocks).select(
            "grp", F.col("block").alias("pos"), F.greatest(F.col("heights") - STEP, F.lit(0)).alias("heights"),
            F.struct(F.col(f"l{STEP}")[0].alias("hash")).alias("node"),
        )
        most = -(-most // BLOCK)
        if most <= 1:
            return levels, tops.select("grp", F.col("node.hash").alias("root"))
        current = tops


def heights_of(n: Column) -> Column:
    """Levels until one of ``n`` nodes remains; exact, as powers of FAN are compared as they are."""
    power = F.lit(0)
    for k in range(20):
        power = power + (n > F.lit(FAN**k)).cast("int")
    return power


def tree_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(grp, node, path, tail…) of every bottom node; ``path``: siblings from its level upwards.

    ``above`` (grp, path, tail) has what follows a group's root: the path there and a
    struct that is carried along. From the top, each stored level's blocks meet their
    own node's path and hand paths to their nodes.
    """
    handed = above.withColumn("block", F.lit(0).cast("long"))
    for depth, blocks in enumerate(reversed(levels)):
        found = _subtrees(blocks).join(handed, ["grp", "block"])
        position = F.sequence(F.lit(0), F.size("nodes") - 1)

        def entry(i: Column) -> Column:
            own = [
                F.when(F.col("heights") > k, _siblings(F.col(f"l{k}"), F.floor(i / FAN**k).cast("int")))
                for k in range(STEP)
            ]
            return F.struct(
                F.get(F.col("nodes"), i).alias("node"),
                (F.col("block") * BLOCK + i).alias("pos"),
                F.concat(F.filter(F.array(*own), lambda s: s.isNotNull()), F.col("path")).alias("path"),
            )

        each = found.select("grp", "tail", F.explode(F.transform(position, entry)).alias("e"))
        if depth < len(levels) - 1:
            handed = each.select("grp", F.col("e.pos").alias("block"), F.col("e.path").alias("path"), "tail")
    return each.select("grp", "e.node", "e.path", "tail")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(path, leaf, lambda at, s: digest(s["left"], at, s["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its leaf, its group's and the whole root, and its proof.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. A leaf
    hashes doc_id, source, lang, n_chars and text, each with its length, null as ``-``
    (so null and empty differ). Groups are the values of ``lang``; leaves ascend by
    doc_id, null first, and those of one doc_id by their hash, so equal rows may trade
    places and nothing else can. Where crc32 of the decimal doc_id is divisible by 3 the
    row is taken as changed: A-Z of its text in lower case; a null id is not, and a null
    text stays. Very long texts are hashed where they are read and never shuffled. Other
    columns are ignored; an empty table gives an empty result.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    head = F.concat(*map(field, columns))
    text = F.col("text").cast("string")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = digest(head, field(text))
    leaves = docs.select(
        _key(F.col("lang")).alias("grp"),
        "doc_id",
        leaf.alias("hash"),
        F.when(chosen, digest(head, field(ascii_lower(text)))).alias("changed"),
    )
    placed = numbered(leaves, "grp", ["doc_id", "hash"])
    sizes = stored(placed.groupBy("grp").agg(F.count("*").alias("n"), heights_of(F.count("*")).alias("heights")))
    groups, most = sizes.agg(F.count("*"), F.max("n")).first()
    if not groups:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [],
            f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
            "folded_root string, verified boolean",
        )
    by_group = sizes.select("grp", "heights")
    if groups <= BROADCAST_ROWS:
        by_group = F.broadcast(by_group)
    node = F.struct("hash", "doc_id", "changed").alias("node")
    levels, subroots = tree_levels(placed.join(by_group, "grp").select("grp", "pos", "heights", node), most)

    # The tree of the groups' roots is one more group; its nodes carry their own name.
    top = numbered(subroots.select(F.lit("").alias("all"), "grp", F.col("root").alias("hash")), "all", ["grp"])
    top_nodes = top.select(
        F.col("all").alias("grp"), "pos", heights_of(F.lit(groups)).alias("heights"), F.struct("hash", "grp").alias("node")
    )
    top_levels, whole = tree_levels(top_nodes, groups)
    root = whole.first()["root"]
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = docs.sparkSession.range(1).select(F.lit("").alias("grp"), none.alias("path"), F.lit(0).alias("tail"))
    above = tree_paths(top_levels, start).select(
        F.col("node.grp").alias("grp"), "path", F.col("node.hash").alias("tail")
    )
    proofs = tree_paths(levels, above).select("node", "path", F.col("tail").alias("subroot"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = proofs.select(
        "node.doc_id",
        F.col("node.hash").alias("leaf"),
        "subroot",
        F.lit(root).alias("root"),
        digest(siblings).alias("proof_sha256"),
        fold(F.coalesce("node.changed", "node.hash"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
