"""N-gram Jaccard join by signature trees.

Tokens have one order for all documents: by an estimate of how many documents hold
them, then by hash. Two sets that are similar enough share one of their first
tokens, so only first tokens (a fifth of a set) are sent, packed, and only those that
two different sets hold go on. Sets with the same most common shared token form
nodes of bounded size. Pairs of nodes that share first tokens are walked together
as signature trees, first over first tokens, then, for what is left, over whole sets.
Equal sets are one all the way: their digest stands for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_batches, run_spans, run_starts, stored
from riskloom.llm.components import connected_components
from riskloom.llm.signature_tree import SignatureTree, bitmaps, linked_pairs
from riskloom.llm.wordhash import mix, shingle_hashes, word_hashes
from riskloom.session import checkpointed

#: Counters of the estimate of document frequencies; only the plan depends on them.
SKETCH_BITS = 20
SKETCH_PARTS = 64
#: Bits of the filter that keeps texts without candidates from being sent again.
FILTER_BITS = 24
#: Sets in one node of the forest.
NODE_SETS = 256
#: Largest size in a node in percent of the smallest.
SIZE_BAND = 105


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    words, ends, _ = word_hashes(texts, fold_case=True)
    out, start = [], 0
    for end in ends.tolist():
        out.append(np.unique(shingle_hashes(words[start:end], width)))
        start = end
    return out


def digest(tokens: np.ndarray) -> int:
    """64 bits that stand for a set; only equal sets share them but by chance near 2^-64."""
    total = mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total]))[0].astype(np.int64))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of ``n`` must share with any set similar to it."""
    return -(-percent * n // 100)


def least_shared(lo_a, hi_a, lo_b, hi_b, percent: int):
    """First tokens that two similar sets share at least, for sizes within the ranges.

    Sets of sizes x <= y share at least p / (100 + p) (x + y) tokens, and fewer than
    y needs lie behind the first tokens. Over ranges this is least for the smallest
    x and the largest y; for two single sizes the rounding is exact.
    """
    whole = 100 * (100 + percent)
    one = -(-percent * (100 * lo_a - percent * hi_b) // whole)
    two = -(-percent * (100 * lo_b - percent * hi_a) // whole)
    exact = -(-percent * (lo_a + lo_b) // (100 + percent)) - needed(np.maximum(lo_a, lo_b), percent) + 1
    single = (lo_a == hi_a) & (lo_b == hi_b)
    return np.maximum(1, np.where(single, exact, np.minimum(one, two)))


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def row_key(docs: DataFrame) -> Column:
    """Id and 128 bits of the text: rows equal in both are one document."""
    return F.concat_ws(
        ":",
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")),
        F.coalesce(F.md5(docs["text"].cast("string")), F.lit("")),
    )


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (doc_id, row_key, n, digest) and of the frequency sketch (part, counts)."""
    bounded_batches(docs.sparkSession, 128)
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "row_key", "n", "digest", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        id_type = key_type = None
        for batch in batches:
            id_type, key_type = batch.column(0).type, batch.column(1).type
            sets = shingle_sets(_texts(batch.column(2)), width)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            slots = (flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            sketch += np.bincount(slots, minlength=len(sketch)).astype(np.uint32)
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.int64()),
                    pa.nulls(size, pa.int32()),
                    pa.nulls(size, pa.binary()),
                ],
                names,
            )
        if id_type is not None:
            parts = [p.tobytes() for p in np.split(sketch, SKETCH_PARTS)]
            size = len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(size, id_type),
                    pa.nulls(size, key_type),
                    *[pa.nulls(size, pa.int64())] * 2,
                    pa.array(range(size), pa.int32()),
                    pa.array(parts, pa.binary()),
                ],
                names,
            )

    text = docs["text"].cast("string")
    return docs.select("doc_id", row_key(docs).alias("row_key"), text).mapInArrow(
        run,
        f"doc_id {kind.simpleString()}, row_key string, n long, digest long, "
        "part int, counts binary",
    )


def frequency_classes(rows: DataFrame) -> np.ndarray:
    """Base-2 logarithm of the sketch's counters, summed over tasks: 2^SKETCH_BITS bytes."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in group["counts"])
        classes = np.log2(total + 1).astype(np.uint8)
        return pd.DataFrame({"part": group["part"].iloc[:1], "classes": [classes.tobytes()]})

    parts = (
        rows.where("part IS NOT NULL")
        .groupBy("part")
        .applyInPandas(add, "part int, classes binary")
        .collect()
    )
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for row in parts:
        out[row["part"]] = np.frombuffer(row["classes"], np.uint8)
    return out.ravel()


def first_tokens(docs: DataFrame, classes: np.ndarray, width: int, percent: int, buckets: int):
    """(bucket, digest, n, k, token): packed; ``k`` tokens of each set in the bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # 2^SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            names, sizes, kept = [], [], []
            for tokens in shingle_sets(_texts(batch.column(0)), width):
                name = digest(tokens)
                if not len(tokens) or name in known:
                    continue
                known.add(name)
                slot = (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                order = (shared.value[slot].astype(np.uint64) << np.uint64(58)) | (
                    mix(tokens) >> np.uint64(6)
                )
                n = len(tokens)
                first = n - int(needed(np.int64(n), percent)) + 1
                names.append(name)
                sizes.append(n)
                kept.append(np.partition(order, first - 1)[:first])
            if len(known) > 1_000_000:
                known.clear()  # a set sent twice does no harm
            if not names:
                continue
            count = np.array([len(t) for t in kept])
            token = np.concatenate(kept)
            row = np.repeat(np.arange(len(names)), count)
            bucket = (mix(token) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((row, bucket))
            token, row, bucket = token[by], row[by], bucket[by]
            name_of, size_of = np.array(names, np.int64), np.array(sizes, np.uint32)
            for a, b in run_spans(bucket):
                mine, k = np.unique(row[a:b], return_counts=True)
                arrays = (name_of[mine], size_of[mine], k.astype(np.uint32), token[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[a])]),
                        *(pa.array([x.tobytes()], pa.binary()) for x in arrays),
                    ],
                    ["bucket", "digest", "n", "k", "token"],
                )

    return docs.select(docs["text"].cast("string")).mapInArrow(
        run, "bucket long, digest binary, n binary, k binary, token binary"
    )


def _joined(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def shared_tokens(first: DataFrame, buckets: int) -> DataFrame:
    """(bucket, digest, n, token, sets): first tokens that two sets hold, by bucket of the set."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        k = _joined(group["k"], np.uint32)
        name = np.repeat(_joined(group["digest"], np.int64), k)
        n = np.repeat(_joined(group["n"], np.uint32), k)
        token = _joined(group["token"], np.uint64)
        by = np.lexsort((name, token))
        name, n, token = name[by], n[by], token[by]
        once = run_starts(token, name)
        name, n, token = name[once], n[once], token[once]
        starts = run_starts(token)
        length = np.diff(np.append(starts, len(token)))
        sets = np.repeat(length, length)
        keep = sets > 1
        name, n, token, sets = name[keep], n[keep], token[keep], sets[keep].astype(np.uint32)
        to = (mix(name.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        to = to[by]
        rows = [
            (int(to[a]), *(x[by[a:b]].tobytes() for x in (name, n, token, sets)))
            for a, b in run_spans(to)
        ]
        return pd.DataFrame(rows, columns=["bucket", "digest", "n", "token", "sets"])

    return first.groupBy("bucket").applyInPandas(
        run, "bucket long, digest binary, n binary, token binary, sets binary"
    )


def candidate_sets(shared: DataFrame) -> DataFrame:
    """(digest, n, main, tokens): each set's shared first tokens, and the most common of them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name, n = _joined(group["digest"], np.int64), _joined(group["n"], np.uint32)
        token, sets = _joined(group["token"], np.uint64), _joined(group["sets"], np.uint32)
        by = np.lexsort((token, name))
        name, n, token, sets = name[by], n[by], token[by], sets[by]
        rows = []
        for a, b in run_spans(name):
            main = token[a + int(np.argmax(sets[a:b]))]
            rows.append((int(name[a]), int(n[a]), int(main.astype(np.int64)), token[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["digest", "n", "main", "tokens"])

    return shared.groupBy("bucket").applyInPandas(
        run, "digest long, n long, main long, tokens binary"
    )


def forest_nodes(sets: DataFrame) -> DataFrame:
    """Add ``node``: at most NODE_SETS neighbours by most common shared token and of like size.

    Ranges of the order are dealt out, so a token that very many sets share fills
    many nodes in many tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node = (TaskContext.get().partitionId() << 32) - 1
        main, held, smallest = None, 0, 0
        for batch in batches:
            nodes = []
            for m, n in zip(batch["main"].tolist(), batch["n"].tolist(), strict=True):
                if m != main or held == NODE_SETS or 100 * n > SIZE_BAND * smallest:
                    node, main, held, smallest = node + 1, m, 0, n
                held += 1
                nodes.append(node)
            yield batch.assign(node=nodes)

    order = ["main", "n", "digest"]
    return (
        sets.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInPandas(run, "digest long, n long, main long, tokens binary, node long")
    )


def node_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes, a <= b, that may hold similar sets.

    They must share enough first tokens for sizes in their ranges (``least_shared``),
    and one's sizes must be near enough to the other's.
    """
    spread = nodes.select("node", "n", F.explode(_unpacked("tokens")).alias("token"))
    ranges = nodes.groupBy("node").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("sets")
    )
    inside = spread.select("node", "token").distinct().join(ranges, "node")
    left = inside.select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "lo", "hi")])
    right = inside.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "lo", "hi")])
    common = (
        left.join(right, "token")
        .where("node_a < node_b")
        .where(f"100 * hi_a >= {percent} * lo_b AND 100 * hi_b >= {percent} * lo_a")
        .groupBy("node_a", "node_b")
        .agg(
            F.count("*").alias("common"),
            *[F.first(c).alias(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b")],
        )
    )
    whole = 100 * (100 + percent)
    box = F.least(
        F.expr(f"ceil({percent} * (100 * lo_a - {percent} * hi_b) / {whole})"),
        F.expr(f"ceil({percent} * (100 * lo_b - {percent} * hi_a) / {whole})"),
    )
    exact = F.expr(
        f"ceil({percent} * (lo_a + lo_b) / {100 + percent})"
        f" - ceil({percent} * greatest(lo_a, lo_b) / 100) + 1"
    )
    least = F.when(F.expr("lo_a = hi_a AND lo_b = hi_b"), exact).otherwise(box)
    return (
        common.where(F.col("common") >= least)
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .union(ranges.where("sets > 1").select(F.col("node").alias("a"), F.col("node").alias("b")))
    )


def _unpacked(name: str):
    """The longs of a binary column, by their sixteen hexadecimal digits."""
    digits = F.hex(F.col(name))
    return F.transform(
        F.sequence(F.lit(0), (F.length(F.col(name)) / 8).cast("int") - 1),
        lambda i: F.substring(digits, i * 16 + 1, F.lit(16)),
    )


def _walk(group: pa.Table, column: str, feasible) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a pair of nodes that stay feasible down to the leaves."""
    tokens = [np.frombuffer(t, np.uint64) for t in group[column].to_pylist()]
    sizes, node = group["n"].to_numpy(), group["node"].to_numpy()
    bits = bitmaps(tokens)
    least = np.array([t[0] if len(t) else 0 for t in tokens], np.uint64)
    order = np.lexsort((sizes, least))
    ends = sorted({group["a"][0].as_py(), group["b"][0].as_py()})
    rows = [order[node[order] == x] for x in ends]
    if not all(len(r) for r in rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    trees = [SignatureTree.build(bits[r], sizes[r]) for r in rows]
    i, j = linked_pairs(trees[0], trees[-1], feasible)
    return rows[0][i], rows[-1][j]


def hopeful_sets(units: DataFrame, percent: int) -> DataFrame:
    """(a, b, node, digest): sets with a partner in their pair of nodes, by first tokens."""

    def feasible(overlap, lo_a, hi_a, lo_b, hi_b):
        return (
            (overlap >= least_shared(lo_a, hi_a, lo_b, hi_b, percent))
            & (100 * hi_a >= percent * lo_b)
            & (100 * hi_b >= percent * lo_a)
        )

    def run(group: pa.Table) -> pa.Table:
        found = np.unique(np.concatenate(_walk(group, "tokens", feasible)))
        return group.select(["a", "b", "node", "digest"]).take(pa.array(found))

    return (
        units.select("a", "b", "node", "digest", "n", "tokens")
        .groupBy("a", "b")
        .applyInArrow(run, "a long, b long, node long, digest long")
    )


def wanted_filter(digests: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits that are set for all given digests, as packed bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_filter_slot(batch["digest"].to_numpy(np.int64))] = True
        parts = np.packbits(bits).reshape(SKETCH_PARTS, -1)
        some = np.flatnonzero(parts.any(1))
        yield pd.DataFrame({"part": some, "bits": [parts[i].tobytes() for i in some]})

    def both(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in group["bits"]])
        return pd.DataFrame({"part": group["part"].iloc[:1], "bits": [bits.tobytes()]})

    schema = "part long, bits binary"
    parts = digests.select("digest").mapInPandas(run, schema).groupBy("part").applyInPandas(both, schema)
    out = np.zeros((SKETCH_PARTS, (1 << FILTER_BITS) // 8 // SKETCH_PARTS), np.uint8)
    for row in parts.collect():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _filter_slot(name: np.ndarray) -> np.ndarray:
    return (mix(name.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def whole_sets(docs: DataFrame, wanted: np.ndarray, width: int) -> DataFrame:
    """(digest, n, whole): packed sets of the texts whose digest passes the filter, once each."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # 2^FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            rows = []
            for tokens in shingle_sets(_texts(batch.column(0)), width):
                if not len(tokens):
                    continue
                name = digest(tokens)
                slot = int(_filter_slot(np.array([name]))[0])
                if name not in known and shared.value[slot >> 3] >> (7 - (slot & 7)) & 1:
                    known.add(name)
                    rows.append((name, len(tokens), tokens.tobytes()))
            if len(known) > 1_000_000:
                known.clear()
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.binary()]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["digest", "n", "whole"],
                )

    return (
        docs.select(docs["text"].cast("string"))
        .mapInArrow(run, "digest long, n long, whole binary")
        .dropDuplicates(["digest"])
    )


def similar_sets(units: DataFrame, percent: int) -> DataFrame:
    """(a, b): digests of similar sets, enough of them to join all that are similar.

    Each task holds two nodes at most. Of the pairs that it finds it returns a
    spanning forest, so its output is no longer than its input.
    """

    def feasible(overlap, lo_a, hi_a, lo_b, hi_b):
        most = np.minimum(overlap, np.minimum(hi_a, hi_b))
        return (100 + percent) * most >= percent * (lo_a + lo_b)

    def run(group: pa.Table) -> pa.Table:
        name = group["digest"].to_numpy()
        links: list[tuple[int, int]] = []
        root = list(range(len(name)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(*(p.tolist() for p in _walk(group, "whole", feasible)), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[p] = q
                links.append((x, y))
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": name[ends[:, 0]], "b": name[ends[:, 1]]})

    return (
        units.select("a", "b", "node", "digest", "n", "whole")
        .groupBy("a", "b")
        .applyInArrow(run, "a long, b long")
    )


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose shingle sets are linked by Jaccard similarity.

    Returns one row per row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id (smallest doc_id of the group), row_key, digest (of the set),
    stays (of each group the row with the smallest doc_id, then row_key; rows equal
    in both all say so). Words are separated by white space, A-Z count as a-z; a set
    is the distinct runs of ``width`` words, or all words of a shorter text as one.
    Sets link when 100 × intersection >= ``percent`` × union. A null text or one
    without words has an empty set, is linked with nothing and stays. Null ids belong
    to groups but name none. Repeated rows give repeated rows; other columns are
    ignored; an empty table gives an empty result. No link is lost: the frequency
    sketch and the filter only steer the plan. Sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(document_sets(docs, width))
    documents = rows.where("part IS NULL").select("doc_id", "row_key", "n", "digest")

    classes = frequency_classes(rows)
    first = first_tokens(docs, classes, width, percent, buckets)
    sets = candidate_sets(shared_tokens(first, buckets))
    nodes = checkpointed(forest_nodes(sets))
    pairs = checkpointed(node_pairs(nodes, percent))
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    hopeful = checkpointed(hopeful_sets(ends.join(nodes, "node"), percent))
    whole = whole_sets(docs, wanted_filter(hopeful), width)
    links = similar_sets(hopeful.join(whole, "digest"), percent)
    labels = connected_components(links).withColumnRenamed("node", "digest")

    grouped = documents.join(labels, "digest", "left").withColumn(
        "label", F.coalesce("label", "digest")
    )
    row = F.struct("doc_id", "row_key")
    groups = (
        grouped.where("label IS NOT NULL")
        .groupBy("label")
        .agg(
            F.min("doc_id").alias("component_id"),
            F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), row)), F.min(row)).alias("kept"),
        )
    )
    return grouped.join(groups, "label", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "row_key",
        "digest",
        (F.col("label").isNull() | row.eqNullSafe(F.col("kept"))).alias("stays"),
    )
