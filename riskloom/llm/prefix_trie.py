"""Conversation prefix trie: shared beginnings of conversations.

A turn becomes a fixed-width big-endian id and a conversation the string of its
turns' ids. Equal strings are counted first. The distinct strings are dealt out in
ranges of byte order, and every task builds adaptive radix trees over its range, a
bounded chunk of strings each. A tree has nodes where bytes part; only its depths that
are whole turns are nodes of the trie, however many of them a compressed path holds.

A subtree that lies inside a chunk is final there. Only prefixes of a chunk's first
and last string may go on in a neighbouring chunk: these few come out as partial
sums, and one pass over them in byte order with a stack adds them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_batches, stored, word_count
from riskloom.llm.radix_tree import RadixTree

#: Bytes of a turn's id.
WIDTH = 16
#: Strings and bytes of one radix tree.
CHUNK_KEYS, CHUNK_BYTES = 32_768, 32 << 20
#: About so many conversation ids are joined where they are sorted, before a digest is taken.
ID_BLOCK = 4_096
#: Nodes on chunk borders are broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
_PARTIAL = f"{_NODE}, parent binary, node binary, chunk long, n_words long"


def turn_id(role: Column, text: Column) -> Column:
    """First 16 bytes of the SHA-256 of role and text, in hex."""
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(both.cast("binary"), 256), 1, 2 * WIDTH)


def branched(turns: DataFrame, group: int = 20, spread: int = 4) -> DataFrame:
    """(conv_id, turns) with the beginnings replaced: the rebuilt conversations.

    Conversation c takes the first h turns of conversation c - c % ``group`` in place of
    its own first h, h = crc32(decimal c) % ``spread``; remainders are never negative.
    ``turns`` has conv_id, at (its place as sorted) and turn (any struct).
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    # One exchange serves both the conversations and the group they borrow from.
    own = (
        turns.withColumn("base", base)
        .repartition("base")
        .groupBy("base", "conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "turn"))).alias("turns"))
        .withColumn("turns", F.transform("turns", lambda x: x["turn"]))
    )
    head = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, spread - 1))
    lent = F.max(head).over(W.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("int")
    none = F.slice("turns", 1, 0)
    taken = F.when(F.col("lent").isNull(), none).otherwise(F.slice("lent", 1, h))
    rest = F.slice("turns", h + 1, F.size("turns"))
    return own.withColumn("lent", lent).select("conv_id", F.concat(taken, rest).alias("turns"))


def _id_digests(ends: DataFrame) -> DataFrame:
    """(seq, n, conv_id, ids_sha256): members of each sequence counted, their smallest, and the digest.

    SHA-256 reads its input in one order, so a sequence's digest is one task's; ids are
    sorted and joined in ranges before, and that task reads a row per ID_BLOCK ids.
    """

    def block(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        text = rows.assign(text=rows["conv_id"].astype(str)).groupby("seq", sort=False)
        return text.agg(n=("text", "size"), conv_id=("conv_id", "first"), ids=("text", ",".join)).reset_index()

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ID_BLOCK:
                yield block(held)
                held = []
        if held:
            yield block(held)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, state, n, first = None, None, 0, 0

        def row():
            return (seq, n, first, state.hexdigest())

        for batch in batches:
            done = []
            for s, k, conv, ids in batch[["seq", "n", "conv_id", "ids"]].itertuples(index=False):
                if s != seq:
                    if seq is not None:
                        done.append(row())
                    seq, state, n, first = s, hashlib.sha256(), 0, conv
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
                n += k
            yield pd.DataFrame(done, columns=["seq", "n", "conv_id", "ids_sha256"])
        if seq is not None:
            yield pd.DataFrame([row()], columns=["seq", "n", "conv_id", "ids_sha256"])

    blocks = (
        ends.repartitionByRange("seq", "conv_id")
        .sortWithinPartitions("seq", "conv_id")
        .mapInPandas(joined, "seq binary, n long, conv_id long, ids string")
    )
    return (
        blocks.repartition("seq")
        .sortWithinPartitions("seq", "conv_id")
        .mapInPandas(hashed, "seq binary, n long, conv_id long, ids_sha256 string")
    )


def _chain(key: bytes) -> list[bytes]:
    """Ids of all prefixes of a string of turn ids, the empty one first."""
    out = [bytes(WIDTH)]
    for at in range(0, len(key), WIDTH):
        out.append(hashlib.blake2b(out[-1] + key[at : at + WIDTH], digest_size=WIDTH).digest())
    return out


@dataclass
class _TrieNode:
    """``on``: whether the first and the last string of the chunk begin with the node."""

    depth: int
    parent: int
    words: int
    on: list[bool]
    n: int = 0
    conv: int | None = None
    sha: str | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0


def chunk_nodes(rows: list[tuple[bytes, int, int, str, list[int]]], chunk: int) -> list[tuple]:
    """Rows of _PARTIAL for one chunk: sorted (key, members, smallest, ends digest, words of each turn)."""
    tree = RadixTree()
    words: dict[bytes, int] = {}
    for key, n, conv, sha, sizes in rows:
        tree.insert(key, (n, conv, sha))
        for i, size in enumerate(sizes):
            words[key[i * WIDTH : (i + 1) * WIDTH]] = size
    borders = (rows[0][0], rows[-1][0])
    chains = [_chain(key) for key in borders]

    nodes: list[_TrieNode] = []  # parents before children
    path: list[int] = []
    key = bytearray()
    for branch, start, end, own in tree.walk():
        del key[start:]
        key += own
        del path[start // WIDTH + 1 :]
        for depth in range(start // WIDTH + 1 if nodes else 0, end // WIDTH + 1):
            at = slice((depth - 1) * WIDTH, depth * WIDTH) if depth else slice(0, 0)
            turn = bytes(key[at])
            up = nodes[path[-1]] if path else None
            on = [
                depth * WIDTH <= len(whole) and (up is None or up.on[k]) and whole[at] == turn
                for k, whole in enumerate(borders)
            ]
            nodes.append(_TrieNode(depth, path[-1] if path else -1, words.get(turn, 0), on))
            path.append(len(nodes) - 1)
        if branch.value is not None:
            at = nodes[path[-1]]
            at.n, at.conv, at.sha = branch.value
    for node in reversed(nodes):
        if not any(node.on):
            node.leaves += not node.children
            node.saved += (node.n - 1) * node.words
        if node.parent >= 0:
            above = nodes[node.parent]
            above.n += node.n
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
            if not any(node.on):
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved
    out = []
    for node in nodes:
        up = nodes[node.parent] if node.parent >= 0 else None
        shared = up is not None and any(up.on)
        above = chains[not up.on[0]][node.depth - 1] if shared else None
        known = up.conv if up is not None and not shared else None
        sums = (node.n, node.children, node.leaves, node.saved)
        if any(node.on):
            side = int(not node.on[0])
            own = chains[side][node.depth]
            out.append((node.conv, node.depth, None, *sums, node.sha, above, own, 2 * chunk + side, node.words))
        else:
            out.append((node.conv, node.depth, known, *sums, node.sha or EMPTY_SHA, above, None, None, node.words))
    return out


def _tries(keys: DataFrame) -> DataFrame:
    """Rows of _PARTIAL from distinct (key, n, conv_id, ids_sha256, words)."""
    bounded_batches(keys.sparkSession, 4_096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in _PARTIAL.split(", ")])
        chunk = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def grown() -> pa.RecordBatch:
            columns = zip(*chunk_nodes(held, chunk), strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) >= CHUNK_KEYS or size + len(row[0]) > CHUNK_BYTES):
                    yield grown()
                    held, size, chunk = [], 0, chunk + 1
                held.append(row)
                size += len(row[0])
        if held:
            yield grown()

    return (
        keys.select("key", "n", "conv_id", "ids_sha256", "words")
        .repartitionByRange("key")
        .sortWithinPartitions("key")
        .mapInArrow(run, _PARTIAL)
    )


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _border_nodes(partials: DataFrame) -> DataFrame:
    """(node, …columns of the result) of the nodes on chunk borders, added up.

    Their rows, twice a chunk's depth at most, pass one task in byte order; it holds one
    path. A prefix's rows of several chunks meet while it is on that path.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list] = []
        done: list[tuple] = []

        def pop() -> None:
            node, conv, depth, n, children, leaves, saved, size, sha = stack.pop()
            leaves += not children
            saved += (n - 1) * size
            up = stack[-1] if stack else None
            if up:
                up[4] += 1
                up[5] += leaves
                up[6] += saved
            done.append((node, up[0] if up else None, conv, depth, n, children, leaves, saved, sha or EMPTY_SHA))

        def taken() -> pd.DataFrame:
            out = pd.DataFrame(done, columns=[f.split()[0] for f in _BORDER.split(", ")])
            done.clear()
            return out

        for batch in batches:
            for r in batch.itertuples(index=False):
                depth = int(r.depth)
                if depth < len(stack) and stack[depth][0] == r.node:
                    at = stack[depth]
                    at[1] = min(at[1], int(r.conv_id))
                    at[3] += int(r.n_convs)
                    at[4] += int(r.n_children)
                    at[5] += int(r.n_leaves)
                    at[6] += int(r.saved_tokens)
                    at[8] = at[8] or r.ends_sha256
                    continue
                while len(stack) > depth:
                    pop()
                stack.append(
                    [r.node, int(r.conv_id), depth, int(r.n_convs), int(r.n_children), int(r.n_leaves),
                     int(r.saved_tokens), int(r.n_words), r.ends_sha256]
                )
            yield taken()
        while stack:
            pop()
        yield taken()

    ordered = partials.where(F.col("node").isNotNull()).repartition(1).sortWithinPartitions("chunk", "depth")
    return ordered.mapInPandas(run, _BORDER)


_BORDER = (
    "node binary, parent binary, conv_id long, depth long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)


def prefix_trie(conversations: DataFrame, group: int = 20, spread: int = 4) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations (see ``branched``).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Null role or text is empty; turns ascend, null
    first, equal ones by the id of role and text, and a repeated row is a turn of its own;
    rows without conv_id take no part; other columns are ignored; an empty table has no
    node, not even a root. Texts are hashed and counted where they are read, whole
    however long, and never shuffled; a conversation's ids (20 bytes a turn) meet in one
    row. Turns are told apart by 128-bit hashes.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("at"),
        F.struct(turn_id(role, text).alias("id"), word_count(text).alias("words")).alias("turn"),
    )
    rebuilt = branched(turns, group, spread).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )
    rebuilt = stored(rebuilt.withColumn("seq", F.substring(F.unhex(F.sha2("key", 256)), 1, WIDTH)))
    texts = rebuilt.groupBy("seq").agg(F.first("key").alias("key"), F.first("words").alias("words"))
    keys = _id_digests(rebuilt.select("seq", "conv_id")).join(texts, "seq")
    partials = stored(_tries(keys))
    border = stored(_border_nodes(partials))
    names = [f.split()[0] for f in _NODE.split(", ")]
    inner = partials.where(F.col("node").isNull())
    settled = inner.where(F.col("parent").isNull()).select(*names)
    parents = border.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    # Twice the depth of each chunk: small, and one of them may be the parent of many nodes.
    if parents.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        parents = F.broadcast(parents)
    columns = [F.col("above").alias(c) if c == "parent_conv_id" else F.col(c) for c in names]
    below = inner.where(F.col("parent").isNotNull()).join(parents, "parent").select(*columns)
    own = border.join(parents, "parent", "left").select(*columns)
    return settled.unionByName(below).unionByName(own)
