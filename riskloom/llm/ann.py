"""Approximate nearest neighbours by balanced posting lists.

Vectors are clustered into many small lists around centroids. A vector near a
border is kept in several lists. The centroids and a graph of their neighbours are
small and sit in every task's memory: a best-first walk through the graph finds the
centroids near a vector. A query reads the lists whose centroid is at most a ratio
farther than the nearest one, and scores their vectors exactly.

Largest inner product becomes smallest distance by one more coordinate that brings
all vectors to the same length; queries have 0 there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.session import checkpointed, ship_package

#: Centroids are fitted on at most so many vectors; every vector is indexed.
SAMPLE = 65_536
#: Wanted vectors per list, and about the most centroids, which every task holds with
#: their graph (8 MB at 64 numbers): beyond a million vectors, lists grow longer.
LIST_SIZE = 128
MAX_LISTS = 8_192
#: Nearest centroids that a centroid links to, and links back to those it names.
DEGREE, BACK = 32, 8
#: Centroids that a walk opens in one step.
OPENED = 8
#: A query reads this share of the lists, whatever their number.
SHARE = 0.15
#: A list or its queries beyond this size is dealt to several tasks.
BLOCK = 4_096


@dataclass(frozen=True)
class Index:
    """Centroids in the lifted space, their neighbour graph, and entry points of walks."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    dimension: int
    longest: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (x * x).sum(1), 0.0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], 1)

    def lift_queries(self, q: np.ndarray) -> np.ndarray:
        length = np.sqrt((q * q).sum(1, keepdims=True))
        return np.concatenate([q / length * self.longest, np.zeros((len(q), 1))], 1)

    def near(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` centroids nearest to each point and their squared distances.

        All points walk the graph at once: each step opens every point's OPENED nearest
        unopened centroids and merges their neighbours, until no point has an unopened one
        among its best. Only where all centroids are wanted there is nothing to walk for.
        """
        width = min(width, len(self.centroids))
        norms = (self.centroids**2).sum(1)
        square = (points**2).sum(1)
        if width == len(self.centroids):
            gap = np.maximum(square[:, None] - 2 * points @ self.centroids.T + norms, 0.0)
            best = np.argsort(gap, axis=1, kind="stable")
            return best, np.take_along_axis(gap, best, 1)
        everyone = np.arange(len(points))
        best = np.full((len(points), width), -1)
        dist = np.full((len(points), width), np.inf)
        opened = np.ones((len(points), width), bool)
        met = np.zeros((len(points), len(self.centroids)), bool)

        def merge(rows: np.ndarray, ids: np.ndarray) -> None:
            ids = np.sort(ids, axis=1)
            new = ~met[rows[:, None], ids]
            new[:, 1:] &= ids[:, 1:] != ids[:, :-1]
            met[rows[:, None], ids] = True
            # Distances of new neighbours only; the others cannot come in again.
            d = np.full(ids.shape, np.inf)
            row, place = np.nonzero(new)
            to = ids[row, place]
            dots = np.einsum("nd,nd->n", points[rows[row]], self.centroids[to])
            d[row, place] = np.maximum(square[rows[row]] - 2 * dots + norms[to], 0.0)
            all_ids = np.concatenate([best[rows], ids], 1)
            all_d = np.concatenate([dist[rows], d], 1)
            all_open = np.concatenate([opened[rows], ~new], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            best[rows] = np.take_along_axis(all_ids, order, 1)
            dist[rows] = np.take_along_axis(all_d, order, 1)
            opened[rows] = np.take_along_axis(all_open, order, 1)

        merge(everyone, np.broadcast_to(self.entries, (len(points), len(self.entries))))
        rows = everyone
        while len(rows := rows[~opened[rows].all(1)]):
            # Opened ones sort last; a row with fewer unopened than OPENED opens some again.
            at = np.argsort(opened[rows], axis=1, kind="stable")[:, :OPENED]
            opened[rows[:, None], at] = True
            known = best[rows[:, None], at]
            ids = self.graph[np.where(known < 0, known[:, :1], known)]
            merge(rows, ids.reshape(len(rows), -1))
        best[~np.isfinite(dist)] = -1
        return best, dist


def _split(points: np.ndarray, rng: np.random.Generator, parts: int) -> np.ndarray:
    """Labels of a short k-means with ``parts`` centres."""
    centres = points[rng.choice(len(points), parts, replace=False)]
    label = np.zeros(len(points), np.int64)
    for _ in range(8):
        gap = (centres**2).sum(1)[None, :] - 2 * points @ centres.T
        label = np.argmin(gap, axis=1)
        for k in range(parts):
            if (mine := label == k).any():
                centres[k] = points[mine].mean(0)
    return label


def _with_links_back(graph: np.ndarray) -> np.ndarray:
    """Add up to BACK links to each row, from centroids that it is near to but does not name.

    Centroids that few others name come first: no walk would reach them. Free places
    hold the row itself.
    """
    n, degree = graph.shape
    wide = np.concatenate([graph, np.repeat(np.arange(n)[:, None], BACK, 1)], 1)
    named = [set(row) for row in graph.tolist()]
    used = np.zeros(n, np.int64)
    for v in np.argsort(np.bincount(graph.ravel(), minlength=n), kind="stable").tolist():
        for u in graph[v].tolist():
            if used[u] < BACK and v not in named[u]:
                wide[u, degree + used[u]] = v
                used[u] += 1
    return wide


def fit_index(sample: np.ndarray, rows: int, longest: float, seed: int = 5) -> Index:
    """Split the sample again and again until every list would hold LIST_SIZE of ``rows``.

    Splitting the largest parts further keeps the lists balanced where data are dense.
    """
    rng = np.random.default_rng(seed)
    lifted = np.concatenate(
        [sample, np.sqrt(np.maximum(longest**2 - (sample**2).sum(1), 0.0))[:, None]], 1
    )
    lists = int(np.clip(rows // LIST_SIZE, 1, min(MAX_LISTS, len(sample))))
    share = max(1, -(-len(sample) // lists))
    todo, done = [np.arange(len(sample))], []
    while todo:
        part = todo.pop()
        if len(part) <= share:
            done.append(part)
            continue
        parts = int(np.clip(-(-len(part) // share), 2, 16))
        label = _split(lifted[part], rng, parts)
        pieces = [part[label == k] for k in range(parts)]
        pieces = [p for p in pieces if len(p)]
        # Equal vectors cannot be told apart: they stay one list.
        (done if len(pieces) == 1 else todo).extend(pieces)
    centroids = np.array([lifted[p].mean(0) for p in done])
    degree = min(DEGREE, len(centroids))
    graph = np.empty((len(centroids), degree), np.int64)
    norms = (centroids**2).sum(1)
    for i in range(0, len(centroids), 1024):
        gap = norms[None, :] - 2 * centroids[i : i + 1024] @ centroids.T
        graph[i : i + 1024] = np.argsort(gap, axis=1, kind="stable")[:, :degree]
    graph = _with_links_back(graph)
    entries = rng.permutation(len(centroids))[: min(64, len(centroids))]
    return Index(centroids, graph, entries, sample.shape[1], longest)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) without null ids and null, zero or unfinished vectors."""
    v = F.col("embedding")
    return (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull())
        .where(
            ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists(v, lambda x: x != 0)
        )
    )


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dimension).all():
        return flat.reshape(len(sizes), dimension)
    out = np.zeros((len(sizes), dimension))
    out[np.repeat(np.arange(len(sizes)), sizes), _within(sizes)] = flat
    return out


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _padded(values: np.ndarray, width: int, filler: int = -1) -> np.ndarray:
    more = np.full((len(values), width - values.shape[1]), filler, values.dtype)
    return np.concatenate([values, more], 1)


def _placed(
    vectors: DataFrame,
    index: Index,
    lists: int,
    ratio: float,
    sizes: np.ndarray | None = None,
    enough: int = 0,
) -> DataFrame:
    """(vec_id, vector, list): the lists of each vector, at most ``lists``.

    A list is taken if its centroid is at most ``ratio`` times as far as the nearest.
    ``sizes`` (rows of each list) marks queries: they take further lists, of all there
    are, until ``enough`` rows lie in those taken.
    """
    queries = sizes is not None
    shared = vectors.sparkSession.sparkContext.broadcast((index, sizes))  # about MAX_LISTS rows

    def chosen(own: Index, rows_of: np.ndarray | None, points: np.ndarray):
        """(row, place) of each list taken, and all that were looked at."""
        best, dist = own.near(points, max(lists, 32))
        take = (dist <= dist[:, :1] * ratio**2 + 1e-12) & (best >= 0)
        take[:, lists:] = False
        if queries:
            # Rows whose lists hold too few: small or empty ones lie near, so look at all.
            held = (rows_of[best] * take).sum(1)
            if (held < enough).any() and best.shape[1] < len(own.centroids):
                best = _padded(best, len(own.centroids))
                take = _padded(take, len(own.centroids), False)
                short = np.flatnonzero(held < enough)
                best[short], gap = own.near(points[short], len(own.centroids))
                near = gap <= gap[:, :1] * ratio**2 + 1e-12
                near[:, lists:] = False
                take[short] = near
            held = rows_of[best]
            take |= (np.cumsum(held, axis=1) - held < enough) & (best >= 0)
        return *np.nonzero(take), best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows_of = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = _matrix(part.column(1), own.dimension)
                points = own.lift_queries(x) if queries else own.lift(x)
                row, place, best = chosen(own, rows_of, points)
                rows = pa.array(row)
                data = np.ascontiguousarray(x)
                blobs = pa.array([r.tobytes() for r in data], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), blobs.take(rows), pa.array(best[row, place])],
                    ["vec_id", "vector", "list"],
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, vector binary, list long")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    copies: int = 6,
    border: float = 1.15,
    probes: int = 96,
    reach: float = 1.25,
) -> DataFrame:
    """The ``k`` vectors with the largest inner product with each query.

    Returns query_id, rank (from 1), vec_id, score (inner product in double
    precision); fewer rows only where there are fewer candidates in the lists read.
    Both tables have vec_id and embedding. Rows without id and vectors that are null,
    empty, zero or hold a null or non-finite number take no part; a query's own id is
    no candidate; shorter vectors count as ending in zeros. Rows of one id count once,
    by their best score. Ties go to the smaller id. An empty table gives an empty
    result. A vector is kept in up to ``copies`` lists whose centroids are within
    ``border`` times the nearest one's distance; a query reads up to ``probes`` lists, or
    SHARE of all if that is more, within ``reach``, and more until they hold k others. Of equal vectors only the k+1 smallest ids can be among the
    nearest of any query: the others are left out of the lists, not out of the result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    points = usable(vectors)
    rows, dimension, longest = points.agg(
        F.count("*"),
        F.max(F.size("embedding")),
        F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))),
    ).first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not rows:
        return spark.createDataFrame([], empty)
    asked = usable(queries)
    widest = asked.agg(F.max(F.size("embedding"))).first()[0]
    if widest is None:
        return spark.createDataFrame([], empty)
    dimension = max(dimension, widest)
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding")
    found = sample.toArrow().column(0).combine_chunks()
    index = fit_index(_matrix(found, dimension), rows, float(longest))

    first = W.partitionBy("embedding").orderBy("vec_id")
    kept = points.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)
    posted = checkpointed(_placed(kept.drop("copy"), index, copies, border))
    sizes = np.zeros(len(index.centroids), np.int64)
    for row in posted.groupBy("list").count().collect():
        sizes[row["list"]] = row["count"]
    # So many rows hold k different ids besides the query's own, whatever is kept twice.
    enough = (k + 1) * copies
    read = max(probes, math.ceil(SHARE * len(index.centroids)))
    probed = checkpointed(_placed(asked, index, read, reach, sizes, enough))
    # One row per list: about MAX_LISTS.
    blocks = (
        posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        .join(probed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("asked")), "list")
    )
    blocks = F.broadcast(checkpointed(blocks))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Deal rows of long lists into blocks, one copy for each block of the other side."""
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other)
        return df.join(blocks, "list").select("list", "vec_id", "vector", mine, every)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            x = np.frombuffer(b"".join(left["vector"]), np.float64).reshape(len(left), -1)
            q = np.frombuffer(b"".join(right["vector"]), np.float64).reshape(len(right), -1)
            ids, asker = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for at in range(0, len(q), 256):
                # Sums in one fixed order: equal vectors have equal scores in every task.
                s = np.einsum("qd,nd->qn", q[at : at + 256], x)
                s[asker[at : at + 256, None] == ids[None, :]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(s, best, 1)
                row, _ = np.nonzero(np.isfinite(value))
                out["query_id"].append(asker[at : at + 256][row])
                out["vec_id"].append(ids[best[np.isfinite(value)]])
                out["score"].append(value[np.isfinite(value)])
        return pd.DataFrame(
            {c: np.concatenate(v) if v else np.zeros(0, "f8" if c == "score" else "i8") for c, v in out.items()}
        )

    keys = ["list", "blocks", "asked"]
    hits = (
        dealt(posted, "blocks", "asked")
        .groupBy(*keys)
        .cogroup(dealt(probed, "asked", "blocks").groupBy(*keys))
        .applyInPandas(score, "query_id long, vec_id long, score double")
    )
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
