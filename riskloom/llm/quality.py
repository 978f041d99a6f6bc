"""Quality by importance resampling with hashed n-gram models.

Two generative models over hashed n-grams, one of target text and one of all raw
text, give each document a weight: the ratio of its likelihoods. Adding Gumbel
noise to log weights and keeping the k largest draws k documents without
replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_batches
from riskloom.llm.wordhash import mix, word_hashes
from riskloom.session import checkpointed

BUCKETS = 1 << 15
#: At most so many labelled documents give the target model and the size of the draw.
LABELLED = 20_000


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and how many each text has.

    Words, pairs of words, shapes, pairs of shapes (each hashed with its kind), and
    whether a word repeats the one before it.
    """
    words, ends, shapes = word_hashes(texts, fold_case=False, shapes=True)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    head = np.zeros(len(words) + 1, bool)
    head[starts] = True
    head = head[:-1]
    odd = np.uint64(0x9E3779B97F4A7C15)

    def before(h: np.ndarray) -> np.ndarray:
        return np.where(head, np.uint64(0), np.concatenate([h[:1], h[:-1]]))

    same = (before(words) == words).astype(np.uint64)
    kinds = (words, words + before(words) * odd, shapes, shapes + before(shapes) * odd, same)
    mask = np.uint64(BUCKETS - 1)
    mixed = [mix(k + np.uint64(i + 1)) & mask for i, k in enumerate(kinds)]
    buckets = np.stack(mixed, axis=1).astype(np.int64).ravel()
    return buckets, (ends - starts) * len(kinds)


@dataclass(frozen=True)
class Resampler:
    """A fitted model: the log ratio of each bucket, and the cut of the mean log ratio."""

    log_ratio: np.ndarray
    cut: float
    sharpness: float = 200.0
    seed: int = 11


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def label_sample(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` labelled ids, those of smallest hash: (doc_id, good).

    An id with several labels is good only if all of them say so; null ids and
    labels are left out.
    """
    return (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )


def bucket_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents and of the good labelled ones.

    Each task adds up its own documents, so at most one row per task and bucket
    is shuffled.
    """
    bounded_batches(docs.sparkSession, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            buckets, sizes = features(_texts(batch.column(0)))
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            raw += np.bincount(buckets, minlength=BUCKETS)
            target += np.bincount(buckets[np.repeat(good, sizes)], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(raw[used]), pa.array(target[used])],
            ["bucket", "raw", "target"],
        )

    # The sample has LABELLED rows at most, so it can be sent to every task.
    marked = docs.select("doc_id", docs["text"].cast("string")).join(
        F.broadcast(sample), "doc_id", "left"
    )
    return (
        marked.select("text", F.coalesce("good", F.lit(False)).alias("good"))
        .mapInArrow(run, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def text_scores(texts: list[bytes], log_ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and mean log ratio of each text's n-grams, alike in any company of texts."""
    buckets, sizes = features(texts)
    total = np.zeros(len(sizes))
    some = sizes > 0
    if some.any():
        total[some] = np.add.reduceat(log_ratio[buckets], (np.cumsum(sizes) - sizes)[some])
    return sizes, total / np.maximum(sizes, 1)


def mean_log_ratio(docs: DataFrame, log_ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, score): the mean log ratio of a text's n-grams; 0 without any."""
    bounded_batches(docs.sparkSession, 128)
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, score = text_scores(_texts(batch.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(score)],
                ["doc_id", "n_grams", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_grams long, score double"
    )


def best_cut(scored: pd.DataFrame) -> float:
    """The cut with the fewest errors in both classes alike; the lowest of equal ones.

    Without labels of both kinds there is nothing to tell apart: everything stays.
    """
    good = np.sort(scored.loc[scored["good"], "score"].to_numpy())
    bad = np.sort(scored.loc[~scored["good"], "score"].to_numpy())
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.concatenate([good, bad])
    cuts.sort()
    middle = np.concatenate([cuts[:1], (cuts[1:] + cuts[:-1]) / 2])
    lost = np.searchsorted(good, middle) / len(good)
    passed = 1 - np.searchsorted(bad, middle) / len(bad)
    return float(middle[np.argmin(lost + passed)])


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the id: the same at every run."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 12).cast("double") + 0.5) / float(
        1 << 52
    )
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096, rounds: int = 3) -> float | None:
    """The k-th largest of column ``key``, by counts in ever narrower bins.

    No sort of all rows: each round counts rows by bin and goes on in the bin where
    the count passes k; the last bin is ordered by its distinct keys.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return None
    for _ in range(rounds):
        if low == high:
            return high
        width = (high - low) / bins
        number = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        counted = (
            keys.where(F.col("key").between(low, high))
            .groupBy(number.alias("bin"))
            .agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
            .orderBy(F.desc("bin"))
            .collect()  # at most ``bins`` rows
        )
        for row in counted:
            low, high = row["low"], row["high"]
            if row["n"] >= k:
                break
            k -= row["n"]
        else:
            return low
    last = (
        keys.where(F.col("key").between(low, high)).groupBy("key").count().orderBy(F.desc("key"))
    )
    for row in last.toLocalIterator():
        k -= row["count"]
        if k <= 0:
            return row["key"]
    return low


def fit_resampler(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Resampler:
    """Fit both models on all documents, the target one on good labelled documents.

    ``limit`` bounds the labelled rows used. Only bucket counts and the scores of
    the labelled sample come to the driver, both of fixed size.
    """
    sample = checkpointed(label_sample(labels, limit))
    counts = bucket_counts(docs, sample).toPandas()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    log_ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    labelled = docs.join(F.broadcast(sample), "doc_id", "left_semi")
    scores = mean_log_ratio(labelled, log_ratio).join(F.broadcast(sample), "doc_id")
    return Resampler(log_ratio, best_cut(scores.select("score", "good").toPandas()))


def draw(
    docs: DataFrame, model: Resampler, k: int | None = None
) -> tuple[DataFrame, float | None]:
    """Scores of all documents (doc_id, n_grams, score, key), and the least key drawn."""
    scored = checkpointed(
        mean_log_ratio(docs, model.log_ratio).withColumn("key", log_weight(F.col("score"), model))
    )
    if k is None:
        k = scored.where(F.col("score") >= model.cut).count()
    return scored, kth_largest(scored.select("key"), k)


def log_weight(score: Column, model: Resampler) -> Column:
    return score * model.sharpness + gumbel(F.col("doc_id"), model.seed)


def resample(docs: DataFrame, model: Resampler, k: int | None = None) -> DataFrame:
    """Draw documents by their weights: doc_id, n_grams, score, key, kept.

    ``score`` is the mean log ratio, ``key`` the log weight (``sharpness`` n-grams of
    that mean) plus Gumbel noise; the ``k`` largest keys are kept, with all ties of
    the last. By default k is the number of documents whose score reaches the
    model's cut, so the draw is as large as the part of the corpus that looks like
    the target. A null or empty text has score 0. Repeats of one id share their
    noise; documents with equal texts share their score. Other columns are ignored;
    an empty table gives an empty result.
    """
    scored, least = draw(docs, model, k)
    return scored.withColumn("kept", _drawn(F.col("key"), least))


def drawn_documents(docs: DataFrame, model: Resampler, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, with all their columns.

    Texts are scored again where they lie instead of being shuffled to their keys.
    """
    _, least = draw(docs, model, k)
    shared = docs.sparkSession.sparkContext.broadcast(model.log_ratio)  # BUCKETS numbers

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        texts = [b"" if t is None else t.encode() for t in text]
        return pd.Series(text_scores(texts, shared.value)[1])

    key = log_weight(score(docs["text"].cast("string")), model)
    return docs.where(_drawn(key, least))


def _drawn(key: Column, least: float | None) -> Column:
    return F.lit(False) if least is None else key >= least
