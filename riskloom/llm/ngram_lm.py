"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Training tasks count word pairs of their own texts and send each pair once, packed
in arrays, to the shard that a hash names; followers of one word are spread over
several shards, so a very common word fills none. Shards keep pairs and words as
sorted arrays of 64-bit hashes with counts, as files in the shared folder. Scoring
tasks map those files into memory and look hashes up by binary search.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_batches, run_spans, run_starts
from riskloom.llm.wordhash import mix, word_hashes
from riskloom.session import ensure_checkpoint_dir

#: Hashes of the marks before and behind a text; no word has them but by chance.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Pairs that a task holds before it counts and sends them.
HELD = 1 << 21
#: Bytes of text whose pairs make a shard, where that gives more than the shuffle's partitions,
#: and shards of pairs for one of words; a task holds one shard at a time.
SHARD_BYTES, PAIRS_TO_WORDS = 8 << 20, 4
#: Shards over which the followers of one word are spread.
SPREAD_BITS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * _ODD + mix(w))


def pair_shard(u: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    part = w >> np.uint64(64 - SPREAD_BITS)
    return (((mix(u) >> np.uint64(8)) + part) % np.uint64(shards)).astype(np.int64)


def word_shard(w: np.ndarray, shards: int) -> np.ndarray:
    return ((w >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)


def text_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every token and the one before it, over all texts, and the tokens of each text."""
    words, ends, _ = word_hashes(texts, fold_case=True)
    sizes = np.diff(ends, prepend=0) + 1
    stops = np.cumsum(sizes)
    tokens = np.full(stops[-1] if len(stops) else 0, END)
    inner = np.ones(len(tokens), bool)
    inner[stops - 1] = False
    tokens[inner] = words
    before = np.concatenate([[START], tokens[:-1]])[: len(tokens)]
    before[stops - sizes] = START
    return before, tokens, sizes


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def count_pairs(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, u, n, w, c): packed pairs; ``n`` followers ``w`` for each ``u``, counts ``c``."""
    bounded_batches(docs.sparkSession, 128)

    def packed(u: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        p = pair_shard(u, w, shards)
        order = np.lexsort((w, u, p))
        u, w, p = u[order], w[order], p[order]
        pairs = run_starts(p, u, w)
        c = np.diff(np.append(pairs, len(u))).astype(np.uint32)
        u, w, p = u[pairs], w[pairs], p[pairs]
        groups = run_starts(p, u)
        n = np.diff(np.append(groups, len(u))).astype(np.uint32)
        for start, end in run_spans(p):
            a, b = np.searchsorted(groups, [start, end])
            arrays = (u[groups[a:b]], n[a:b], w[start:end], c[start:end])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(p[start])]), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)],
                ["shard", "u", "n", "w", "c"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            u, w, _ = text_pairs(_texts(batch.column(0)))
            held.append((u, w))
            if sum(len(x) for x, _ in held) >= HELD:
                yield from packed(*map(np.concatenate, zip(*held, strict=True)))
                held.clear()
        if held:
            yield from packed(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select(docs["text"].cast("string")).mapInArrow(
        run, "shard long, u binary, n binary, w binary, c binary"
    )


def _joined(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _save(path: str, *arrays: np.ndarray) -> None:
    """Write arrays one after another, under another name first: reruns replace whole files."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for a in arrays:
            f.write(a.tobytes())
    os.replace(own, path)


def _count_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def build_pair_shards(pairs: DataFrame, folder: str, words: int) -> DataFrame:
    """Write each shard's pairs; return packed statistics by ``words`` word shards.

    A pair file has the sorted keys and counts up to 255 as bytes, then the places
    and counts of larger ones. Rows: shard, word, seen (occurrences), before
    (different words before it), n1, n2, n3 (different words behind it, seen once,
    twice, more), and for the totals k1 to k4: pairs seen one to four times.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n = _joined(group["n"], np.uint32)
        u = np.repeat(_joined(group["u"], np.uint64), n)
        w, c = _joined(group["w"], np.uint64), _joined(group["c"], np.uint32).astype(np.int64)
        key = pair_key(u, w)
        order = np.argsort(key, kind="stable")
        key, u, w, c = key[order], u[order], w[order], c[order]
        starts = run_starts(key)
        key, u, w, c = key[starts], u[starts], w[starts], _sums(c, starts)
        large = np.flatnonzero(c >= 255)
        _save(
            f"{folder}/pairs-{group['shard'].iloc[0]}",
            np.array([len(key), len(large)], np.int64),
            key,
            large,
            c[large],
            np.minimum(c, 255).astype(np.uint8),
        )
        # Statistics of the words in both places, added up per word of this shard.
        counted = _count_of_counts(c)
        word = np.concatenate([u, w])
        del key, u, w
        q = word_shard(word, words)
        order = np.lexsort((word, q))
        word, q = word[order], q[order]
        starts = run_starts(q, word)
        nil = np.zeros(len(c), np.int64)

        def column(front: np.ndarray, behind: np.ndarray, kind) -> np.ndarray:
            return _sums(np.concatenate([front, behind]).astype(np.int64)[order], starts).astype(kind)

        columns = [column(nil, c, np.uint64), column(nil, nil + 1, np.uint32)]
        columns += [column(x, nil, np.uint32) for x in (c == 1, c == 2, c >= 3)]
        word, q = word[starts], q[starts]
        rows = []
        for a, b in run_spans(q):
            rows.append((int(q[a]), word[a:b].tobytes(), *(x[a:b].tobytes() for x in columns), 0, 0, 0, 0))
        rows.append((-1, b"", b"", b"", b"", b"", b"", *counted))
        return _frame(rows, _STATISTICS)

    kinds = ["long", *["binary"] * 6, *["long"] * 4]
    schema = ", ".join(f"{n} {k}" for n, k in zip(_STATISTICS, kinds, strict=True))
    return pairs.groupBy("shard").applyInPandas(run, schema)


_STATISTICS = ["shard", "word", "seen", "before", "n1", "n2", "n3", "k1", "k2", "k3", "k4"]
_TOTALS = ["tokens", "words", "pairs", "k1", "k2", "k3", "k4", "b1", "b2", "b3", "b4"]


def build_word_shards(statistics: DataFrame, folder: str) -> DataFrame:
    """Write each shard's words; return rows of totals to be added up.

    A word file has the sorted hashes, then seen, before, n1, n2, n3 of each.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if group["shard"].iloc[0] < 0:
            k = [int(group[f"k{i}"].sum()) for i in (1, 2, 3, 4)]
            return _frame([(0, 0, 0, *k, 0, 0, 0, 0)], _TOTALS)
        word = _joined(group["word"], np.uint64)
        kinds = [np.uint64, *[np.uint32] * 4]
        columns = [
            _joined(group[name], kind).astype(np.int64)
            for name, kind in zip(["seen", "before", "n1", "n2", "n3"], kinds, strict=True)
        ]
        order = np.argsort(word, kind="stable")
        word = word[order]
        starts = run_starts(word)
        columns = [_sums(x[order], starts) for x in columns]
        word = word[starts]
        _save(
            f"{folder}/words-{group['shard'].iloc[0]}",
            np.array([len(word)], np.int64), word, *columns,
        )
        seen, before = columns[:2]
        row = (int(seen.sum()), int((seen > 0).sum()), int(before.sum()), 0, 0, 0, 0)
        return _frame([(*row, *_count_of_counts(before))], _TOTALS)

    schema = ", ".join(f"{n} long" for n in _TOTALS)
    return statistics.groupBy("shard").applyInPandas(run, schema)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things counted one to four times."""
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    later = [
        (k + 1) - (k + 2) * y * n[k + 1] / n[k] if n[k] else k + 0.5 for k in (0, 1, 2)
    ]
    return tuple(min(max(d, 0.0), k + 1.0) for k, d in enumerate(later))


@dataclass(frozen=True)
class BigramModel:
    """Where the files are and the totals; one per corpus, small enough for every task."""

    folder: str
    shards: int
    word_shards: int
    tokens: int
    words: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_mass: float


@lru_cache(maxsize=1 << 14)
def _mapped(path: str) -> memoryview:
    if not os.path.isdir(os.path.dirname(path)):
        raise FileNotFoundError(f"this worker does not see the model folder of {path}")
    if not os.path.exists(path):  # no pair or word fell into this shard
        return memoryview(np.zeros(2, np.int64)).cast("B")
    with open(path, "rb") as f:
        return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def _pair_counts(model: BigramModel, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    key, shard = pair_key(u, w), pair_shard(u, w, model.shards)
    out = np.zeros(len(key), np.int64)
    order = np.lexsort((key, shard))
    for a, b in run_spans(shard[order]):
        mine = order[a:b]
        data = _mapped(f"{model.folder}/pairs-{shard[mine[0]]}")
        n, m = np.frombuffer(data, np.int64, 2)
        keys = np.frombuffer(data, np.uint64, n, 16)
        at = np.minimum(np.searchsorted(keys, key[mine]), max(n - 1, 0))
        hit = np.flatnonzero(keys[at] == key[mine]) if n else np.zeros(0, np.int64)
        count = np.frombuffer(data, np.uint8, n, 16 + 8 * n + 16 * m)[at[hit]].astype(np.int64)
        places = np.frombuffer(data, np.int64, m, 16 + 8 * n)
        big = count == 255
        count[big] = np.frombuffer(data, np.int64, m, 16 + 8 * (n + m))[
            np.searchsorted(places, at[hit][big])
        ]
        out[mine[hit]] = count
    return out


def _word_counts(model: BigramModel, w: np.ndarray) -> list[np.ndarray]:
    """seen, before, n1, n2, n3 of each word; zeros for unknown ones."""
    shard = word_shard(w, model.word_shards)
    out = [np.zeros(len(w), np.int64) for _ in range(5)]
    order = np.lexsort((w, shard))
    for a, b in run_spans(shard[order]):
        mine = order[a:b]
        data = _mapped(f"{model.folder}/words-{shard[mine[0]]}")
        (n,) = np.frombuffer(data, np.int64, 1)
        if not n:
            continue
        keys = np.frombuffer(data, np.uint64, n, 8)
        at = np.minimum(np.searchsorted(keys, w[mine]), n - 1)
        hit = keys[at] == w[mine]
        for i, x in enumerate(out):
            x[mine[hit]] = np.frombuffer(data, np.int64, n, 8 + 8 * n * (i + 1))[at[hit]]
    return out


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def token_scores(
    model: BigramModel, u: np.ndarray, w: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability, log10 of the base, and whether known, of each token ``w`` after ``u``."""
    word, back = np.unique(np.concatenate([u, w]), return_inverse=True)
    seen, before, n1, n2, n3 = _word_counts(model, word)
    first, second = back[: len(u)], back[len(u) :]
    # Lower order: in how many different places a word stands, a share for all words alike.
    words = model.words + 1
    if model.pairs:
        lower = (before - _discount(before, model.word_discounts)).clip(0) / model.pairs
        lower += model.word_mass / words
    else:
        lower = np.full(len(word), 1 / words)
    # Every occurrence of a word is followed by one token: the sum over its followers.
    pair, where = np.unique(pair_key(u, w), return_inverse=True)
    one = np.zeros(len(pair), np.int64)
    one[where] = np.arange(len(where))
    count = _pair_counts(model, u[one], w[one])[where]
    d = model.pair_discounts
    total = np.where(word == START, _start_total(model), seen)[first]
    mass = (d[0] * n1 + d[1] * n2 + d[2] * n3)[first]
    known = (total > 0) & ((n1 + n2 + n3)[first] > 0)
    safe = np.maximum(total, 1)
    p = np.where(
        known,
        (count - _discount(count, d)).clip(0) / safe + mass / safe * lower[second],
        lower[second],
    )
    base = (seen[second] + 0.5) / (model.tokens + 0.5 * (model.words + 1))
    return np.log10(p), np.log10(base), seen[second] > 0


def _start_total(model: BigramModel) -> int:
    """Texts trained on: each has one start and one end."""
    return int(_word_counts(model, np.array([END]))[0][0])


def model_folder(docs: DataFrame) -> str:
    """A new folder for model files in the shared folder, which all machines must mount."""
    shared = urlparse(ensure_checkpoint_dir(docs.sparkSession))
    if shared.scheme not in ("", "file"):
        raise ValueError(f"workers cannot map files of {shared.scheme}: mount the shared folder")
    folder = os.path.join(unquote(shared.path), f"bigrams-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def shard_numbers(docs: DataFrame) -> tuple[int, int]:
    """Shards of pairs and of words: they grow with the text, so that none outgrows a task."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(docs["text"].cast("string")))).first()[0] or 0
    shards = max(least, -(-size // SHARD_BYTES))
    return shards, max(least, shards // PAIRS_TO_WORDS)


def train_bigrams(docs: DataFrame, folder: str | None = None) -> BigramModel:
    """Count all texts of ``docs`` and write the model's files.

    A text is its words, A-Z as a-z, and one end; the first word follows a start
    mark. A null text is an end alone; an empty table gives a model that knows nothing.
    Only totals come to the driver. A task that runs again replaces its file by an
    equal one.
    """
    folder = folder or model_folder(docs)
    shards, words = shard_numbers(docs)
    statistics = build_pair_shards(count_pairs(docs, shards), folder, words)
    totals = build_word_shards(statistics, folder)
    row = totals.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _TOTALS]).first()
    word_discounts = discounts([row[f"b{i}"] for i in (1, 2, 3, 4)])
    # What the discounts take from all words goes to all words alike, unknown ones included.
    held = [row["b1"], row["b2"], row["words"] - row["b1"] - row["b2"]]
    mass = sum(d * n for d, n in zip(word_discounts, held, strict=True)) / max(row["pairs"], 1)
    return BigramModel(
        folder,
        shards,
        words,
        row["tokens"],
        row["words"],
        row["pairs"],
        discounts([row[f"k{i}"] for i in (1, 2, 3, 4)]),
        word_discounts,
        mass,
    )


def score_texts(docs: DataFrame, model: BigramModel) -> DataFrame:
    """Score whole texts: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``score`` is the model's log10 probability of a text with its end, ``base_score``
    that of the smoothed unigram counts, ``perplexity`` 10^(-score / n_tokens). A null
    text is an end alone. One row comes out for each that goes in; other columns are
    ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w, sizes = text_pairs(_texts(batch.column(1)))
            starts = np.cumsum(sizes) - sizes
            p, base, known = token_scores(model, u, w)
            score = _sums(p, starts)
            columns = [
                pa.array(sizes),
                pa.array(_sums(known.astype(np.int64), starts)),
                pa.array(np.full(len(sizes), model.tokens)),
                pa.array(_sums(base, starts)),
                pa.array(score),
                pa.array(10 ** (-score / np.maximum(sizes, 1))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], _SCORES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(
        run,
        f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, perplexity double",
    )


_SCORES = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether a document is kept out of training: by the CRC-32 of its id as text."""
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % folds == fold


def score_held_out(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and score all: adds held_out."""
    model = train_bigrams(docs.where(~held_out(F.col("doc_id"))))
    return score_texts(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
