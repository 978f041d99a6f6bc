"""Document fingerprints: one-permutation MinHash in DataFrame functions.

Every shingle of a text is hashed once; its high bits name a bin, and the bin keeps
its smallest hash. Empty bins take the value of a bin that a fixed random order of
all bins names first (optimal densification), so that two texts agree in a bin with
a chance equal to their Jaccard similarity. Of each bin the four low bits are kept,
packed sixteen to a long; equal bits by chance are taken out of the estimate.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower

BIN_BITS = 8
BINS = 1 << BIN_BITS
VALUE_BITS = 64 - BIN_BITS
LOW_BITS = 4
PER_LONG = 64 // LOW_BITS
LONGS = BINS // PER_LONG
#: Probes before the complete order of all full bins is looked at.
PROBES = 8
#: Rows of one range of ids, which a single task orders.
RANGE_ROWS = 2048
#: At most so many ranges; beyond 134 million rows each range grows instead.
MAX_RANGES = 1 << 16


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column, width: int = 5) -> Column:
    """64-bit hashes of all runs of ``width`` words, A-Z as a-z; of a shorter text as one."""
    words = F.array_remove(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), "")

    def hashes(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]),
        )
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(
            F.array().cast("array<bigint>")
        )
        return F.when(F.size(w) >= width, runs).otherwise(short)

    return let(words, hashes)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, VALUE_BITS)


def _empty(h: Column) -> Column:
    """A bin's mark: the largest value of the bin, which stands behind every hash."""
    largest = (1 << VALUE_BITS) - 1
    return h.bitwiseAND(F.lit(largest)) == F.lit(largest)


def _bins(hashes: Column) -> Column:
    """The smallest hash of each bin, in a fixed order of the bins; its mark if empty."""
    marks = F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        lambda b: F.shiftleft(b.cast("long"), VALUE_BITS).bitwiseOR(
            F.lit((1 << VALUE_BITS) - 1)
        ),
    )
    ordered = F.sort_array(F.concat(hashes, marks))
    return let(
        ordered,
        lambda s: F.filter(
            s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, F.greatest(i - 1, F.lit(0)))))
        ),
    )


def _densified(bins: Column) -> Column:
    """Fill each empty bin from the first full bin of its own random order of bins."""

    def fill(b: Column, full: Column) -> Column:
        def filled(x: Column, i: Column) -> Column:
            tried = F.filter(
                F.transform(
                    F.sequence(F.lit(0), F.lit(PROBES - 1)),
                    lambda t: F.get(b, F.pmod(F.xxhash64(i, t), F.lit(BINS)).cast("int")),
                ),
                lambda y: ~_empty(y),
            )
            ranked = F.array_min(
                F.transform(
                    full, lambda y: F.struct(F.xxhash64(i, _bin(y)).alias("order"), y.alias("h"))
                )
            )["h"]
            return F.when(~_empty(x), x).otherwise(
                F.coalesce(F.get(tried, F.lit(0)), ranked)
            )

        return F.transform(b, filled)

    return let(bins, lambda b: let(F.filter(b, lambda x: ~_empty(x)), lambda full: fill(b, full)))


def packed_fingerprint(text: Column, width: int = 5) -> Column:
    """Array of longs with the low bits of all bins; empty for a text without words."""
    mask = (1 << LOW_BITS) - 1

    def pack(d: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(LONGS - 1)),
            lambda j: F.aggregate(
                F.slice(d, j * PER_LONG + 1, PER_LONG),
                F.lit(0).cast("long"),
                lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x.bitwiseAND(F.lit(mask).cast("long"))),
            ),
        )

    return let(
        shingles(text, width),
        lambda s: F.when(F.size(s) > 0, let(_densified(_bins(s)), pack)).otherwise(
            F.array().cast("array<bigint>")
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, from 0 to 1.

    ``LOW_BITS`` bits of different values agree with chance c = 2^-LOW_BITS, so the
    share m of equal bins stands for (m - c) / (1 - c). Two texts without words are
    alike, one without is unlike any with words.
    """
    ones = F.lit(int("1" * PER_LONG, 16))

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseAND(ones))

    apart = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, n: acc + n)
    chance = 2.0**-LOW_BITS
    share = 1 - apart / F.lit(float(BINS))
    estimate = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), estimate).otherwise(
        (F.size(a) == F.size(b)).cast("double")
    )


def hex_fingerprint(packed: Column) -> Column:
    return F.array_join(
        F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ""
    )


def _edges(docs: DataFrame) -> tuple[list[float], int]:
    """Sorted quantiles of the ids, one per RANGE_ROWS rows (MAX_RANGES at most), and the
    number of ranges for rows without id."""
    known, n = docs.agg(F.count("doc_id"), F.count("*")).first()
    ranges = min(MAX_RANGES, known // RANGE_ROWS)
    found = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        ids = docs.select(F.col("doc_id").cast("double").alias("id"))
        found = ids.approxQuantile("id", shares, 0.25 / ranges)
    return found, max(1, min(MAX_RANGES, (n - known) // RANGE_ROWS))


def _count_below(edges: list[float], c: Column, reached: bool) -> Column:
    """Number of sorted edges below ``c`` (or not above it, if ``reached``).

    The edges stand in runs: whole runs are counted by their last edge, then one is read.
    """
    if not edges:
        return F.lit(0)
    size = math.isqrt(len(edges) - 1) + 1
    runs = [edges[i : i + size] for i in range(0, len(edges), size)]
    # A literal that is parsed once when the plan is made, not 65,536 expressions.
    table = F.from_json(F.lit(json.dumps(runs)), "array<array<double>>")
    last = F.from_json(F.lit(json.dumps([r[-1] for r in runs])), "array<double>")

    def counted(values: Column) -> Column:
        return F.size(F.filter(values, lambda e: e <= c if reached else e < c))

    whole = counted(last)
    inside = F.when(whole < len(runs), counted(F.get(table, whole))).otherwise(0)
    return whole * size + inside


def with_next(docs: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Add columns ``derived`` from each row's own, and ``next``, a struct of the text and
    those of the next row by descending ``doc_id``, a number.

    Quantiles cut the ids into ranges of about RANGE_ROWS rows, however the ids lie; an id
    that many rows share, and rows without id, are cut further by a hash of the text (ids
    of 2^53 and more are not). Each range is ordered in one task, with the first row of the
    range after it added at its end. After the last row comes the first. Null ids come
    last, repeated ids by hash and text.
    """
    edges, unknown = _edges(docs)
    spot = F.shiftrightunsigned(F.xxhash64("text"), 11)
    share = F.col("spot") / F.lit(2.0**53)
    at = F.col("doc_id").cast("double")
    # An id that is itself an edge, or several, lies on both sides of them.
    room = F.when(F.abs(at) < 2.0**53, F.col("upto") - F.col("below") + 1).otherwise(1)
    # Ranges are numbered so that a larger id has a smaller number; null ids come last.
    number = (
        F.when(F.col("doc_id").isNull(), len(edges) + unknown - F.floor(share * unknown))
        .otherwise(len(edges) - F.col("below") - F.floor(share * room))
        .cast("long")
    )
    ranged = (
        docs.withColumns(
            {
                "spot": spot,
                "below": _count_below(edges, at, False),
                "upto": _count_below(edges, at, True),
            }
        )
        .withColumn("range", number)
        .drop("below", "upto")
    )
    # One row for each range passes through this window: twice MAX_RANGES and one at most,
    # so the table can be sent to every task and texts are shuffled once.
    heads = ranged.groupBy("range").agg(F.max(F.struct("doc_id", "spot")).alias("head")).select(
        "head",
        F.coalesce(
            F.lag("range").over(W.orderBy("range")),
            F.max("range").over(W.partitionBy()),
        ).alias("into"),
    )
    borrowed = (
        ranged.join(F.broadcast(heads), F.struct("doc_id", "spot").eqNullSafe(F.col("head")))
        .withColumn("range", F.col("into"))
        .drop("head", "into")
    )
    rows = (
        ranged.withColumn("own", F.lit(True))
        .unionByName(borrowed.withColumn("own", F.lit(False)))
        .withColumns(derived)
    )
    order = W.partitionBy("range").orderBy(
        F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("spot"), "text"
    )
    follower = F.lead(F.struct("text", *derived)).over(order)
    return rows.withColumn("next", follower).where("own").drop("own", "range", "spot")


def fingerprint_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts.

    Returns one row per row of ``docs``: doc_id, n_chars (code points), edited_sha256,
    fingerprint, edited_fingerprint (hexadecimal; empty for a text without words),
    near_edited, near_next. The edited text has its last third replaced by as many
    first characters of the next document by descending id (all of a shorter one).
    ``doc_id`` is a whole number of any size or null. A null text is empty. Shingles are ``width`` words. Repeated rows give repeated
    rows; other columns are ignored; an empty table gives an empty result. Texts are
    shuffled once, by ranges of ids.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(texts, {"packed": packed_fingerprint(F.col("text"), width)})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - third),
        F.substring(F.col("next.text"), F.lit(1), third),
    )
    # The edited text is bound once: all that follows reads that one value.
    made = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "packed",
        F.col("next.packed").alias("next_packed"),
        let(
            edited,
            lambda e: F.struct(
                F.sha2(e.cast("binary"), 256).alias("sha"),
                packed_fingerprint(e, width).alias("packed"),
            ),
        ).alias("edited"),
    )
    return made.select(
        "doc_id",
        "n_chars",
        F.col("edited.sha").alias("edited_sha256"),
        hex_fingerprint(F.col("packed")).alias("fingerprint"),
        hex_fingerprint(F.col("edited.packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited.packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
