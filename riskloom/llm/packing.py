"""Packing documents into sequences: first-fit decreasing with a tournament tree.

Documents are tokenized and cut where they are read; only the lengths of the pieces
travel. A hash deals the pieces into random groups, and each group of bounded size
is packed for itself: largest piece first, into the first sequence with room, which
a tournament tree over the sequences' free space finds in logarithmic time.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_batches

#: Pieces that are packed together; bounds a task's memory.
GROUP_PIECES = 16_384
#: Fixed value: the pattern by which byte-level vocabularies cut text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    A byte-level vocabulary file whose merges come in the order of their ids is the
    same as a table of ranks, which a second public library encodes several times
    faster; any other file, and a text on which that library gives up, goes to the
    file's own library. Special tokens' texts count as those tokens in both.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.quick = None
        model, level = spec["model"], spec["pre_tokenizer"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        plain = (
            model["type"] == "BPE"
            and level["type"] == "ByteLevel"
            and level["use_regex"]
            and not level["add_prefix_space"]
            and not spec["normalizer"]
            and not model["end_of_word_suffix"]
            and merged == sorted(merged)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        if plain:
            byte = {c: b for b, c in enumerate(byte_letters())}
            ranks = {
                bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special
            }
            self.special = set(special)
            self.quick = Encoding(
                "from_file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special
            )

    def ids(self, text: str) -> bytes:
        if self.quick is not None:
            try:
                found = self.quick.encode_to_numpy(text, allowed_special=self.special)
                return found.astype("<u4", copy=False).tobytes()
            except Exception:  # its regular expressions give up on some very long runs
                pass
        found = self.library.encode(text, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@cache
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; equal lengths keep their order.

    The tree's leaves are the bins' free room, inner nodes the largest room below:
    going left where it suffices finds the first bin with room.
    """
    n = len(lengths)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    room = [size] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, size - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins, offsets


def document_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """Pieces of at most ``size`` ids: doc_id, start, length, ids_crc32, doc_tokens."""
    bounded_batches(docs.sparkSession, 128)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = (_tokens(vocabulary).ids(text) if text else b"") + end
                n = len(ids) // 4
                for s in range(0, n, size):
                    piece = ids[4 * s : 4 * (s + size)]
                    row.append(i)
                    start.append(s)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            columns = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(
        run,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long",
    )


def pack_documents(
    docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, seed: int = 7
) -> DataFrame:
    """Pack every document's ids, with ``end_id`` behind them, into sequences.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A document is cut after every ``size`` ids, so only its
    last piece is shorter; each id lies in one piece and each piece in one sequence,
    without gaps. A null or empty text is the end id alone. Repeated rows are packed
    each for itself; other columns are ignored; an empty table gives no pieces.
    Groups are dealt by a hash of the piece and sorted before they are cut, so a
    task that runs again gives the same rows.
    """
    pieces = document_pieces(docs, vocabulary, size, end_id)
    dealt = pieces.withColumn(
        "deal", F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "doc_tokens")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        next_id = (task.partitionId() if task else 0) << 40
        held: list[pd.DataFrame] = []

        def pack() -> pd.DataFrame:
            nonlocal next_id
            group = pd.concat(held, ignore_index=True)
            held.clear()
            bins, offsets = first_fit_decreasing(group["length"].to_numpy(), size)
            group["sequence_id"], group["offset"] = bins + next_id, offsets
            next_id += int(bins.max()) + 1
            return group.drop(columns="deal")

        for batch in batches:
            while len(batch):
                room = GROUP_PIECES - sum(map(len, held))
                held.append(batch.iloc[:room])
                batch = batch.iloc[room:]
                if len(batch):
                    yield pack()
        if sum(map(len, held)):
            yield pack()

    order = ["deal", "doc_id", "start"]
    return (
        dealt.repartition("deal")
        .sortWithinPartitions(*order)
        .mapInPandas(
            run,
            pieces.schema.add("sequence_id", "long").add("offset", "long"),
        )
    )
