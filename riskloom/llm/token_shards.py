"""Token ids in binary shards with keyed access.

Documents are dealt into ranges of ascending ids; the task that gets a range
tokenizes its texts and appends the ids to one shard. Behind the raw ids lies an
index: a minimal perfect hash over the shard's keys gives every key a slot of its
own, and the slot holds a fingerprint of the key and the place of its records. A
lookup reads no other key, however many there are.

A shard, little-endian: magic and id width (16 bytes); ids; the index; its offset,
its length and magic (24 bytes). Only shards that the manifest names count: it is written
from the rows that finished tasks return, so what a lost attempt left is never read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_batches
from riskloom.llm.packing import byte_letters
from riskloom.session import ensure_checkpoint_dir

MAGIC = b"IDSHARD1"
#: Bits per key of a level of the hash; more bits mean fewer levels.
SPREAD = 2
#: Keys that so many levels leave colliding are listed in full.
LEVELS = 48
#: Words kept with their ids, in bytes of both, and the longest of them.
CACHE_BYTES, CACHE_WORD = 128 << 20, 48
WINDOW = 4 << 20


# --- words to ids -----------------------------------------------------------------


class QuickWords:
    """A word vocabulary as a table of ranks, for runs of letters below U+0100.

    There composing changes nothing and every letter has one lower case. The mark that
    ends a word becomes a byte of its own, which joins the byte before it first of all;
    the other merges keep their order. Tests hold the ids against the file's own library,
    which encodes all other runs.
    """

    #: Fixed value: the pieces that the vocabulary merges within.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END = "\x01"

    def __init__(self, spec: dict, width: int):
        import regex
        from tiktoken import Encoding

        model, byte = spec["model"], {c: b for b, c in enumerate(byte_letters())}
        suffix, end = model["end_of_word_suffix"], self.END.encode()

        def plain(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(byte[c] for c in token.removesuffix(suffix)) + end * ends

        single = [t for b, t in enumerate(byte_letters()) if b != end[0]]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ordered = [*single, *(t + suffix for t in single), *merged]
        self.ids = [model["vocab"][t].to_bytes(width, "little") for t in ordered]
        self.ids.append(b"")  # the mark alone, which never stays alone
        ranks = {plain(t): i for i, t in enumerate(ordered)}
        ranks.setdefault(end, len(ordered))
        self.encoding = Encoding("word_ends", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.mark = regex.compile(self.PIECES)
        self.unlike = regex.compile(r"[^\x02-\xff]|<\|")

    @classmethod
    def of(cls, spec: dict, width: int) -> QuickWords | None:
        model, steps = spec["model"], (spec["normalizer"] or {}).get("normalizers", [])
        pieces = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        fits = (
            model["type"] == "BPE"
            and model["end_of_word_suffix"]
            and not (model["dropout"] or model["unk_token"] or model["ignore_merges"] or model["byte_fallback"])
            and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in pieces] == ["Split", "ByteLevel"]
            and pieces[0]["pattern"].get("Regex") == cls.PIECES
            and pieces[0]["invert"]
            and not (pieces[1]["add_prefix_space"] or pieces[1]["use_regex"])
            and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        )
        return cls(spec, width) if fits else None

    def __call__(self, run: str) -> bytes | None:
        """Ids of a run, or None if it is not of these letters."""
        if self.unlike.search(run):
            return None
        marked = "".join([p + self.END for p in self.mark.findall(run.lower())])
        return b"".join([self.ids[i] for i in self.encoding.encode_ordinary(marked)])


class WordIds(dict):
    """Ids of runs between blanks as bytes of ``kind``; short runs are kept, up to CACHE_BYTES.

    The vocabulary's own pieces never cross a blank, so runs can be encoded one by one.
    """

    def __init__(self, library, kind: str, quick: QuickWords | None = None):
        super().__init__()
        self.library, self.kind, self.quick, self.held = library, kind, quick, 0

    def __missing__(self, word: str) -> bytes:
        found = self.quick(word) if self.quick and len(word) <= CACHE_WORD else None
        if found is None:
            found = np.array(self.library.encode(word, add_special_tokens=False).ids, self.kind).tobytes()
        if len(word) <= CACHE_WORD:
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[word] = found
            self.held += 200 + len(word) + len(found)
        return found


class Encoder:
    """Whole texts to ids. Texts are cut at blanks only where the vocabulary drops them."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.width = 2 if library.get_vocab_size() <= 1 << 16 else 4
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"] or {}]
        first = steps[0]
        # Only what the pattern matches is kept, and no match of this one holds a blank.
        self.drops_blanks = (
            first.get("type") == "Split"
            and first.get("behavior") == "Removed"
            and bool(first.get("invert"))
            and first["pattern"].get("Regex") == QuickWords.PIECES
            and not any(t["lstrip"] or t["rstrip"] or set(t["content"]) & {" ", "\n"} for t in spec["added_tokens"])
        )
        self.words = WordIds(library, f"<u{self.width}", QuickWords.of(spec, self.width))

    def ids(self, text: str) -> bytes:
        if not self.drops_blanks:
            found = self.words.library.encode(text, add_special_tokens=False).ids
            return np.array(found, self.words.kind).tobytes()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


# --- minimal perfect hash ---------------------------------------------------------


def key_hashes(keys: list) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key: one finds the slot, one is the fingerprint."""
    blob = b"".join(
        hashlib.blake2b(b"-" if k is None else b"=" + str(k).encode(), digest_size=16).digest() for k in keys
    )
    both = np.frombuffer(blob, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), (both[:, 1] & 0xFFFFFFFF).astype("<u4")


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Another hash of the hash for each level (Stafford's finaliser)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Levels of bits: a key's slot is the rank of the first bit that it owns.

    A key owns a bit of a level if no other key that came so far falls on it; the
    others go on to the next level.
    """

    sizes: np.ndarray
    words: np.ndarray
    rest: np.ndarray

    def __post_init__(self):
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes // 64)]).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """``hashes``: distinct 64-bit hashes of the keys."""
        sizes, words = [], []
        left = hashes
        while len(left) and len(sizes) < LEVELS:
            size = -(-SPREAD * len(left) // 64) * 64
            at = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            own = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(own, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~own[at]]
        return cls(
            np.array(sizes, "<u8").astype(np.int64),
            np.concatenate(words) if words else np.zeros(0, "<u8"),
            np.sort(left),
        )

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.rest)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for one that surely is no key."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                return out
            at = (_mixed(hashes[open_], level) % np.uint64(size)).astype(np.int64)
            word = self.words[self.starts[level] + at // 64]
            bit = (at % 64).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            rank = self.before[self.starts[level] + at // 64] + below
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            hit = self.rest[at] == hashes[open_]
            out[open_[hit]] = self.before[-1] + at[hit]
        return out


# --- shards -----------------------------------------------------------------------


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder: a URI of any scheme that Arrow opens, or a path."""
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


class ShardWriter:
    """Appends records in the order given; ``close`` writes the index behind them."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.keys, self.firsts, self.ends = [], [], [0]
        stream.write(MAGIC + struct.pack("<Q", width))

    def append(self, key, ids: bytes) -> None:
        """Records of one key follow one another."""
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
            self.firsts.append(len(self.ends) - 1)
        self.ends.append(self.ends[-1] + len(ids) // self.width)
        self.stream.write(ids)

    def close(self) -> int:
        """Bytes written."""
        hashes, prints = key_hashes(self.keys)
        index = PerfectHash.build(hashes)
        slot = index.slots(hashes)
        firsts = np.array([*self.firsts, len(self.ends) - 1], np.int64)
        fingerprint = np.zeros(len(slot), "<u4")
        first, count = np.zeros(len(slot), "<u8"), np.zeros(len(slot), "<u8")
        fingerprint[slot], first[slot], count[slot] = prints, firsts[:-1], np.diff(firsts)
        out = io.BytesIO()
        arrays = (
            index.sizes.astype("<u8"), index.words, index.rest.astype("<u8"), fingerprint, first, count,
            np.array(self.ends, "<u8"),
        )
        for a in arrays:
            out.write(struct.pack("<Q", len(a)) + a.tobytes())
        body = out.getvalue()
        at = 16 + self.ends[-1] * self.width
        self.stream.write(body + struct.pack("<QQ", at, len(body)) + MAGIC)
        self.stream.close()
        return at + len(body) + 24


class Shard:
    """Keyed access to one shard file."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        at, length, magic = struct.unpack("<QQ8s", file.read_at(24, end - 24))
        head = file.read_at(16, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError("not a complete shard of token ids")
        (self.width,) = struct.unpack("<Q", head[8:])
        body, place, arrays = file.read_at(length, at), 0, []
        for kind in ("<u8", "<u8", "<u8", "<u4", "<u8", "<u8", "<u8"):
            (n,) = struct.unpack_from("<Q", body, place)
            arrays.append(np.frombuffer(body, kind, n, place + 8))
            place += 8 + n * np.dtype(kind).itemsize
        sizes, words, rest, self.prints, self.first, self.count, ends = arrays
        self.index = PerfectHash(sizes.astype(np.int64), words, rest)
        self.ends = ends.astype(np.int64)
        self.window = (0, b"")

    def find(self, keys: list) -> list[tuple[int, int]]:
        """(first record, number of records) of each key; (0, 0) for a key that is not there."""
        hashes, prints = key_hashes(keys)
        slot = self.index.slots(hashes)
        if not len(self.prints):
            return [(0, 0)] * len(keys)
        there = (slot >= 0) & (self.prints[slot] == prints)
        return [
            (int(self.first[s]), int(self.count[s])) if ok else (0, 0)
            for s, ok in zip(slot.tolist(), there.tolist(), strict=True)
        ]

    def ids(self, record: int) -> np.ndarray:
        """Ids of a record; neighbours that are asked for next come with the same read."""
        a, b = (16 + int(x) * self.width for x in self.ends[record : record + 2])
        at, held = self.window
        if a < at or b > at + len(held):
            last = 16 + int(self.ends[-1]) * self.width
            self.window = at, held = a, self.file.read_at(min(max(b - a, WINDOW), last - a), a)
        return np.frombuffer(held, f"<u{self.width}", (b - a) // self.width, a - at)


# --- a store of shards ------------------------------------------------------------


@dataclass(frozen=True)
class TokenStore:
    """A folder of shards and its manifest: one row per shard, in ascending order."""

    spark: SparkSession
    folder: str

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """One row per record of each key in the one column of ``keys``: key, start, n_tokens, ids_crc32.

        ``start`` counts the ids of all records before it, the crc is that of the ids as
        unsigned 32-bit numbers. A key that is not there gives no row (but for one in
        2^32 whose fingerprint is that of another), one that is given twice gives its rows
        twice, and null is a key like others. The shard of a key comes from the manifest,
        of which every task gets its keys' bounds: a row per shard.
        """
        bounded_batches(self.spark, 4096)
        rows = self.manifest().orderBy("shard").collect()
        files = [r["file"] for r in rows]
        starts = np.concatenate([[0], np.cumsum([r["n_ids"] for r in rows])]).astype(np.int64).tolist()
        # Null comes before every key; an open range of shards without any other key ends at once.
        order = [(r["last_key"] is not None, r["last_key"]) for r in rows]
        lows = [(r["first_key"] is not None, r["first_key"]) for r in rows]
        table = self.spark.sparkContext.broadcast((files, starts, order, lows))
        folder, (name,) = self.folder, keys.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, starts, order, lows = table.value
            system, root = _file_system(folder)
            number, shard = -1, None
            for batch in batches:
                wanted: dict[int, list] = {}
                for key in batch.column(0).to_pylist():
                    mark = (key is not None, key)
                    s = bisect_left(order, mark)
                    while s < len(files) and lows[s] <= mark:
                        wanted.setdefault(s, []).append(key)
                        s += 1
                out: list[tuple] = []
                for s in sorted(wanted):
                    if s != number:
                        number, shard = s, Shard(system.open_input_file(f"{root}/{files[s]}"))
                    for key, (first, count) in zip(wanted[s], shard.find(wanted[s]), strict=True):
                        for record in range(first, first + count):
                            ids = shard.ids(record)
                            crc = zlib.crc32(ids.astype("<u4").tobytes())
                            out.append((key, starts[s] + int(shard.ends[record]), len(ids), crc))
                columns = list(zip(*out, strict=True)) or [()] * 4
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    [name, "start", "n_tokens", "ids_crc32"],
                )

        kind = keys.schema[name].dataType.simpleString()
        # Neighbouring keys meet in one task, which then opens few shards; copies are spread by the salt.
        dealt = keys.repartitionByRange(name, F.monotonically_increasing_id()).sortWithinPartitions(name)
        return dealt.mapInArrow(run, f"`{name}` {kind}, start long, n_tokens long, ids_crc32 long")


def write_token_shards(
    docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None
) -> TokenStore:
    """Write the ids of every whole text, each with ``end_id`` behind, in ascending doc_id order.

    A null or empty text is the end id alone; special strings inside a text count as the
    library does by default; null ids come first and are a key of their own; rows of one
    id follow one another by a hash of their text; other columns are ignored; an empty table
    gives a store without shards. Very long texts are read whole, one at a time. Equal
    ids may be dealt over several shards, so no id needs one task; texts are shuffled
    once, and a task holds an entry per document, not the ids. Folders that Arrow cannot
    open are refused when the first shard is made.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 128)
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    width = _encoder(vocabulary).width
    end = np.array([end_id], f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, file, first, n = None, None, None, 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    system, root = _file_system(folder)
                    system.create_dir(root, recursive=True)
                    # Another name for each attempt: a second one never meets the first one's file.
                    file = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                    writer = ShardWriter(system.open_output_stream(f"{root}/{file}"), width)
                    first = key
                text = text.as_py()
                writer.append(key, (_encoder(vocabulary).ids(text) if text else b"") + end)
                n += 1
        if writer is not None:
            size = writer.close()
            row = [TaskContext.get().partitionId(), file, n, writer.ends[-1], size, first, writer.keys[-1]]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 3, *[batch.schema.field(0).type] * 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                ["shard", "file", "n_records", "n_ids", "n_bytes", "first_key", "last_key"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    order = ["doc_id", "__like", "__row"]
    shards = (
        docs.select("doc_id", text.alias("text"))
        .withColumns({"__like": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(
            run,
            "shard long, file string, n_records long, n_ids long, n_bytes long, "
            f"first_key {kind}, last_key {kind}",
        )
    )
    shards.write.parquet(f"{folder}/manifest")
    return TokenStore(spark, folder)
