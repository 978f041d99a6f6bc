"""Token counts by a tokenizer compiled to a finite-state transducer.

The merges of a byte-pair vocabulary are compiled, as texts need them, into a
deterministic transducer: a state says which tokens may still end later and which
token the text so far ends with; a transition reads one symbol and emits the
change of the token count. White space leads from every state to the start state,
so a chunk of text has a short state map: its head (up to the first white space,
which depends on what came before), the count of its body, and its tail. Maps of
neighbouring chunks compose associatively; a tree of pairs scans them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.common import bounded_batches

CHUNK_BYTES = 1 << 16
_BREAK = re.compile(rb"[ \t-\r]")


class BpeTransducer:
    """Emits token counts of pieces; states and transitions are made when first met.

    After ``max_states`` states the table starts anew, which bounds memory and
    changes no result. It rests on two facts of byte-pair encoding: a token
    sequence is the encoding of its text if and only if every two neighbours are
    the encoding of their own text, and encodings of prefixes by whole tokens are
    prefixes. So among the tokens that may end at a symbol exactly one fits the
    token before it.
    """

    def __init__(
        self, merges: list[tuple[str, str]], alphabet: list[str], suffix: str, max_states=400_000
    ):
        self.suffix = suffix
        self.max_states = max_states
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.text: dict[str, tuple[str, ...]] = {a: (a,) for a in alphabet}
        for a, b in merges:
            self.text.setdefault(a + b, self.text[a] + self.text[b])
        # A trie over symbols; a node's token, if any, is encoded as itself.
        self.child: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for token, symbols in self.text.items():
            at = 0
            for s in symbols:
                if s not in self.child[at]:
                    self.child[at][s] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                at = self.child[at][s]
            self.token[at] = token
        self.fits: dict[tuple[str | None, str], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.number = {self.states[0]: 0}
        self.step: list[dict[str, tuple[int, int]]] = [{}]

    def encode(self, symbols: tuple[str, ...]) -> list[str]:
        """Merge the lowest-ranked pair first, leftmost first: the definition."""
        out = list(symbols)
        while len(out) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(out, out[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            out[i : i + 2] = [out[i] + out[i + 1]]
        return out

    def _fit(self, last: str | None, token: str) -> bool:
        if (last, token) in self.rank:  # the two would have become one token
            return False
        known = self.fits.get((last, token))
        if known is None:
            before = () if last is None else self.text[last]
            whole = [token] if last is None else [last, token]
            known = self.encode(before + self.text[token]) == whole
            if len(self.fits) > 4 * self.max_states:
                self.fits.clear()
            self.fits[last, token] = known
        return known

    def _make(self, state: int, symbol: str) -> tuple[int, int]:
        alive, ended, emitted = [], None, 0
        for node, last, ago in self.states[state]:
            at = self.child[node].get(symbol)
            if at is None:
                continue
            token = self.token[at]
            if token is not None and ended is None and self._fit(last, token):
                ended, emitted = token, ago + 1
            if self.child[at]:
                alive.append((at, last, ago))
        if ended is None:
            raise ValueError(f"no token of the vocabulary ends with {symbol!r}")
        # Counts are kept relative to the newest position, so states stay finite.
        new = (*((at, last, ago - emitted) for at, last, ago in alive), (0, ended, 0))
        number = self.number.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
            self.step.append({})
        self.step[state][symbol] = (number, emitted)
        return number, emitted

    def count(self, piece: str) -> int:
        if not piece:
            return 0
        if len(self.states) > self.max_states:
            self._restart()
        state, n, step = 0, 0, self.step
        for symbol in piece[:-1]:
            move = step[state].get(symbol) or self._make(state, symbol)
            state = move[0]
            n += move[1]
        last = piece[-1] + self.suffix
        return n + (step[state].get(last) or self._make(state, last))[1]


@dataclass(frozen=True)
class StateMap:
    """What a chunk does to any state: without a break, ``head`` is the whole chunk."""

    head: bytes
    count: int
    tail: bytes
    broken: bool


class TokenCounter:
    """Counts of whole texts; ``path`` names a byte-level BPE file with dropped white space."""

    def __init__(self, path: str, max_words: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        first = spec["pre_tokenizer"]
        first = first.get("pretokenizers", [first])[0]
        if (first["type"], first.get("behavior"), first.get("invert")) != ("Split", "Removed", True):
            raise ValueError("white space must end every token of this vocabulary")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        suffix = model["end_of_word_suffix"] or ""
        made = {a + b for a, b in merges}
        self.transducer = BpeTransducer(
            merges, [t for t in model["vocab"] if t not in made], suffix
        )
        library = Tokenizer.from_file(path)
        self.normal = library.normalizer.normalize_str if library.normalizer else lambda s: s
        self.pieces = library.pre_tokenizer.pre_tokenize_str
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words: dict[bytes, int] = {}
        self.max_words = max_words

    def _word(self, word: bytes) -> int:
        text, n = word.decode(), 0
        parts = [text]
        if self.special and self.special.search(text):
            n = len(self.special.findall(text))
            parts = self.special.split(text)
        for part in parts:
            for piece, _ in self.pieces(self.normal(part)) if part else ():
                n += self.transducer.count(piece)
        if len(self.words) >= self.max_words:
            self.words.clear()
        self.words[word] = n
        return n

    def between_breaks(self, data: bytes) -> int:
        """Tokens of text that starts and ends at breaks; words met before are looked up."""
        known, n = self.words, 0
        for word in data.split():
            c = known.get(word)
            n += self._word(word) if c is None else c
        return n

    def state_map(self, chunk: bytes) -> StateMap:
        first = _BREAK.search(chunk)
        if first is None:
            return StateMap(chunk, 0, b"", False)
        end = max(chunk.rfind(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
        return StateMap(
            chunk[: first.start()],
            self.between_breaks(chunk[first.start() : end]),
            chunk[end + 1 :],
            True,
        )

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if not a.broken:
            return StateMap(a.head + b.head, b.count, b.tail, b.broken)
        if not b.broken:
            return StateMap(a.head, a.count, a.tail + b.head, True)
        across = self.between_breaks(a.tail + b.head)
        return StateMap(a.head, a.count + across + b.count, b.tail, True)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """Compose neighbours pairwise, level by level."""
        while len(maps) > 1:
            maps = [
                self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i]
                for i in range(0, len(maps), 2)
            ]
        return maps[0]

    def count(self, data: bytes) -> int:
        if len(data) <= CHUNK_BYTES:
            return self.between_breaks(data)
        # Chunks may cut a character: words are decoded only when whole.
        whole = self.scan(
            [
                self.state_map(data[i : i + CHUNK_BYTES])
                for i in range(0, len(data), CHUNK_BYTES)
            ]
        )
        return self.between_breaks(whole.head) + whole.count + self.between_breaks(whole.tail)


@cache
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the path of a byte-level BPE file in JSON, the same on every
    machine. Counts are those of the file's library without begin and end tokens;
    a special token's text counts as that token. A null or empty text has no
    bytes and no tokens. One row comes out for each row that goes in, repeats
    included; other columns are ignored; an empty table gives an empty result.
    Nothing is shuffled, and a lost task is simply run again.
    """
    bounded_batches(docs.sparkSession, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            data = [b"" if x is None else x for x in texts.to_pylist()]
            tokens = [counter.count(x) for x in data]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, data), pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
