"""License scan: exact containment join of text blocks with license templates.

A template's words are ordered by their frequency in the whole corpus, rarest
first. A block that holds enough of a template must hold one of its first words
(prefix filter) behind its start (positional filter) and as many words of the
template as are needed (length filter); what is left is counted exactly. A block is
twice as long as its template and starts at any word of the template in the text: no
other block can hold more, so a notice is found wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.common import bounded_batches
from riskloom.llm.wordhash import SIGNS, word_hashes

#: Phrases that count wherever their words stand one after another.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Usual notices of public licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, "
        "are permitted provided that the following conditions are met",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[str]:
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return _WORD.findall(folded)


class Scanner:
    """Phrases and templates prepared for one order of words."""

    def __init__(
        self,
        phrases: Sequence[tuple[str, str]],
        templates: Sequence[tuple[str, str]],
        threshold: float,
        frequency: Mapping[str, int],
    ):
        self.words = vocabulary(phrases, templates)
        hashes, _, _ = word_hashes([w.encode() for w in self.words], True, between=SIGNS)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        number = {w: i for i, w in enumerate(self.words)}
        self.phrases = [([number[w] for w in words_of(p)], label) for p, label in phrases]
        self.templates = []
        # Templates by their first words: a text is held only against those it may contain.
        self.by_first: dict[int, list[int]] = {}
        for label, text in templates:
            words = words_of(text)
            ordered = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
            need = int(np.ceil(round(threshold * len(ordered), 9)))
            ids = np.array([number[w] for w in ordered], np.int64)
            by_number = np.argsort(ids)
            for first in ids[: len(ids) - need + 1].tolist():
                self.by_first.setdefault(first, []).append(len(self.templates))
            self.templates.append((label, ids[by_number], by_number, need, len(words)))
        self.firsts = np.array(sorted(self.by_first), np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of vocabulary words in a run of word hashes, and their numbers."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        here = np.flatnonzero(self.hashes[at] == hashes)
        return here, self.order[at[here]]

    def places(self, where: np.ndarray, what: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """Starts of each phrase."""
        out = []
        for numbers, label in self.phrases:
            starts = where[what == numbers[0]]
            for k, number in enumerate(numbers[1:], 1):
                starts = starts[np.isin(starts + k, where[what == number])]
            out.append((starts, label))
        return out

    def containment(self, where: np.ndarray, what: np.ndarray) -> list[tuple[float, str]]:
        """Largest containment of each template found in any block, if it is enough."""
        present = np.intersect1d(what, self.firsts)
        hopeful = sorted({t for first in present.tolist() for t in self.by_first[first]})
        out = []
        for label, ids, ranks, need, width in (self.templates[t] for t in hopeful):
            at = np.minimum(np.searchsorted(ids, what), len(ids) - 1)
            mine = ids[at] == what
            most = _most_distinct(where[mine], ranks[at[mine]], need, len(ids), 2 * width)
            if most >= need:
                out.append((most / len(ids), label))
        return out


def _most_distinct(spot: np.ndarray, place: np.ndarray, need: int, size: int, length: int) -> int:
    """Most distinct words of a template in a block of ``length`` words, if it is ``need`` or more.

    ``spot``: where words of the template stand, ascending; ``place``: their places in its
    order, rarest first. Blocks that cannot reach ``need`` may count as 0.
    """
    ends = np.searchsorted(spot, spot + length)
    # Prefix filter: the next of the first words must lie in the block. Length filter: so many words.
    first = np.flatnonzero(place <= size - need)
    if not len(first):
        return 0
    after = np.searchsorted(first, np.arange(len(spot)))
    near = first[np.minimum(after, len(first) - 1)]
    starts = np.flatnonzero((after < len(first)) & (near < ends) & (ends - np.arange(len(spot)) >= need))
    order = np.argsort(place, kind="stable")
    before = np.full(len(spot), -1, np.int64)
    same = place[order[1:]] == place[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    best = 0
    for at in range(0, len(starts), 16_384):  # at most ``length`` words each
        some = starts[at : at + 16_384]
        sizes = ends[some] - some
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        word = np.arange(sizes.sum()) - np.repeat(offsets - some, sizes)
        # A word counts where it stands in the block for the first time.
        new = before[word] < np.repeat(some, sizes)
        best = max(best, int(np.add.reduceat(new.astype(np.int64), offsets).max()))
    return best


def vocabulary(
    phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]
) -> list[str]:
    return sorted({w for p, _ in phrases for w in words_of(p)} | {w for _, t in templates for w in words_of(t)})


def _documents(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    texts = batch.column(column).cast(pa.large_binary()).to_pylist()
    hashes, ends, _ = word_hashes([t or b"" for t in texts], True, between=SIGNS)
    return hashes, ends


def word_frequencies(docs: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """How often each of the given words occurs in all documents."""
    bounded_batches(docs.sparkSession, 128)
    words = list(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner([(w, w) for w in words], (), 1.0, {})
        total = np.zeros(len(scanner.words), np.int64)
        for batch in batches:
            _, what = scanner.find(_documents(batch, 0)[0])
            total += np.bincount(what, minlength=len(total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(scanner.words), pa.array(total)], ["word", "n"]
        )

    counted = docs.select(docs["text"].cast("string")).mapInArrow(run, "word string, n long")
    # One row for each word of the templates.
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}


def scan_licenses(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """Find license phrases and templates in every whole text.

    Returns one row per row of ``docs``: doc_id, n_words, n_base (places of phrases),
    first_word and last_word (smallest and largest start; null without any),
    base_labels, labels (also those of templates of which a block holds the share
    ``threshold`` of distinct words), score (1 if a phrase was found, else the
    largest containment that reached the threshold, else 0). Words are runs of ASCII
    letters and digits and of all other signs beyond ASCII, A-Z taken as a-z. A template
    may be given twice or share words with others; very long texts are read whole, in
    segments. Labels are distinct, sorted and joined by commas, empty without any. A null text is
    empty; repeated rows give repeated rows; other columns are ignored; an empty
    table gives an empty result. Templates are few and fixed, so they go to every
    task and no document is shuffled.
    """
    frequency = word_frequencies(docs, vocabulary(phrases, templates))
    bounded_batches(docs.sparkSession, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, threshold, frequency)
        for batch in batches:
            hashes, ends = _documents(batch, 1)
            where, what = scanner.find(hashes)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
            lo, hi = np.searchsorted(where, starts), np.searchsorted(where, ends)
            rows = []
            for start, end, a, b in zip(starts.tolist(), ends.tolist(), lo, hi, strict=True):
                own, numbers = where[a:b] - start, what[a:b]
                found = [(s, label) for s, label in scanner.places(own, numbers) if len(s)]
                like = scanner.containment(own, numbers)
                base = {label for _, label in found}
                rows.append(
                    (
                        end - start,
                        sum(len(s) for s, _ in found),
                        min((int(s.min()) for s, _ in found), default=None),
                        max((int(s.max()) for s, _ in found), default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | {label for _, label in like})),
                        1.0 if found else max((c for c, _ in like), default=0.0),
                    )
                )
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", *_COLUMNS],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double",
    )


_COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
