"""Operators that read each text: tokens, packing, licenses, fingerprints, models."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import ngram_lm, quality
from riskloom.llm.fingerprints import _edges, fingerprint_documents, with_next
from riskloom.llm.license_scan import PHRASES, TEMPLATES, scan_licenses, words_of
from riskloom.llm.ngram_lm import discounts, score_held_out
from riskloom.llm.packing import Tokens, first_fit_decreasing, pack_documents
from riskloom.llm.quality import drawn_documents, fit_resampler, kth_largest, resample
from riskloom.llm.token_counts import TokenCounter, count_tokens
from riskloom.llm.wordhash import SEGMENT, SIGNS, segments, word_hashes
from tests.llm.fixtures import SCHEMA, babble, empty_docs, odd_docs, odd_texts, rows, shingles, words

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_docs(spark).cache()


def test_token_counts_equal_the_library(spark, odd):
    library = Tokenizer.from_file(WORD_BPE)
    got = count_tokens(odd, WORD_BPE, 10).collect()
    texts = odd.select("doc_id", "text").collect()
    want = sorted(
        (
            (r[0] is None, r[0] or 0, len((r[1] or "").encode()), n, n > 10)
            for r in texts
            for n in [len(library.encode(r[1] or "", add_special_tokens=False).ids)]
        )
    )
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3]) for r in got) == want
    assert count_tokens(empty_docs(spark), WORD_BPE).count() == 0


def test_chunk_maps_compose_to_the_whole(monkeypatch):
    counter = TokenCounter(WORD_BPE)
    library = Tokenizer.from_file(WORD_BPE)
    text = " ".join(t or "" for t in odd_texts()[:-1]) + " " + "abc" * 40 + babble(3, 80)
    want = len(library.encode(text, add_special_tokens=False).ids)
    for size in (1, 3, 7, 50, 10_000):
        monkeypatch.setattr("riskloom.llm.token_counts.CHUNK_BYTES", size)
        assert counter.count(text.encode()) == want
    counter.transducer.max_states = 3  # the table starts anew again and again
    counter.words.clear()
    assert counter.count(text.encode()) == want


def test_quick_tokens_equal_the_library():
    own, library = Tokens(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    assert own.quick is not None
    for text in [t for t in odd_texts() if t] + [" " * 3000 + "x", "a\n \nb", "x  y "]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), "<u4").tolist() == want
    own.quick = None
    assert np.frombuffer(own.ids("a b"), "<u4").tolist() == library.encode("a b").ids


def test_first_fit_decreasing_by_definition():
    lengths = np.random.default_rng(1).integers(1, 40, 300)
    bins, offsets = first_fit_decreasing(lengths, 64)
    used: list[int] = []
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        b = next((k for k, u in enumerate(used) if u + lengths[i] <= 64), len(used))
        if b == len(used):
            used.append(0)
        assert (bins[i], offsets[i]) == (b, used[b])
        used[b] += lengths[i]


def test_packing_round_trip(spark, odd):
    library = Tokenizer.from_file(BYTE_BPE)
    pieces = pack_documents(odd, BYTE_BPE, 64).collect()
    by_sequence, by_doc = defaultdict(list), Counter()
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[(p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens)] += 1
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 64):
            part = np.array(ids[s : s + 64], "<u4").tobytes()
            want[(r[0], s, len(part) // 4, zlib.crc32(part), len(ids))] += 1
    assert by_doc == want
    assert pack_documents(empty_docs(spark), BYTE_BPE).count() == 0
    again = pack_documents(odd, BYTE_BPE, 64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, pieces))


def test_license_scan_by_definition(spark):
    texts = odd_texts() + [
        "All rights reserved. ALL-RIGHTS-RESERVED all rights x reserved",
        "x " * 500 + "Licensed under CC BY-NC 4.0. " + "y " * 500 + "cc by",
        "Released under the very MIT kind License",
        "the license under which the apache 2.0",
        "Permission is hereby granted, free of charge, to any one obtaining a copy of this "
        "software and its documentation files, to deal in the Software without restriction",
    ]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    for i, text in enumerate(texts):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)
        places = [
            (k, label)
            for phrase, label in PHRASES
            for k in range(len(w))
            if w[k : k + len(phrase.split())] == phrase.split()
        ]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert r.first_word == min((k for k, _ in places), default=None)
        assert r.last_word == max((k for k, _ in places), default=None)
        base = {label for _, label in places}
        assert r.base_labels == ",".join(sorted(base))
        assert base <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    n = len(odd_texts())
    assert got[n].labels == "reserved" and got[n + 1].labels == "cc-by,cc-by-nc"
    assert got[n + 2].labels == "mit" and got[n + 3].labels == ""
    assert got[n + 4].labels == "mit" and 0.8 <= got[n + 4].score < 1
    assert scan_licenses(empty_docs(spark)).count() == 0


def test_license_templates_by_definition_at_every_offset(spark):
    notice = "released aa bb cc under dd ee ff the mit"
    texts = [" ".join(["w"] * k) + " " + notice + tail for k in range(8) for tail in ("", " x y", " License z")]
    texts += ["released under " * 3 + "the", "mit " * 9, "License the mit released", "under the mit released under the"]
    rng = random.Random(6)
    vocabulary_ = "released under the mit license all rights reserved version 2 apache licensed this work is x y z".split()
    texts += [" ".join(rng.choice(vocabulary_) for _ in range(rng.randrange(60))) for _ in range(120)]
    # A long text beyond two segments, cut by other blanks only, with one notice at its end.
    texts.append(" " + "pad\n" * (2 * SEGMENT // 4 + 99) + notice.replace(" ", "\n"))
    extra = [*TEMPLATES, ("mit", TEMPLATES[6][1]), ("twice", "all all rights rights reserved")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows(texts), SCHEMA), PHRASES, extra).collect()}
    assert all("mit" in got[i].labels.split(",") for i in range(24))
    for i, text in enumerate(texts):
        w = words_of(text)
        found, best = set(), 0.0
        for label, template in extra:
            own = words_of(template)
            size, length = len(set(own)), 2 * len(own)
            starts = [k for k, x in enumerate(w) if x in own]
            most = max((len({x for x in w[k : k + length] if x in own}) for k in starts), default=0)
            if most / size >= 0.8 - 1e-12:
                found.add(label)
                best = max(best, most / size)
        r = got[i]
        assert set(r.labels.split(",")) - {""} == found | (set(r.base_labels.split(",")) - {""}), (i, text[:200])
        assert r.score == pytest.approx(1.0 if r.n_base else best)


def test_fingerprints_by_definition(spark, odd):
    texts = [None, "", "one", "a b c d e f", *[babble(i, 40 * i + 3) for i in range(1, 12)]]
    texts += [texts[-1], texts[-1] + " tail"]
    ids = [3 * i + 1 for i in range(len(texts))]
    got = {r.doc_id: r for r in fingerprint_documents(spark.createDataFrame(rows(texts, ids), SCHEMA)).collect()}
    order = sorted(ids, reverse=True)
    text = dict(zip(ids, [t or "" for t in texts], strict=True))

    def jaccard(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, i in enumerate(order):
        after = text[order[(k + 1) % len(order)]]
        cut = len(text[i]) // 3
        edited = text[i][: len(text[i]) - cut] + after[:cut]
        r = got[i]
        assert r.n_chars == len(text[i])
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(text[i], edited)) < 0.2
        assert abs(r.near_next - jaccard(text[i], after)) < 0.2
    assert got[ids[-3]].fingerprint == got[ids[-2]].fingerprint != got[ids[-4]].fingerprint
    assert got[ids[0]].fingerprint == "" and len(got[ids[-1]].fingerprint) == 256
    assert fingerprint_documents(odd).count() == odd.count()
    assert fingerprint_documents(empty_docs(spark)).count() == 0
    one = fingerprint_documents(spark.createDataFrame(rows(["a b c d e f g h i"]), SCHEMA)).first()
    assert one.near_next == 1.0


def test_next_document_across_many_ranges(spark, monkeypatch):
    monkeypatch.setattr("riskloom.llm.fingerprints.RANGE_ROWS", 4)
    ids = [i * i for i in range(60)]
    texts = [f"t{i} " * 9 for i in ids]
    got = fingerprint_documents(spark.createDataFrame(rows(texts, ids), SCHEMA)).collect()
    assert len(got) == 60
    for r in got:
        i = ids.index(r.doc_id)
        own, after = texts[i], texts[i - 1]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_next_document_for_ids_of_any_kind(spark, monkeypatch):
    monkeypatch.setattr("riskloom.llm.fingerprints.RANGE_ROWS", 8)
    plain = [*range(200), 1 << 40, (1 << 62) + 1, 1 << 62, -(1 << 62) - 5]
    hot, unknown = [77] * 120, [None] * 100
    ids = plain + hot + unknown
    texts = [f"t{i} " * 9 for i in range(len(ids))]
    docs = spark.createDataFrame(rows(texts, ids), SCHEMA).select("doc_id", "text")
    paired = with_next(docs, {}).collect()
    assert sorted(r.text for r in paired) == sorted(texts)
    # Following the next rows visits every row once, by descending id, null ids last.
    follows = {r.text: r.next.text for r in paired}
    id_of = dict(zip(texts, ids, strict=True))
    at = next(t for t in texts if id_of[t] == (1 << 62) + 1)
    walk = []
    for _ in texts:
        walk.append(id_of[at])
        at = follows[at]
    assert walk == sorted((i for i in ids if i is not None), reverse=True) + unknown
    # An outlier, a hot id and rows without id leave no range with many rows.
    edges, unknown_ranges = _edges(docs)
    assert len(edges) > 30 and unknown_ranges > 8
    place = [sum(e < i for e in edges) for i in plain]
    assert max(place.count(k) for k in place) < 40
    same = spark.createDataFrame(rows(["a b", "a b", "a b"], [None, None, 3]), SCHEMA)
    assert [r.next.text for r in with_next(same.select("doc_id", "text"), {}).collect()] == ["a b"] * 3


def test_quality_keeps_clean_and_drops_junk(spark, odd):
    good = [babble(i, 60) for i in range(120)]
    junk = [babble(i, 60).upper().replace(" ", "!! ") for i in range(500, 530)]
    docs = spark.createDataFrame(rows(good + junk + odd_texts()), SCHEMA)
    labels = spark.createDataFrame(
        [(i, int(i is None or i < 120), 0) for i in [*range(0, 150, 2), None]], "doc_id long, quality int, toxic int"
    )
    model = fit_resampler(docs, labels)
    kept = {r.doc_id: r.kept for r in resample(docs, model).collect()}
    assert len(kept) == 150 + len(odd_texts())
    assert all(kept[i] for i in range(120)) and not any(kept[i] for i in range(120, 150))
    drawn = drawn_documents(docs, model)
    assert drawn.columns == docs.columns
    assert sorted(r.doc_id for r in drawn.select("doc_id").collect()) == sorted(i for i in kept if kept[i])
    assert resample(docs, model, 10).where("kept").count() == 10
    none = labels.where("false")
    assert resample(odd, fit_resampler(odd, none)).where("kept").count() == odd.count()
    assert resample(empty_docs(spark), fit_resampler(empty_docs(spark), labels)).count() == 0


def test_kth_largest_with_ties(spark):
    values = [0.5, 0.5, 0.5, -3.0, 8.25, 1e9, 0.5, 2.0]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k, want in enumerate(sorted(values, reverse=True), 1):
        assert kth_largest(keys, k, bins=3, rounds=2) == want
    assert kth_largest(keys, 0) is None


def test_scores_do_not_depend_on_company():
    texts = [babble(i, 50).encode() for i in range(5)] + [b""]
    ratio = np.random.default_rng(0).normal(size=quality.BUCKETS)
    together = quality.text_scores(texts, ratio)[1]
    assert [quality.text_scores([t], ratio)[1][0] for t in texts] == together.tolist()


def test_long_texts_are_cut_at_any_blank():
    plain = b"\n".join(b"w%d" % i for i in range(2 * SEGMENT // 6))
    assert len(plain) > 2 * SEGMENT
    dense = "\u6587".encode() * SEGMENT  # one word of three segments
    for text in (b" " + plain, b"hi " + plain, plain.replace(b"\n", b"\t"), b" " + dense, b"a " + dense + b"\vb"):
        parts = []
        for part in segments(text):
            parts.append(part)
            assert part and len(parts) < 9
        assert b"".join(parts) == text
        assert [w for p in parts for w in p.split()] == text.split()
    parts = list(segments(b" " + plain))
    assert len(parts) > 2 and max(map(len, parts)) <= SEGMENT
    some = [b"a b", b"hi " + plain, b"", b" " + dense, b"c"]
    hashes, ends, _ = word_hashes(some, True)
    assert list(ends) == list(np.cumsum([len(t.split()) for t in some]))
    assert hashes[2] == word_hashes([b"hi"], True)[0][0]
    last = plain.rsplit(b"\n", 1)[1]
    assert hashes[ends[1] - 1] == word_hashes([last], True)[0][0]
    assert len(word_hashes([b" " + plain], False, between=SIGNS)[0]) == len(plain.split())


def test_language_model_by_definition(spark, odd):
    texts = [babble(i, 30 + i, 60) for i in range(60)] + [None, "", "unseen words only", "w1 w1 w1"]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: r for r in score_held_out(docs).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    seen, pairs = Counter(), Counter()
    for i, t in enumerate(texts):
        if not out[i]:
            w = [*words(t), "end"]
            seen.update(w)
            pairs.update(zip(["start", *w[:-1]], w, strict=True))
    places, behind = Counter(w for _, w in pairs), defaultdict(Counter)
    for (u, _), c in pairs.items():
        behind[u]["all"] += c
        behind[u][min(c, 3)] += 1

    def counts(values):
        return [sum(v == k for v in values) for k in (1, 2, 3, 4)]

    d, e = discounts(counts(pairs.values())), discounts(counts(places.values()))
    total, kinds = sum(seen.values()), len(seen)
    spare = sum(e[min(c, 3) - 1] for c in places.values()) / len(pairs)

    def lower(w):
        c = places[w]
        return (max(c - e[min(c, 3) - 1], 0) / len(pairs) if c else 0) + spare / (kinds + 1)

    def p(u, w):
        if u not in behind:
            return lower(w)
        c, b = pairs[(u, w)], behind[u]
        own = max(c - d[min(c, 3) - 1], 0) if c else 0
        return (own + sum(d[k - 1] * b[k] for k in (1, 2, 3)) * lower(w)) / b["all"]

    assert math.isclose(sum(lower(w) for w in seen) + spare / (kinds + 1), 1)
    assert math.isclose(sum(p(b"w1", w) for w in seen) + p(b"w1", "?"), 1)
    for i, t in enumerate(texts):
        w, r = [*words(t), "end"], got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[i], len(w), total)
        assert r.n_known == sum(x in seen for x in w)
        assert math.isclose(r.score, sum(math.log10(p(*x)) for x in zip(["start", *w[:-1]], w, strict=True)))
        base = sum(math.log10((seen[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        assert math.isclose(r.base_score, base)
    assert score_held_out(odd).count() == odd.count()
    assert score_held_out(empty_docs(spark)).count() == 0


def test_language_model_shards_grow_with_the_text(spark, monkeypatch):
    texts = [f"a{i % 7} b{i % 5} the the c{i} d{i % 3} e " * 3 for i in range(80)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    few = {r["doc_id"]: r for r in score_held_out(docs).collect()}
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ngram_lm.shard_numbers(docs) == (least, least)
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", 100)
    assert ngram_lm.shard_numbers(docs)[0] > 4 * least
    many = {r["doc_id"]: r for r in score_held_out(docs).collect()}
    assert len(many) == len(few) == 80
    for i, row in few.items():
        assert many[i]["n_known"] == row["n_known"]
        assert many[i]["score"] == pytest.approx(row["score"], rel=1e-12)
        assert many[i]["base_score"] == pytest.approx(row["base_score"], rel=1e-12)
