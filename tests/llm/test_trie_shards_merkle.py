"""Conversation trie, keyed token shards and the Merkle manifest, by plain definitions."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
from riskloom.llm import merkle, prefix_trie, token_shards
from riskloom.llm.radix_tree import RadixTree
from riskloom.llm.token_shards import PerfectHash, key_hashes, write_token_shards
from tests.llm.fixtures import SCHEMA, ascii_lower, empty_docs, odd_docs, rows
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id long, turn long, role string, text string, base long, key string, n int, words int"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(contract.oracle_sql()[name]).df()) is None


# --- radix tree and conversation trie ----------------------------------------------


def test_radix_tree_layouts_and_order():
    rng = random.Random(4)
    keys = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(9))) for _ in range(300)}
    for fan in (3, 5, 17, 49, 256):  # every layout
        keys |= {b"fan%d" % fan + bytes([b]) + b"rest" * 3 for b in range(fan)}
    tree, order = RadixTree(), list(keys)
    rng.shuffle(order)
    for key in order:
        tree.insert(key, key)
    found, path, layouts = [], bytearray(), set()
    for node, start, end, own in tree.walk():
        del path[start:]
        path += own
        assert len(path) == end
        layouts.add(node.layout)
        assert node.value is None or node.value == bytes(path)
        if node.value is not None:
            found.append(node.value)
    assert found == sorted(keys) and layouts == {0, 4, 16, 48, 256}


def trie_by_definition(turns):
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32]
            own[c].append(((t is not None, t or 0), tie, (r, x)))
    own = {c: [k[2] for k in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + t[h:])
    members, below = defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            below[s[:-1]].add(s)
    leaves, saved, out = {}, {}, []
    for s in sorted(members, key=len, reverse=True):
        m = members[s]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves[s] = sum(leaves[k] for k in below[s]) or 1
        saved[s] = sum(saved[k] for k in below[s]) + (len(m) - 1) * words
        ends = ",".join(str(c) for c in sorted(m) if seqs[c] == s)
        up = min(members[s[:-1]]) if s else None
        out.append(
            (min(m), len(s), up, len(m), len(below[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def trie(spark, turns):
    frame = spark.createDataFrame([(*t, 9, "k", 4, 2) for t in turns], TURNS)
    return sorted(map(tuple, prefix_trie.prefix_trie(frame).collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_trie_by_definition(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 3)
    # Chunks of few strings: most nodes lie on borders.
    run = prefix_trie._tries.__globals__
    monkeypatch.setitem(run, "CHUNK_KEYS", chunk)
    rng = random.Random(chunk)
    turns = [(None, 1, "u", "not there"), (5, None, None, None), (5, 3, "u", "x"), (5, 3, "u", "x")]
    for c in range(150):
        c = rng.choice([c, c, c, 10**12 + c, -c])
        for t in range(rng.choice([0, 1, 2, 3, 4, 9])):
            text = rng.choice([None, "", "a b  c", "only", str(rng.randrange(5)), "w " * 9_000])
            turns.append((c, rng.choice([t, t, None]), rng.choice(["u", "u", None]), text))
    # Exact copies, one very common first turn, and one very long conversation.
    turns += [(c, t, "u", f"same {t}") for c in range(1000, 1300) for t in range(3)]
    turns += [(c, 0, "u", "hello there") for c in range(2000, 2100)] + [(c, 1, "a", str(c % 7)) for c in range(2000, 2100)]
    turns += [(3000, t, "u", f"turn {t}") for t in range(700)] + [(3001, t, "u", f"turn {t}") for t in range(650)]
    assert trie(spark, turns) == trie_by_definition(turns)


def test_trie_of_nothing(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "u", "x")]) == []
    only = trie(spark, [(7, 1, "u", "a b")])
    assert only == trie_by_definition([(7, 1, "u", "a b")])


# --- token shards ------------------------------------------------------------------


def ids_by_library(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_shards_of_odd_rows_equal_the_library(spark):
    library, odd = Tokenizer.from_file(WORD_BPE), odd_docs(spark)
    tail = "'S DON'T x's " + "".join(map(chr, range(32, 1500))) + " <|endoftext|>'re áİΣ \x01\x02"
    docs = odd.unionByName(spark.createDataFrame(rows([tail, tail[::-1]], [900, 900]), SCHEMA)).cache()
    store = write_token_shards(docs, WORD_BPE)
    got = store.lookup(docs.select("doc_id").distinct()).collect()
    want = defaultdict(list)
    for r in docs.collect():
        ids = ids_by_library(library, r.text)
        want[r.doc_id].append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    start = 0
    for key in sorted(want, key=lambda k: (k is not None, k or 0)):
        mine = sorted((r for r in got if r.doc_id == key), key=lambda r: r.start)
        assert sorted((r.n_tokens, r.ids_crc32) for r in mine) == sorted(want[key])
        for r in mine:
            assert r.start == start
            start += r.n_tokens
    assert len(got) == docs.count()
    absent = spark.createDataFrame([(123456,), (-9,), (10,)], "doc_id long")
    assert {r.doc_id for r in store.lookup(absent).collect()} == {10}
    nothing = write_token_shards(empty_docs(spark), WORD_BPE)
    assert nothing.manifest().count() == 0 and nothing.lookup(absent).count() == 0


def test_one_id_in_many_shards_and_other_vocabularies(spark):
    texts = [f"t{i} word" for i in range(200)]
    docs = spark.createDataFrame(rows(texts, [7] * 150 + list(range(50))), SCHEMA).repartition(8)
    path = public_tokenizers.path("byte_bpe_50k.json")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        store = write_token_shards(docs, path, end_id=1)
    finally:
        spark.conf.unset(key)
    assert store.manifest().where("first_key <= 7 and last_key >= 7").count() > 1
    got = store.lookup(spark.createDataFrame([(7,)], "doc_id long")).collect()
    library = Tokenizer.from_file(path)
    want = sorted(len(library.encode(texts[i]).ids) + 1 for i in [*range(150), 157])
    assert sorted(r.n_tokens for r in got) == want
    named = spark.createDataFrame([("b", "x y"), ("a", "z"), (None, None)], "doc_id string, text string")
    out = write_token_shards(named, WORD_BPE).lookup(named.select("doc_id")).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == [None, "a", "b"]


def test_lost_attempts_leave_no_rows(spark, tmp_path):
    docs = spark.createDataFrame(rows(["one", "two"], [1, 2]), SCHEMA)
    store = write_token_shards(docs, WORD_BPE, folder=f"file://{tmp_path}/store")
    (tmp_path / "store" / "000000-lost.ids").write_bytes(b"half a shard")
    assert store.lookup(docs.select("doc_id")).count() == 2


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_perfect_hash_gives_each_key_its_own_slot(n):
    hashes, _ = key_hashes([*range(n - 1), None][:n])
    index = PerfectHash.build(hashes)
    assert len(index) == n and sorted(index.slots(hashes).tolist()) == list(range(n))
    strangers, _ = key_hashes([f"s{i}" for i in range(1000)])
    assert (index.slots(strangers) < max(n, 1)).all()


def test_perfect_hash_lists_what_keeps_colliding(monkeypatch):
    monkeypatch.setattr(token_shards, "LEVELS", 1)
    hashes, _ = key_hashes(list(range(500)))
    index = PerfectHash.build(hashes)
    assert len(index.rest) and sorted(index.slots(hashes).tolist()) == list(range(500))
    assert index.slots(np.array([1, 2, 3], np.uint64)).max() < 500


# --- Merkle manifest ---------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append((level[a:i], level[i + 1 : a + 8]))
        i //= 8
    return out


def manifest_by_definition(docs):
    leaves = defaultdict(list)
    for r in docs:
        head = [field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars)]
        own = sha(*head, field(r.text))
        low = sha(*head, field(None if r.text is None else ascii_lower(r.text)))
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        leaves[r.lang].append(((r.doc_id is not None, r.doc_id or 0), own, low if hit else own, r.doc_id))
    names = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        leaves[name].sort()
        trees[name] = levels_of([x[1] for x in leaves[name]])
    top = levels_of([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (_, leaf, changed, doc_id) in enumerate(leaves[name]):
            path = way(trees[name], i) + way(top, k)
            at = changed
            for left, right in path:
                at = sha(*left, at, *right)
            proof = sha(*[x for left, right in path for x in (*left, *right)])
            out.append((doc_id, leaf, trees[name][-1][0], top[-1][0], proof, at, at == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(docs):
    return sorted(map(tuple, merkle.manifest(docs).collect()), key=str)


def test_manifest_of_odd_rows(spark):
    odd = odd_docs(spark).cache()
    langs = odd.selectExpr("* except (lang)", "case pmod(doc_id, 3) when 0 then '' when 1 then 'Zé' end AS lang")
    assert manifest_rows(langs) == manifest_by_definition(langs.collect())
    assert merkle.manifest(empty_docs(spark)).collect() == []


def test_manifest_over_several_stored_levels(spark):
    # 8, 9, 64, 65, 512 and 513 leaves, one, and a group of several blocks; many groups beside.
    sizes = {"a": 8, "b": 9, "c": 64, "d": 65, "e": 512, "f": 513, "g": 1, "h": 4700}
    table, n = [], 0
    for lang, size in [*sizes.items(), *((f"x{i}", 1) for i in range(600))]:
        for _ in range(size):
            table.append((n, f"Text {n}", lang, "s" if n % 5 else None, n))
            n += 1
    random.Random(2).shuffle(table)
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_rows(docs) == manifest_by_definition(docs.collect())
