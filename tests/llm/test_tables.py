"""Operators over whole tables: joins, rules, mixing, search, and the pipeline."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from riskloom.llm.ann import fit_index, nearest
from riskloom.llm.components import connected_components
from riskloom.llm.mixing import document_hash, mix_sources, mixed_documents
from riskloom.llm.ngram_join import similar_groups
from riskloom.llm.signature_tree import SignatureTree, bitmaps, linked_pairs
from riskloom.llm.url_filter import filter_urls
from tests.llm.fixtures import SCHEMA, babble, empty_docs, near_copy, odd_docs, rows, shingles, words
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op3_url_filter", "op5_source_mixing"])
def test_query_equals_sql(spark, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(contract.oracle_sql()[name]).df()) is None


def groups_by_definition(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_similar_groups_by_definition(spark, monkeypatch):
    # Small nodes: groups of copies fill many of them, and links cross them.
    monkeypatch.setattr("riskloom.llm.ngram_join.NODE_SETS", 5)
    texts = []
    for g in range(6):
        base = babble(g, 30 + 60 * g)
        texts += [base, base.upper(), base + " end"]
        texts += [near_copy(base, 10 * g + k, k) for k in range(9)]
    passage = babble(99, 60)
    texts += [f"{babble(200 + i, 12)} {passage}" for i in range(25)]
    texts += [None, "", " ", "one two", "ONE two", "a b c d e", "a b c d e f", *[babble(300 + i, 40) for i in range(40)]]
    ids = [7 * i + 3 for i in range(len(texts))]
    docs = spark.createDataFrame(rows(texts, ids), SCHEMA)
    got = {r.doc_id: r for r in similar_groups(docs).collect()}
    want = groups_by_definition(dict(zip(ids, texts, strict=True)))
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingles(t)) for i, t in zip(ids, texts, strict=True))
    assert {i for i, r in got.items() if r.stays} == {i for i in ids if want[i] == i}


def test_similar_groups_odd_rows(spark):
    odd = odd_docs(spark)
    got = similar_groups(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[9] == by_id[10] == 9 or by_id[10] in (9, 10)
    assert by_id[5] == 5 and by_id[6] == 6 and by_id[7] == 7
    assert similar_groups(empty_docs(spark)).count() == 0


def test_signature_trees_find_every_pair():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**60, 60, dtype=np.uint64))
    sets = [np.sort(rng.choice(base, rng.integers(5, 50), replace=False)) for _ in range(150)]
    sizes = np.array([len(s) for s in sets])
    bits = bitmaps(sets)

    def feasible(overlap, lo_a, hi_a, lo_b, hi_b):
        return 180 * np.minimum(overlap, np.minimum(hi_a, hi_b)) >= 80 * (lo_a + lo_b)

    tree = SignatureTree.build(bits, sizes)
    found = set(zip(*(x.tolist() for x in linked_pairs(tree, tree, feasible)), strict=True))
    want = {
        (i, j)
        for i in range(150)
        for j in range(i + 1, 150)
        for k in [len(np.intersect1d(sets[i], sets[j]))]
        if 180 * k >= 80 * (len(sets[i]) + len(sets[j]))
    }
    assert found == want
    left, right = SignatureTree.build(bits[:9], sizes[:9]), SignatureTree.build(bits[9:], sizes[9:])
    found = set(zip(*(x.tolist() for x in linked_pairs(left, right, feasible)), strict=True))
    assert {(i, j + 9) for i, j in found} == {(i, j) for i, j in want if i < 9 <= j}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)]
    edges += [(200, 200), (None, 3), (300, None), (160, 161), (161, 160), (160, 161)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {160: 160, 161: 160}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_url_rules_follow_links(spark):
    link = '<html><link rel="canonical" href="{}"></html>'.format
    pages = [
        (1, "http://A.example.NET/de/1?x#y", None),  # block by net/
        (2, "https://x.example.net/en/2", None),  # allow by the longer rule
        (3, "http://alias.example.com/fr/3", link("http://b.example.net/de/3")),  # to a blocked target
        (4, "http://free.example.com/fr/4", None),
        (5, "http://one.example.com/fr/5", "<meta http-equiv=refresh content='0; url=http://two.example.org/fr/5'>"),
        (6, "http://one.example.com/fr/5?page=2", link("//three.example.net/xx")),  # mixed: allow wins
        (7, "http://w.example.com/de/7", link("http://four.example.org/fr/7")),  # own block stays
        (8, None, link("http://b.example.net/de/3")),
        (9, "no scheme/de/", ""),
        (10, "http://notexample.com/de/", None),
        (11, "http://example.com/de", None),
        (12, "http://alias.example.com/fr/3#again", None),  # same address as 3
        (13, "http://net", None),  # no path, so net/ does not fit
        (13, "http://net", None),
    ]
    df = spark.createDataFrame([(*p, "k", "v") for p in pages], "page_id long, url string, html string, key string, verdict string")
    redirects = spark.createDataFrame(
        [("http://free.example.com/fr/4", "http://alias.example.com/fr/3"), (None, "http://q/")],
        "from_url string, to_url string",
    )
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, redirects).collect()}
    assert got[1] == ("a.example.net", "/de/1", "net/", "block")
    assert got[2] == ("x.example.net", "/en/2", "example.net/en/", "allow")
    assert got[3] == ("alias.example.com", "/fr/3", None, "block")
    assert got[4][2:] == (None, "block") and got[12][2:] == (None, "block")
    assert got[5][2:] == (None, "allow") and got[6][2:] == (None, "allow")
    assert got[7][2:] == ("example.com/de/", "block")
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow")
    assert got[10][2:] == (None, "allow") and got[11][2:] == (None, "allow")
    assert got[13] == ("net", "", None, "allow")
    assert filter_urls(df, redirects).count() == len(pages)
    assert filter_urls(df).where("page_id = 4").first().verdict == "allow"
    assert filter_urls(df.limit(0)).count() == 0


def test_mixing_by_definition(spark):
    texts = [babble(i, 3 + i % 17) for i in range(400)] + [None, "", babble(1, 500)]
    sources = [["a", "b", None, "c", "d"][(i * 7 + i // 3) % 5] for i in range(400)] + ["a", "e", "f"]
    docs = spark.createDataFrame(rows(texts, sources=sources), SCHEMA)
    got = {r.doc_id: r for r in mix_sources(docs).collect()}
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: dict = {}
    while True:
        left = sum(sizes.values()) - sum(full.values())
        level = left / sum(w for s, w in weight.items() if s not in full)
        over = {s: 3 * sizes[s] for s in names if s not in full and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: full.get(s, level * weight[s]) for s in names}
    ordered = docs.select("doc_id", document_hash(docs["doc_id"]).alias("h")).collect()
    hashes = {r[0]: r[1] for r in ordered}
    taken = Counter()
    for i, (t, s) in enumerate(zip(texts, sources, strict=True)):
        r = got[i]
        assert (r.size, r.source_size) == (len(words(t)), sizes[s])
        assert abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken == r.size * r.copies <= 3 * r.size
        taken[s] += r.taken
    for s in names:
        mine = [i for i in got if sources[i] == s]
        largest = max(got[i].size for i in mine)
        assert abs(taken[s] - target[s]) <= largest / 2 + 1e-6
        # Nested: those taken once more are those of the smallest hashes.
        more = [hashes[i] for i in mine if got[i].copies == max(got[k].copies for k in mine)]
        less = [hashes[i] for i in mine if got[i].copies < max(got[k].copies for k in mine)]
        assert not less or max(more) < min(less)
    again = Counter(r.doc_id for r in mixed_documents(docs).collect())
    assert again == Counter({i: r.copies for i, r in got.items() if r.copies})
    assert mixed_documents(docs).columns == docs.columns
    odd = odd_docs(spark)
    assert mix_sources(odd).count() == odd.count()
    assert mix_sources(empty_docs(spark)).count() == 0
    assert mix_sources(spark.createDataFrame(rows([None, ""]), SCHEMA)).agg({"taken": "sum"}).first()[0] == 0


def test_mixing_without_ids_comes_as_near_to_its_targets(spark):
    texts = [babble(i, 10) for i in range(300)]
    docs = spark.createDataFrame(rows(texts, sources=["a"] * 200 + ["b"] * 100), SCHEMA)
    docs = docs.withColumn("doc_id", F.when(F.col("source") == "b", F.col("doc_id")))
    got = mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken - r.target) <= 5 for r in got.collect())
    assert mixed_documents(docs).where("source = 'a'").count() * 10 == got.where("source = 'a'").first().taken


def exact(vectors: dict, queries: list, k: int):
    out = {}
    for q in queries:
        scored = sorted(
            (-float(np.dot(np.float64(vectors[q]), np.float64(v))), i) for i, v in vectors.items() if i != q
        )
        out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest_vectors_recall_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    data = {i: (centres[i % 12] + 0.6 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(3000)}
    for i in range(2000, 2400):
        data[i] = data[2000]  # a very common vector
    good = [(i, v, "x") for i, v in data.items()]
    odd = [(4000, None, "x"), (4001, [0.0] * 16, "x"), (4002, [float("nan")] * 16, "x"), (None, [1.0] * 16, "x"),
           (4020, [float("inf")] + [0.0] * 15, "x"), (4003, [None] + [1.0] * 15, "x"), (4005, [], "x"), good[40]]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>, score string")
    queries = [i for i in data if i % 20 == 0]
    got: dict = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(queries)
    want = exact(data, queries, 20)
    hits = 0
    for q in queries:
        assert sorted(got[q]) == list(range(1, 21))
        found = [got[q][k] for k in range(1, 21)]
        assert all(abs(s - np.dot(np.float64(data[q]), np.float64(data[v]))) < 1e-9 for v, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in found} & set(want[q]))
    assert hits >= 0.9 * 20 * len(queries)
    # Of equal vectors those with the smallest ids are found.
    alike = [got[2000][k][0] for k in range(1, 21) if 2000 <= got[2000][k][0] < 2400]
    assert alike and alike == list(range(2001, 2001 + len(alike)))
    few = df.where("vec_id < 5")
    assert nearest(few, few.where("vec_id = 0"), 20).count() == 4
    assert nearest(df.limit(0), df, 20).count() == 0 and nearest(df, df.limit(0), 20).count() == 0


def test_lists_read_follow_the_index(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = {i: v.tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")
    queries = list(range(0, 6000, 60))
    got = nearest(df, df.where("vec_id % 60 = 0"), 20, probes=1).collect()
    want = exact(data, queries, 20)
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert hits >= 0.85 * 20 * len(queries)


@pytest.mark.parametrize("n", [60_000, 150_000])
def test_recall_on_large_tables(spark, tmp_path, n):
    """Vectors without any clusters, the hardest for an index: recall of the code itself."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    flat = pa.ListArray.from_arrays(np.arange(0, n * 64 + 1, 64, dtype=np.int32), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": flat}), f"{tmp_path}/v.parquet")
    df = spark.read.parquet(f"{tmp_path}/v.parquet")
    step = n // 200
    got = nearest(df, df.where(f"vec_id % {step} = 0"), 20).toPandas()
    asked = np.arange(0, n, step)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    want = {(int(q), int(v)) for q, row in zip(asked, best, strict=True) for v in row}
    assert len(got) == len(want)
    recall = len(want & set(zip(got.query_id, got.vec_id, strict=True))) / len(want)
    print(f"recall {recall:.4f} of {n} vectors")
    assert recall >= 0.9


def test_walks_find_the_nearest_centroids():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40_000, 32))
    index = fit_index(x, len(x), float(np.linalg.norm(x, axis=1).max()))
    points = index.lift_queries(rng.normal(size=(300, 32)))
    best, dist = index.near(points, 48)
    everything, gap = index.near(points, len(index.centroids))
    assert best.shape == (300, 48) and (best >= 0).all() and (np.diff(dist, axis=1) >= 0).all()
    assert all(len(set(row)) == 48 for row in best)
    np.testing.assert_allclose(dist, np.take_along_axis(
        gap, np.argsort(everything, axis=1), 1)[np.arange(300)[:, None], best])
    hits = sum(len(set(a) & set(b)) for a, b in zip(best, everything[:, :48], strict=True))
    assert hits >= 0.97 * best.size
    # Lists grow in number with the rows, not in length.
    assert len(index.centroids) > 250


def test_pipeline_stages(spark, tmp_path):
    good = [babble(i, 80) for i in range(60)]
    copies = [near_copy(good[0], k, 1) for k in range(5)] + [good[1], good[1].upper()]
    junk = [babble(500 + i, 50).upper().replace(" ", "!! ") for i in range(20)]
    texts = good + copies + junk
    sources = [f"s{i % 4}" for i in range(len(texts))]
    docs = spark.createDataFrame(rows(texts, sources=sources), SCHEMA)
    labels = [(i, int(i < 60), 0) for i in (*range(0, 60, 2), *range(67, 87, 2))]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "source_mixing", "packing"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    quality, unique, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    at = quality(spark, at, str(tmp_path))
    assert at.columns == docs.columns
    assert {r.doc_id for r in at.collect()} >= set(range(60)) - {1} and at.where("doc_id >= 67").count() == 0
    at = unique(spark, at, str(tmp_path))
    kept = {r.doc_id: r.text for r in at.collect()}
    stay = groups_by_definition({i: t for i, t in enumerate(texts[:67])})
    assert set(kept) == {i for i in stay if stay[i] == i} and at.columns == docs.columns
    at = mixed(spark, at, str(tmp_path))
    assert at.columns == docs.columns and set(r.doc_id for r in at.collect()) <= set(kept)
    pieces = packed(spark, at, str(tmp_path))
    assert pieces.agg({"length": "sum"}).first()[0] == sum(
        r.doc_tokens for r in pieces.where("start = 0").collect()
    )
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, pieces.drop("sequence_id", "offset").collect())
    )
