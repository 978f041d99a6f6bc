"""One registered query per operator, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.ann import nearest
from riskloom.llm.common import table
from riskloom.llm.fingerprints import fingerprint_documents
from riskloom.llm.license_scan import scan_licenses
from riskloom.llm.merkle import manifest
from riskloom.llm.mixing import mix_sources
from riskloom.llm.ngram_join import similar_groups
from riskloom.llm.ngram_lm import score_held_out
from riskloom.llm.packing import pack_documents
from riskloom.llm.prefix_trie import prefix_trie
from riskloom.llm.quality import fit_resampler, resample
from riskloom.llm.token_counts import count_tokens
from riskloom.llm.token_shards import write_token_shards
from riskloom.llm.url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: crc32 of a decimal number as text, bit by bit.
CRC32 = r"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8 * len({0})),
    lambda i: CASE WHEN i % 8 = 0 THEN ascii(({0})[i // 8 + 1])::BIGINT ELSE 0 END)),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"""


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


@query(
    r"""
WITH RECURSIVE
judged AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hrefs AS (
  SELECT url, host, unnest([
    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>;]+)', 1)]) AS t
  FROM judged WHERE host <> ''),
targets AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN starts_with(t, '/') THEN 'http://' || host || t END AS t FROM hrefs),
pairs AS (
  SELECT DISTINCT j.host || j.path AS a,
    translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS b
  FROM targets JOIN judged j USING (url) WHERE t IS NOT NULL),
ways AS (SELECT a, b FROM pairs WHERE a <> b AND a <> '' AND b <> ''
  UNION SELECT b, a FROM pairs WHERE a <> b AND a <> '' AND b <> ''),
nodes AS (SELECT DISTINCT host || path AS k FROM judged WHERE host || path <> ''
  UNION SELECT a FROM ways),
reach AS (SELECT k, k AS root FROM nodes
  UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.k),
labels AS (SELECT k, min(root) AS label FROM reach GROUP BY k),
parts AS (SELECT k, label, regexp_extract(k, '(?s)^([^/]*)', 1) AS host,
  regexp_extract(k, '(?s)^[^/]*(.*)$', 1) AS path FROM labels),
fits AS (
  SELECT k, first(verdict ORDER BY length(rule_host || rule_path) DESC) AS verdict,
    first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY k),
classes AS (SELECT label, min(verdict) AS verdict FROM labels JOIN fits USING (k) GROUP BY label)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, c.verdict, 'allow') AS verdict
FROM judged LEFT JOIN fits f ON f.k = host || path
LEFT JOIN labels l ON l.k = host || path LEFT JOIN classes c ON c.label = l.label
"""
)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("key")


@query(
    r"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
ranked AS (
  SELECT source, sum(size)::DOUBLE AS s,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * s AS f,
    (sum(s) OVER () - coalesce(sum(3 * s) OVER fill, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER fill, 0)) AS level
  FROM ranked WINDOW fill AS (ORDER BY 3 * s / w, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, s, least(f, w * max(level) OVER ()) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS k,
    target - CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END * s AS rest FROM targets),
run AS (
  SELECT d.*, b.s, b.target, b.k, b.rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, s::BIGINT AS source_size, target,
  (size * (k + CASE WHEN rest > 0 AND (upto <= rest OR
    (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
)
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary, 2048)


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary)


@query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resample(docs, fit_resampler(docs, table(spark, sf_dir, "labels")))


@query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query()
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


@query()
def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


@query()
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id held_out n_tokens n_known train_tokens base_score score perplexity"
    return score_held_out(table(spark, sf_dir, "documents")).select(*columns.split())


@query(
    r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
runs AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sets AS (SELECT DISTINCT doc_id, md5(s) AS s FROM runs),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT y, root FROM reach JOIN links ON x = reach.doc_id),
groups AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM groups LEFT JOIN sizes USING (doc_id)
"""
)
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = similar_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


@query(
    rf"""
WITH given AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, c::VARCHAR AS s, c - (c % 20 + 20) % 20 AS b, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST,
    substr(sha256(strlen(role)::VARCHAR || ':' || role || text), 1, 32)) AS ts FROM given GROUP BY c),
cut AS (SELECT *, {CRC32.format("s")} % 4 AS h FROM own),
rebuilt AS (
  SELECT x.c, list_concat(coalesce(y.ts[1:x.h], []), x.ts[x.h + 1:]) AS ts
  FROM cut x LEFT JOIN cut y ON y.c = x.b),
steps AS (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS depth FROM rebuilt),
members AS (
  SELECT c, depth, ts[1:depth] AS path, CASE WHEN depth > 0 THEN ts[1:depth - 1] END AS up,
    depth = len(ts) AS ends, CASE WHEN depth > 0 THEN len(regexp_extract_all(ts[depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w
  FROM steps),
nodes AS (
  SELECT path, depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
    (SELECT count(*) FROM nodes k WHERE k.up = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.path = n.up),
sums AS (
  SELECT a.path, sum((k.n_convs - 1) * k.w) AS saved, count(*) FILTER (k.n_children = 0) AS leaves
  FROM linked k, unnest(range(0, k.depth + 1)) u(d) JOIN linked a ON a.path = k.path[1:u.d] GROUP BY a.path)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN sums USING (path)
"""
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query()
def op12_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = write_token_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return store.lookup(docs.select("doc_id").distinct())


def _merkle_sql() -> str:
    """Levels are written out: eight of them hold 16 million nodes."""
    levels = 8
    steps = []

    def tree(name: str, source: str) -> None:
        steps.append(f"{name}0 AS ({source})")
        for k in range(levels):
            steps.append(
                f"""{name}{k + 1} AS (SELECT g, pos // CASE WHEN n > 1 THEN 8 ELSE 1 END AS pos,
  CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h,
  count(*) OVER (PARTITION BY g) AS n FROM {name}{k} GROUP BY g, n, pos // CASE WHEN n > 1 THEN 8 ELSE 1 END)"""
            )

    def sides(name: str, g: str, pos: str, k: int) -> str:
        run = f"FROM {name}{k} s WHERE s.g = {g} AND s.n > 1 AND s.pos // 8 = ({pos} // {8**k}) // 8"
        return ", ".join(
            f"coalesce((SELECT string_agg(h, '' ORDER BY pos) {run} AND s.pos {c} {pos} // {8**k}), '') AS {name}{side}{k}"
            for side, c in (("l", "<"), ("r", ">"))
        )

    value = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')".format
    head = " || ".join(map(value, ("doc_id", "source", "lang", "n_chars")))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tree(
        "t",
        "SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h, "
        "count(*) OVER (PARTITION BY g) AS n, doc_id, changed FROM leaves",
    )
    tree(
        "u",
        f"SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n, g AS lang FROM t{levels}",
    )
    names = [f"{n}{{}}{k}" for n in "tu" for k in range(levels)]
    proof = " || ".join(x.format(s) for x in names for s in "lr")
    chain = []
    previous = "whole"
    for k, x in enumerate(names):
        size = "tn" if k < levels else "un"
        chain.append(
            f"f{k} AS (SELECT * REPLACE (CASE WHEN {size} > {8 ** (k % levels)} "
            f"THEN sha256({x.format('l')} || cur || {x.format('r')}) ELSE cur END AS cur) FROM {previous})"
        )
        previous = f"f{k}"
    lefts = ",\n  ".join([sides("t", "b.g", "b.pos", k) for k in range(levels)] + [sides("u", "0", "u.pos", k) for k in range(levels)])
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256({head} || {value("text")}) AS h,
    CASE WHEN {CRC32.format("(doc_id::VARCHAR)")} % 3 = 0 THEN sha256({head} || {value(low)}) END AS changed
  FROM documents),
{",".join(steps)},
whole AS (
  SELECT b.doc_id, b.h AS leaf, u.h AS subroot, (SELECT h FROM u{levels}) AS root, coalesce(b.changed, b.h) AS cur,
    b.n AS tn, u.n AS un,
  {lefts}
  FROM t0 b JOIN u0 u ON u.lang = b.g),
{",".join(chain)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM {previous}
"""


@query(_merkle_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
