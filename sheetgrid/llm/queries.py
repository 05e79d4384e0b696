"""The registered queries of the corpus operators, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetgrid.llm import (
    compression,
    divergence,
    embeddings,
    minhash,
    mixing,
    packing,
    quality,
    secrets,
    substring,
    tokencount,
    toxicity,
    urls,
    variants,
)

Q: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op1_minhash_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM d
  UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("distance2", "text_hash")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).drop("aliases_blocked")


ORACLES["op3_url_filter"] = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail, rest
  FROM u),
k AS (SELECT page_id, html, host, path, CASE WHEN rest IS NOT NULL THEN host || tail END AS k FROM p),
tie AS (
  SELECT k AS x, regexp_extract(t, 'href="[a-z]+://([^"#]*)', 1) AS y
  FROM (SELECT k, unnest(regexp_extract_all(html, '<link rel="canonical"[^>]*>')) AS t FROM k)),
edge AS MATERIALIZED (SELECT x, y FROM tie WHERE y <> '' AND x <> y UNION SELECT y, x FROM tie WHERE y <> '' AND x <> y),
node AS (SELECT k FROM k WHERE k IS NOT NULL UNION SELECT x FROM edge),
place AS (SELECT k, regexp_extract(k, '^[^/?#]*') AS host, regexp_extract(k, '^[^/?#]*([^?#]*)', 1) AS path FROM node),
fit AS (
  SELECT k, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM place),
reach AS (SELECT k AS n, k AS seen FROM node UNION SELECT reach.n, edge.y FROM reach JOIN edge ON edge.x = reach.seen),
verdicts AS (
  SELECT n, bool_or(rule IN ('org/', 'com/fr/')) AS allowed, bool_or(rule NOT IN ('org/', 'com/fr/')) AS blocked
  FROM reach JOIN fit ON fit.k = seen GROUP BY n)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END AS verdict
FROM k LEFT JOIN fit USING (k) LEFT JOIN verdicts ON n = k.k"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("intervals")


ORACLES["op4_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
pos AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS s FROM pos),
bad AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS i
  FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS low FROM win) WHERE low < doc_id),
gone AS (SELECT doc_id, list(i) AS g, count(*) AS n FROM bad GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w
    ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""

def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "text_hash")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secrets.scan(documents, public_tokenizers.path("byte_bpe_50k.json"), path="source").drop("text_hash")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(table(spark, sf_dir, "documents"), seen)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op10_embedding_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) >= 0.9 * x.l * y.l),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v
  UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
k AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.node = vec_id LEFT JOIN k ON k.a = vec_id"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
own AS (SELECT c.lang, source, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(own.n, 0) + 5 * size.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (size.n + 5 * size.v) AS q
  FROM g JOIN k USING (lang) JOIN size USING (lang) LEFT JOIN own USING (lang, source)
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN apart ON apart.lang = x.lang AND apart.source = x.source AND apart.item = y.source),
listed AS (
  SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50"""


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "labels").where(~compression.held_out(F.col("doc_id")))
    scored = compression.score(table(spark, sf_dir, "documents"), seen)
    return scored.select("doc_id", compression.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


ORACLES["op13_spelling_variants"] = r"""
WITH RECURSIVE bit AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x, t FROM d, crc)),
v AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN w ON w.word = c.rest
  UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN w ON w.word = c.rest),
best AS (
  SELECT word, n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY ALL),
f AS MATERIALIZED (SELECT word, other AS form, m AS form_n FROM best WHERE m >= 5 * n),
up AS (
  SELECT word, form AS last FROM f
  UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.last),
root AS (SELECT up.word, last FROM up WHERE last NOT IN (SELECT word FROM f))
SELECT w.word, form, coalesce(last, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
FROM w LEFT JOIN best USING (word) LEFT JOIN f USING (word) LEFT JOIN root USING (word)"""


QUERIES = {
    query.__name__: query
    for query in (
        op1_minhash_dedup,
        op2_quality_rules,
        op3_url_filter,
        op4_substring_dedup,
        op5_mixing,
        op6_secret_scan,
        op7_token_counts,
        op8_packing,
        op9_toxicity,
        op10_embedding_dedup,
        op11_source_divergence,
        op12_quality_classifier,
        op13_spelling_variants,
    )
}
