"""The queries of the training-data operators: opN_<name>(spark, sf_dir), and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapengine.llm import common as c
from gapengine.llm import ball_kmeans, crf_quality, decontaminate, jaccard_join, langid, licenses, line_runs, mixing, pitman_yor, sharding, tiered_search, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    outside = F.pmod(c.crc32(F.col("doc_id")), F.lit(4)) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~outside)
    return toxicity.scores(docs, model).select("doc_id", F.coalesce(outside, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_hits")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identified(langid.evidence(docs, table(spark, sf_dir, "pages")), langid.train(docs))
    own = lambda x: F.when(F.col("origin") == x, F.col("row_id"))
    return out.select("origin", own("documents").alias("doc_id"), own("pages").alias("page_id"), "host", "declared", "language", "confidence")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", "n_copies", "copy_no", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "mix_key")


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf_quality.verdicts(docs, crf_quality.train(docs, table(spark, sf_dir, "labels")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiers")


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.clustered(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_license_scan, op3_language_id, op4_ngram_jaccard_join, op5_mix_sources, op6_pitman_yor, op7_decontaminate, op8_vector_shards, op9_line_quality, op10_url_filter, op11_tiered_search, op12_line_runs, op13_ball_kmeans)
    return {f.__name__: f for f in own}


MIX_SQL = """
WITH RECURSIVE
counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(n) AS all_n, sum(pow(n::DOUBLE, 0.5)) AS all_weight FROM counts),
rates AS (SELECT source, all_n * pow(n::DOUBLE, 0.5) / all_weight / n AS rate FROM counts, total),
steps AS (
  SELECT source, rate, 0 AS j, exp(-rate) AS term, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, j + 1, term * rate / (j + 1), cdf + term * rate / (j + 1) FROM steps WHERE j + 1 <= ceil(rate + 12 * sqrt(rate) + 12)
),
drawn AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text,
         ('0x' || substr(md5('mix-1' || chr(31) || coalesce(d.doc_id::VARCHAR, '') || chr(31) || coalesce(d.source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d
),
copies AS (
  SELECT w.doc_id, w.source, w.lang, w.n_chars, w.text, count(s.j)::INTEGER AS n_copies
  FROM drawn w JOIN steps s ON w.source IS NOT DISTINCT FROM s.source AND w.u >= s.cdf
  GROUP BY ALL
)
SELECT doc_id, source, lang, n_chars, n_copies, copy_no::INTEGER AS copy_no, md5(coalesce(text, '')) AS text_md5,
       md5('mix-1' || chr(31) || coalesce(doc_id::VARCHAR, '') || chr(31) || copy_no::VARCHAR) AS mix_key
FROM (SELECT *, unnest(generate_series(1, n_copies)) AS copy_no FROM copies)
"""

URL_SQL = """
WITH RECURSIVE
p AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '://[^/?#]*([^#]*)', 1), '') AS rest
  FROM pages
),
own AS (SELECT page_id, html, host, path, CASE WHEN host <> '' THEN host || rest END AS node FROM p),
targets AS (
  SELECT node, host, unnest([regexp_extract(html, '(?i)<link\\s[^>]*rel=["'']?canonical["'']?[^>]*href=["'']([^"''>]+)', 1),
                             regexp_extract(html, '(?i)<link\\s[^>]*href=["'']([^"''>]+)["''][^>]*rel=["'']?canonical', 1),
                             regexp_extract(html, '(?i)<meta\\s[^>]*http-equiv=["'']?refresh["'']?[^>]*content=["''][^"''>]*url=([^"''>]+)', 1)]) AS target
  FROM own
),
edges AS (
  SELECT DISTINCT node AS a,
         CASE WHEN target LIKE '//%' THEN lower(regexp_extract(target, '^//([^/?#]*)', 1)) || regexp_extract(target, '^//[^/?#]*([^#]*)', 1)
              WHEN regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> '' THEN lower(regexp_extract(target, '://([^/?#]*)', 1)) || regexp_extract(target, '://[^/?#]*([^#]*)', 1)
              WHEN target LIKE '/%' THEN host || regexp_extract(target, '^([^#]*)', 1) END AS b
  FROM targets WHERE target <> ''
),
linked AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
reach AS (SELECT a AS v, a AS w FROM linked UNION SELECT r.v, e.b FROM reach r JOIN linked e ON r.w = e.a),
rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
nodes AS (
  SELECT v, regexp_extract(v, '^([^/?#]*)', 1) AS host, regexp_extract(v, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT v FROM reach)
),
node_rules AS (
  SELECT n.v, (SELECT r.verdict FROM rules r WHERE (n.host = r.rhost OR n.host LIKE '%.' || r.rhost) AND starts_with(n.path, r.rpath) ORDER BY length(r.rhost || r.rpath) DESC LIMIT 1) AS verdict FROM nodes n
),
alias AS (
  SELECT r.v, CASE WHEN bool_or(n.verdict = 'allow') THEN 'allow' WHEN bool_or(n.verdict = 'block') THEN 'block' END AS verdict
  FROM reach r JOIN node_rules n ON r.w = n.v GROUP BY r.v
),
fits AS (
  SELECT o.page_id, o.host, o.path, o.node, r.rhost || r.rpath AS rule, r.verdict, row_number() OVER (PARTITION BY o.rid ORDER BY length(r.rhost || r.rpath) DESC) AS k
  FROM (SELECT *, row_number() OVER () AS rid FROM own) o LEFT JOIN rules r ON (o.host = r.rhost OR o.host LIKE '%.' || r.rhost) AND starts_with(o.path, r.rpath)
)
SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.verdict, a.verdict, 'allow') AS verdict
FROM fits f LEFT JOIN alias a ON f.node = a.v WHERE f.k = 1
"""


SEARCH_SQL = r"""
WITH
t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
tot AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM len),
w AS (SELECT term, floor(1000 * ln((2.0 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, tot GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
m AS (SELECT doc_id, 10 + (90 * n * docs) // length AS m FROM len, tot),
s AS (
  SELECT q.item_id, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

LINES_SQL = """
WITH
l AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
),
r AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.last AS goes FROM l LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (goes)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def kmeans_sql(k: int = ball_kmeans.CLUSTERS, rounds: int = ball_kmeans.ROUNDS, dims: int = ball_kmeans.DIMS, scale: int = ball_kmeans.SCALE, seed: str = ball_kmeans.SEED) -> str:
    """Plain k-means, comparing all with all: one assignment and one update for each round."""
    out = f"""WITH
kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
),
v AS MATERIALIZED (SELECT vec_id, i, floor({scale} * (embedding[i])::DOUBLE)::BIGINT AS x FROM kept, range(1, {dims + 1}) AS t(i)),
start AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR)) - 1 AS c FROM kept QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT s.c, v.i, v.x AS y FROM start s JOIN v USING (vec_id))"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (
  SELECT vec_id, c, d FROM (SELECT v.vec_id, c.c, sum((v.x - c.y) * (v.x - c.y))::BIGINT AS d FROM v JOIN c{r} c USING (i) GROUP BY v.vec_id, c.c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
)"""
        if r < rounds:
            out += f""",
m{r} AS (SELECT a.c, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN v USING (vec_id) GROUP BY a.c, v.i),
c{r + 1} AS MATERIALIZED (SELECT c.c, c.i, CASE WHEN m.n IS NULL THEN c.y ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS y FROM c{r} c LEFT JOIN m{r} m USING (c, i))"""
    return f"""{out},
named AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, n.sha AS centroid_sha256
FROM a{rounds} a JOIN named n USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": MIX_SQL, "op10_url_filter": URL_SQL, "op11_tiered_search": SEARCH_SQL, "op12_line_runs": LINES_SQL, "op13_ball_kmeans": kmeans_sql()}
