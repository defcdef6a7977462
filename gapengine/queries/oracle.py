"""DuckDB SQL that gives the same rows as the queries of core, written against the tables alone."""

from __future__ import annotations

from gapengine.functions.text import SUFFIXES
from gapengine.queries.core import ASPECTS, DOMAINS, HIGH, LEXICON, LOW

TOKEN = r"[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)?"
CANON = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
STOP = "[" + ", ".join(f"'{w}'" for w in sorted(LEXICON.stop)) + "]"
STEM = "CASE " + " ".join(f"WHEN w LIKE '%{s}' AND length(w) >= {len(s) + 4} THEN left(w, length(w) - {len(s)})" for s in SUFFIXES) + " ELSE w END"
AS_OF = "TIMESTAMP '2001-08-01'"


def terms(column: str) -> str:
    """Framing terms of a text, in order."""
    words = f"list_filter(list_transform(regexp_extract_all(lower({column}), '[a-z][a-z0-9''-]+'), lambda w: regexp_replace(w, '^[''-]+|[''-]+$', '', 'g')), lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w))"
    return f"list_filter(list_transform({words}, lambda w: {STEM}), lambda w: NOT list_contains({STOP}, w))"


SIGNALS = """signals AS (
  SELECT d.doc_id AS id, d.text, d.source, d.lang, 1.0::DOUBLE + 4 * l.quality AS rating
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""
TOKENS = f"{SIGNALS}, tok AS (SELECT *, list_transform(regexp_extract_all(text, '{TOKEN}'), lambda w: lower(w)) AS tokens FROM signals)"
FELT = f"""{TOKENS}, c AS (
  SELECT *, len(list_filter(tokens, lambda w: w IN ('is', 'was'))) AS n_positive, len(list_filter(tokens, lambda w: w IN ('that', 'with'))) AS n_negative, len(list_filter(tokens, lambda w: w = 'for')) AS n_intense FROM tok
), s AS (
  SELECT *, CASE WHEN n_positive + n_negative > 0 THEN (n_positive - n_negative)::DOUBLE / (n_positive + n_negative) END AS lexical, greatest(-1, least(1, (rating - 3) / 2)) AS rated FROM c
), s2 AS (
  SELECT *, CASE WHEN lexical IS NOT NULL AND rating IS NOT NULL THEN 0.7 * rated + 0.3 * lexical WHEN rating IS NOT NULL THEN rated ELSE coalesce(lexical, 0.0) END::DOUBLE AS sentiment FROM s
), felt AS (
  SELECT *, least(1.0, 0.65 * abs(sentiment) + 0.25 * least(1.0, (n_positive + n_negative) / 3.0::DOUBLE) + 0.1 * least(1.0, n_intense / 2.0::DOUBLE))::DOUBLE AS intensity FROM s2
)"""
WORDS = "words(domain, word) AS (VALUES " + ", ".join(f"('{d}', '{w}')" for d, ws in DOMAINS.items() for w in ws) + ")"
DOMAIN = f"""{WORDS}, hits AS (
  SELECT k.source, w.domain, count(*) AS score FROM (SELECT source, unnest(tokens) AS word FROM felt) k JOIN words w USING (word) GROUP BY 1, 2
), sizes AS (SELECT source, count(DISTINCT id) AS n FROM felt GROUP BY 1),
matched AS (
  SELECT source, domain, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, domain DESC) AS k FROM hits) JOIN sizes USING (source) WHERE k = 1 AND score >= greatest(2, n // 8)
)"""
BACKLOG = f"""b AS (
  SELECT o_orderkey AS item_id, o_orderpriority AS label, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Backlog' WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS milestone,
         o_orderdate + to_days((o_custkey % 400)::INTEGER) AS due, o_orderdate AS created, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state,
         CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'critical' WHEN o_orderpriority LIKE '%HIGH' THEN 'high' WHEN o_orderpriority LIKE '%MEDIUM' THEN 'medium' WHEN o_orderpriority LIKE '%LOW' THEN 'low' END AS explicit
  FROM orders JOIN customer ON o_custkey = c_custkey
), f AS (
  SELECT *, coalesce(milestone = 'Backlog', false) AS in_backlog, milestone IS NULL AS none, due > {AS_OF} + INTERVAL 183 DAY AS far, state = 'open' AND created < {AS_OF} - INTERVAL 365 DAY AS stale FROM b
), p AS (
  SELECT *, coalesce(explicit, CASE WHEN in_backlog THEN 'backlog' WHEN none OR far OR stale THEN 'low' ELSE 'unspecified' END) AS tier FROM f
), prio AS (
  SELECT *, CASE tier WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.65 WHEN 'low' THEN 0.35 WHEN 'backlog' THEN 0.15 ELSE 0.5 END::DOUBLE AS score,
         tier IN ('low', 'backlog') OR ((in_backlog OR none OR far OR stale) AND tier NOT IN ('critical', 'high')) AS is_low,
         concat_ws('; ', CASE WHEN explicit IS NOT NULL THEN 'label: ' || label END, CASE WHEN in_backlog THEN 'backlog milestone' WHEN none THEN 'no milestone' END, CASE WHEN far THEN 'due date far ahead' END, CASE WHEN stale THEN 'open for long' END) AS why
  FROM p
)"""
LOW_REASONS = f"""{BACKLOG}, low AS (
  SELECT item_id, CASE WHEN explicit IN ('critical', 'high') THEN [] ELSE list_filter([
    CASE WHEN is_low THEN 'ingest' END, CASE WHEN tier IN ('low', 'backlog') THEN 'tier' END, CASE WHEN score <= 0.35 THEN 'score' END,
    CASE WHEN lower(coalesce(trim(milestone), '')) IN ('', 'none', 'backlog', 'future') THEN 'milestone' END,
    CASE WHEN floor((epoch(due) - epoch({AS_OF})) / 86400) > 183 THEN 'due' END,
    CASE WHEN state = 'open' AND floor((epoch({AS_OF}) - epoch(created)) / 86400) > 365 AND explicit IS NULL THEN 'age' END], lambda x: x IS NOT NULL) END AS reasons
  FROM prio
)"""
MILESTONES = "m AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 0)"
ROADMAP = f"""{MILESTONES}, i AS (
  SELECT 'issue' AS type, c_custkey::INTEGER AS number, c_name AS title, CASE WHEN c_acctbal > 8000 THEN 'P1' ELSE 'p3' END AS l, c_mktsegment AS seg, coalesce(n_name, 'embedded') AS milestone, CASE WHEN n_name IS NOT NULL THEN TIMESTAMP '2001-12-01' END AS due
  FROM customer LEFT JOIN m ON c_nationkey = n_nationkey WHERE c_acctbal >= 0
), r AS (
  SELECT type, number, title, CASE WHEN lower(l) < lower(seg) THEN l || ',' || seg ELSE seg || ',' || l END AS labels, milestone, CASE WHEN l = 'P1' THEN 'high' ELSE 'low' END AS tier, l <> 'P1' AS is_low FROM i
  UNION ALL SELECT 'milestone', n_nationkey::INTEGER, n_name, '', NULL, 'unspecified', false FROM m
), roadmap AS (SELECT 'R' || left(sha256('owner/name' || chr(31) || type || chr(31) || number), 12) AS id, * FROM r)"""
PAIRS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e), pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) / (x.norm * y.norm) AS similarity FROM n x JOIN n y ON x.vec_id < y.vec_id AND list_dot_product(x.v, y.v) >= 0.4 * x.norm * y.norm)"
ROOTS = f"{PAIRS}, linked AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(id, w) AS (SELECT a, a FROM linked UNION SELECT r.id, e2.b FROM reach r JOIN linked e2 ON r.w = e2.a), roots AS (SELECT id, min(w) AS root FROM reach GROUP BY 1)"
MATCHED = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e),
ranked AS (SELECT x.vec_id AS id, y.vec_id AS item_id, x.label, y.label AS item_label, list_dot_product(x.v, y.v) / (x.norm * y.norm) AS s, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_dot_product(x.v, y.v) / (x.norm * y.norm), 12) DESC, y.vec_id) AS k FROM n x, n y),
m AS (SELECT id, item_id, round(s, 6) AS similarity, item_label % 2 = 1 AS low_priority, item_label % 3 = 0 AS closed, label % 5 = 4 AS misunderstood FROM ranked WHERE k = 2)"""
PLAIN = f"CASE WHEN similarity < {LOW} THEN 'IGNORED' WHEN low_priority THEN 'UNDER-PRIORITIZED' WHEN similarity >= {HIGH} THEN 'COVERED' WHEN similarity < {(LOW + HIGH) / 2} THEN 'IGNORED' ELSE 'COVERED' END"
VERDICT = f"CASE WHEN misunderstood THEN 'MISUNDERSTOOD' ELSE {PLAIN} END"
PROBES = f"""turns AS (
  SELECT u.conv_id || ':' || u.turn AS need_id, {terms("u.text")} AS st, {terms("a.text")} AS jt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
), item_terms AS (SELECT DISTINCT doc_id AS item_id, unnest({terms("text")}) AS term FROM documents),
freq AS (SELECT term, count(*) AS df FROM item_terms GROUP BY 1),
sides AS (
  SELECT DISTINCT need_id, 'symptom' AS side, unnest(list_filter(st, lambda x: NOT list_contains(jt, x))) AS term FROM turns
  UNION ALL SELECT DISTINCT need_id, 'job', unnest(list_filter(jt, lambda x: NOT list_contains(st, x))) FROM turns
), ranked AS (
  SELECT need_id, side, term, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf,
         row_number() OVER (PARTITION BY need_id, side ORDER BY ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + coalesce(df, 0))) + 1 DESC, term) AS k
  FROM sides LEFT JOIN freq USING (term)
), sizes AS (SELECT t.need_id, least((SELECT count(*) FROM sides s WHERE s.need_id = t.need_id AND side = 'symptom'), (SELECT count(*) FROM sides s WHERE s.need_id = t.need_id AND side = 'job'), 6) AS kk FROM turns t),
probes AS (SELECT r.need_id, side, term, idf, kk FROM ranked r JOIN sizes z USING (need_id) WHERE k <= kk)"""
BEST = f"""{PROBES}, mass AS (SELECT need_id, side, sum(idf) AS mass FROM probes WHERE kk >= 3 GROUP BY 1, 2),
got AS (SELECT p.need_id, side, item_id, sum(idf) AS got FROM probes p JOIN item_terms USING (term) WHERE kk >= 3 GROUP BY 1, 2, 3),
best AS (
  SELECT need_id, side, item_id, coverage FROM (
    SELECT need_id, side, item_id, round(got / mass, 6) AS coverage, row_number() OVER (PARTITION BY need_id, side ORDER BY round(got / mass, 6) DESC, item_id) AS k FROM got JOIN mass USING (need_id, side)
  ) WHERE k = 1
)"""
CITED = "cited AS (SELECT user_id AS gap_id, event_id AS signal_id, event_type <> 'error' AS resolved, event_type AS source, greatest(-1, least(1, (least(1 + floor(value / 100), 5) - 3) / 2))::DOUBLE AS sentiment, ts FROM events)"
FEATURES = f"""{CITED}, now AS (SELECT gap_id, max(ts) AS as_of FROM cited GROUP BY 1), agg AS (
  SELECT gap_id, count(*) AS cited, count(*) FILTER (resolved) AS resolved, count(DISTINCT source) FILTER (resolved) AS sources, avg(abs(sentiment)) FILTER (resolved) AS mean,
         avg(exp(-ln(2) * greatest(floor((floor(epoch(as_of)) - floor(epoch(ts))) / 86400), 0) / 365)) FILTER (resolved) AS decay,
         count(*) FILTER (resolved AND sentiment < -0.05) AS s, count(*) FILTER (resolved AND sentiment > 0.35) AS c
  FROM cited JOIN now USING (gap_id) GROUP BY 1
), feat AS (
  SELECT gap_id, cited, resolved, round(least(1, ln(1 + cited) / ln(21)), 6)::DOUBLE AS vol, round(CASE WHEN resolved > 0 THEN greatest(0, least(1, (sources - 1) / 2.0)) ELSE 0 END, 6)::DOUBLE AS div,
         round(coalesce(mean, 0.5), 6)::DOUBLE AS sent, round(coalesce(decay, 0.5), 6)::DOUBLE AS rec, round(CASE WHEN resolved > 0 THEN (s + 1)::DOUBLE / (s + c + 2) ELSE 0.5 END, 6)::DOUBLE AS cons,
         (CASE WHEN resolved >= 2 THEN 0.5 WHEN resolved = 1 THEN 0.25 ELSE 0.0 END)::DOUBLE AS agree, round(0.05 + (gap_id % 10) / 20.0, 6)::DOUBLE AS coh, (CASE WHEN gap_id % 3 > 0 THEN 0.8 ELSE 0.5 END)::DOUBLE AS selfc
  FROM agg
)"""
RAW = "round(1 / (1 + exp(-(-2.25 + vol + 0.5 * div + cons + agree + coh))), 12)"
WEIGHTS = (("vol", 1.0), ("div", 0.5), ("sent", 0.0), ("rec", 0.0), ("cons", 1.0), ("agree", 1.0), ("coh", 1.0))
BREAKDOWN = "breakdown AS (" + " UNION ALL ".join(f"SELECT gap_id, '{k}' AS feature, {k} AS value, {w}::DOUBLE AS weight, {k} * {w}::DOUBLE AS contribution FROM feat" for k, w in WEIGHTS) + ")"
DISSENT = f"{CITED}, counter AS (SELECT gap_id, count(*) FILTER (resolved) AS resolved, count(*) FILTER (resolved AND sentiment > 0.35) AS n_dissent, md5(coalesce(string_agg(signal_id::VARCHAR, ',' ORDER BY signal_id) FILTER (resolved AND sentiment > 0.35), '')) AS ids FROM cited GROUP BY 1)"
PREDICTED = "pred AS (SELECT doc_id, quality AS y, round(least(1, ln(1 + n_chars) / ln(20001)), 9)::DOUBLE AS p FROM labels JOIN documents USING (doc_id))"
BINS = f"{PREDICTED}, bins AS (SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, avg(p) AS mean_p, avg(y)::DOUBLE AS mean_y FROM pred GROUP BY 1)"
GAPS = """lines AS (
  SELECT l_orderkey AS gap_id, list(l_partkey ORDER BY l_partkey) AS signal_ids, list_distinct(list(l_partkey + l_linenumber % 2 * (l_suppkey % 2)) FILTER (l_linenumber <= 2)) AS quote_ids, count(*) FILTER (l_returnflag = 'N') AS valid FROM lineitem GROUP BY 1
), gaps AS (SELECT o_orderkey AS gap_id, o_custkey AS need_id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 40 END AS item_id, o_orderstatus, signal_ids, quote_ids, valid FROM orders JOIN lines ON gap_id = o_orderkey),
per AS (SELECT gap_id, value, count(*) AS k FROM (SELECT gap_id, unnest(signal_ids) AS value FROM gaps) GROUP BY 1, 2),
issues AS (
  SELECT gap_id, 'unknown signal' AS issue, value FROM per WHERE value NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
  UNION ALL SELECT gap_id, 'repeated signal', value FROM per WHERE k > 1
  UNION ALL SELECT gap_id, 'quote not cited', value FROM (SELECT gap_id, signal_ids, unnest(quote_ids) AS value FROM gaps) WHERE value IS NOT NULL AND NOT list_contains(signal_ids, value)
  UNION ALL SELECT gap_id, 'unknown item', item_id FROM gaps WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT gap_id, 'unknown need', need_id FROM gaps WHERE need_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
)"""
PARTS = """g AS (
  SELECT p_partkey AS id, p_name AS title, CASE p_size % 4 WHEN 0 THEN 'COVERED' WHEN 1 THEN 'IGNORED' ELSE 'UNDER-PRIORITIZED' END AS verdict, CASE WHEN p_type = 'ECONOMY' THEN 'UNSUPPORTED' ELSE 'DEFENSIBLE' END AS critique,
         round(least(1, p_retailprice / 3000), 6)::DOUBLE AS confidence, round(p_size * 0.4::DOUBLE, 6) AS opportunity, p_size AS evidence FROM part
), sc AS (SELECT *, round(confidence * opportunity, 6) AS score FROM g)"""
RANKED = f"""{PARTS}, ok AS (SELECT * FROM sc WHERE verdict <> 'COVERED' AND critique <> 'UNSUPPORTED'),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY score DESC, confidence DESC, opportunity DESC, evidence DESC, id) AS tk FROM ok) WHERE tk = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, confidence DESC, opportunity DESC, evidence DESC, id)::INTEGER AS rank FROM one) WHERE rank <= 5)"""

SQL = {
    "q01_ingest_dedup": rf"""WITH {SIGNALS}, r AS (SELECT id::VARCHAR AS source_id, source AS package, {CANON.format("text")} AS t, rating FROM signals),
        g AS (SELECT lower(t) AS k, rating, count(*)::INTEGER AS n, max(source_id) AS source_id FROM r WHERE t <> '' GROUP BY 1, 2)
        SELECT 'S' || left(sha256('documents' || chr(31) || lower(r.package) || chr(31) || lower(r.t) || chr(31) || coalesce(r.rating::VARCHAR, '')), 12) AS id, g.source_id, r.package AS package_name, r.rating, g.n AS duplicate_count, length(r.t)::INTEGER AS text_length FROM g JOIN r USING (source_id)""",
    "q02_ingest_stats": rf"""WITH r AS (SELECT lower({CANON.format("source")}) = 'src0' AS own, {CANON.format("text")} AS t, n_chars % 6 + 1 AS rating FROM documents),
        s AS (SELECT *, CASE WHEN NOT own THEN 'other' WHEN t = '' THEN 'blank' WHEN rating > 5 THEN 'invalid' ELSE 'ok' END AS status FROM r), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT lower(t), rating FROM s WHERE status = 'ok'))
        SELECT count(*) AS total_rows, count(*) FILTER (own) AS matching_rows, count(*) FILTER (status = 'blank') AS blank_rows, count(*) FILTER (status = 'invalid') AS invalid_rows, count(*) FILTER (status = 'ok') - (SELECT n FROM d) AS duplicate_rows, (SELECT n FROM d) AS emitted_rows FROM s""",
    "q03_dataset_profile": "SELECT event_type, count(*) AS rows, count(DISTINCT props) AS distinct_texts, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY 1",
    "q04_text_tokens": f"WITH {TOKENS} SELECT id AS doc_id, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct, tokens[1] AS first_token FROM tok",
    "q05_stable_ids": rf"""WITH i AS (SELECT source, 'S' || left(sha256(source || chr(31) || doc_id || chr(31) || lower({CANON.format("text")})), 12) AS id FROM documents)
        SELECT source, count(*) AS n, min(id) AS least, 'N' || left(sha256(string_agg(id, chr(30) ORDER BY id)), 12) AS need_id FROM i GROUP BY 1""",
    "q06_label_tier": "SELECT o_orderpriority AS label, CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'critical' WHEN o_orderpriority LIKE '%HIGH' THEN 'high' WHEN o_orderpriority LIKE '%MEDIUM' THEN 'medium' WHEN o_orderpriority LIKE '%LOW' THEN 'low' ELSE 'unspecified' END AS tier, count(*) AS n FROM orders GROUP BY 1, 2",
    "q07_priority_metadata": f"WITH {BACKLOG} SELECT item_id, tier, score, is_low, explicit IS NOT NULL AS is_explicit, CASE WHEN why = '' THEN 'no priority evidence' ELSE why END AS reasons FROM prio",
    "q08_priority_is_low": f"WITH {LOW_REASONS} SELECT item_id, len(reasons) > 0 AS is_low, array_to_string(reasons, ',') AS reasons FROM low",
    "q09_reason_firing_rates": f"WITH {LOW_REASONS}, t AS (SELECT count(*) AS n FROM low) SELECT reason, count(*) AS items, round(count(*)::DOUBLE / any_value(t.n), 6) AS rate, count(*) >= 0.9 * any_value(t.n) AS dominant FROM (SELECT unnest(reasons) AS reason FROM low), t GROUP BY 1",
    "q10_milestone_join": f"WITH {MILESTONES} SELECT c_custkey::INTEGER AS number, coalesce(n_name, 'embedded') AS milestone, CASE WHEN n_name IS NOT NULL THEN TIMESTAMP '2001-12-01' END AS milestone_due FROM customer LEFT JOIN m ON c_nationkey = n_nationkey WHERE c_acctbal >= 0",
    "q11_roadmap_union": f"WITH {ROADMAP} SELECT id, type, number, title, labels, milestone, tier, is_low FROM roadmap",
    "q12_sentiment": f"WITH {FELT} SELECT id, n_positive, n_negative, round(sentiment, 6) AS sentiment, round(intensity, 6) AS intensity FROM felt",
    "q13_friction_partition": f"WITH {TOKENS} SELECT source, rating IS NULL OR rating < 4 OR list_has_any(tokens, ['by', 'that', 'with']) OR regexp_matches(text, '(?i)thshe|the of') AS kept, count(*) AS n FROM tok GROUP BY 1, 2",
    "q14_signal_aspect": f"""WITH {TOKENS}, x AS (SELECT id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM tok), k AS (SELECT id, w, count(*) AS n, min(i) AS f FROM x WHERE w IN ({", ".join(f"'{a}'" for a in ASPECTS)}) GROUP BY 1, 2),
        r AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) AS k FROM k) SELECT s.id, coalesce(r.w, 'general') AS aspect FROM signals s LEFT JOIN r ON r.id = s.id AND r.k = 1""",
    "q15_cluster_aspects": f"""WITH {TOKENS}, x AS (SELECT source, id, unnest(tokens) AS aspect FROM tok), c AS (SELECT source, aspect, count(*) AS tf, count(DISTINCT id) AS df FROM x WHERE length(aspect) >= 3 GROUP BY 1, 2), z AS (SELECT source, count(DISTINCT id) AS n FROM tok GROUP BY 1),
        s AS (SELECT source, aspect, tf, df, round(tf * (1 + ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df))), 6) AS score FROM c JOIN z USING (source)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, aspect)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 3""",
    "q16_domain_match": f"WITH {FELT}, {DOMAIN} SELECT source, domain, score FROM matched",
    "q17_grounding_semi": f"""WITH {FELT}, {DOMAIN}, f AS (SELECT felt.source, felt.id, coalesce(list_has_any(felt.tokens, (SELECT list(w.word) FROM words w WHERE w.domain = matched.domain)), false) AS own FROM felt LEFT JOIN matched USING (source)),
        fs AS (SELECT *, bool_or(own) OVER (PARTITION BY source) AS any_own FROM f) SELECT source, count(*) AS n, sum(id)::BIGINT AS ids FROM fs WHERE own OR NOT any_own GROUP BY 1""",
    "q18_kano": f"WITH {FELT}, k AS (SELECT source, avg((sentiment < 0)::INTEGER) AS ns, avg(intensity) AS mi FROM felt GROUP BY 1) SELECT source, round(ns, 6) AS negative_share, round(mi, 6) AS mean_intensity, CASE WHEN ns >= 0.6 OR mi >= 0.65 THEN 'basic' WHEN ns >= 0.25 THEN 'performance' ELSE 'excitement' END AS kano_class FROM k",
    "q19_need_score": f"""WITH {FELT}, a AS (SELECT source, count(*) AS support, avg(sentiment) AS ms, avg(intensity) AS mi FROM felt GROUP BY 1),
        b AS (SELECT source, support, least(10.0, 3.5 + 4 * ln(1 + support) / ln(1 + (SELECT count(*) FROM documents)) + 2.5 * mi)::DOUBLE AS i, greatest(0, least(10, 5 * (ms + 1)))::DOUBLE AS s FROM a)
        SELECT source, support, round(i, 6) AS importance, round(s, 6) AS satisfaction, round(i + greatest(i - s, 0), 6) AS opportunity FROM b""",
    "q20_temporal_scope": "SELECT user_id, min(ts) AS evidence_start, max(ts) AS evidence_end FROM events GROUP BY 1",
    "q21_attach_stragglers": f"""WITH {TOKENS}, {WORDS}, h AS (SELECT x.id, w.domain, count(*) AS score FROM (SELECT id, unnest(tokens) AS word FROM tok WHERE lang <> 'en') x JOIN words w USING (word) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, domain DESC) AS k FROM h) SELECT id, CASE domain WHEN 'access' THEN 'N1' ELSE 'N4' END AS need_id FROM r WHERE k = 1 AND score >= 2 AND domain <> 'content'""",
    "q22_redundancy_pairs": f"WITH {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs",
    "q23_components": f"WITH RECURSIVE {ROOTS} SELECT id, root FROM roots",
    "q24_merge_groups": f"""WITH RECURSIVE {ROOTS}, t AS (SELECT vec_id AS id, 'need ' || label AS latent_need, (vec_id * 37) % 2000 / 100.0::DOUBLE AS o, vec_id, vec_id % 50 AS other, 'a' || label AS aspect, label / 100.0::DOUBLE AS sc, label::BIGINT AS failures, coalesce(root, vec_id) AS root FROM embeddings LEFT JOIN roots ON id = vec_id),
        g AS (SELECT root, arg_min(id, (-o, id)) AS id, arg_min(latent_need, (-o, id)) AS latent_need, list_sort(list_distinct(flatten(list([vec_id, other])))) AS ids, list(aspect ORDER BY -o, id) AS asp, min(sc) AS sc, sum(failures)::BIGINT AS failures, list(id ORDER BY id) AS members FROM t GROUP BY 1)
        SELECT id, latent_need, array_to_string(ids, ',') AS signal_ids, array_to_string(list_filter(asp, lambda x, i: list_position(asp, x) = i)[1:6], ',') AS aspects, round(sc, 6) AS self_consistency, failures, CASE WHEN len(members) > 1 THEN array_to_string(members, ',') ELSE '' END AS merged_from FROM g""",
    "q25_cosine_topk_pool": f"WITH {MATCHED} SELECT id AS query_id, item_id, k::INTEGER AS rank, round(s, 6) AS similarity FROM ranked WHERE k <= 10",
    "q26_document_frequency": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({terms('text')}) AS term FROM documents) GROUP BY 1",
    "q27_probes": f"WITH {PROBES} SELECT need_id, side, term, round(idf, 6) AS idf, kk::INTEGER AS k FROM probes",
    "q28_coverage": f"WITH {BEST} SELECT need_id, side, item_id, coverage FROM best",
    "q76_pool_coverage": f"""WITH {PROBES}, mass AS (SELECT need_id, side, sum(idf) AS mass FROM probes WHERE kk >= 3 GROUP BY 1, 2),
        top AS (SELECT * FROM (SELECT source, doc_id AS item_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pool_rank FROM documents) WHERE pool_rank <= 10),
        pool AS (SELECT need_id, item_id, pool_rank FROM turns t JOIN top ON source = 'src' || (t.need_id.split(':')[1]::BIGINT % 20)),
        got AS (SELECT p.need_id, side, item_id, any_value(pool_rank) AS pool_rank, sum(idf) AS got FROM probes p JOIN pool USING (need_id) JOIN item_terms USING (item_id, term) WHERE kk >= 3 GROUP BY 1, 2, 3)
        SELECT need_id, side, item_id, coverage FROM (
          SELECT need_id, side, item_id, round(got / mass, 6) AS coverage, row_number() OVER (PARTITION BY need_id, side ORDER BY round(got / mass, 6) DESC, pool_rank) AS k FROM got JOIN mass USING (need_id, side)
        ) WHERE k = 1""",
    "q29_framing_verdict": f"""WITH {BEST}, v AS (SELECT z.need_id, z.kk >= 3 AS eligible, s.item_id AS symptom_item, coalesce(s.coverage, 0.0)::DOUBLE AS symptom_coverage, coalesce(j.coverage, 0.0)::DOUBLE AS job_coverage FROM sizes z LEFT JOIN best s ON s.need_id = z.need_id AND s.side = 'symptom' LEFT JOIN best j ON j.need_id = z.need_id AND j.side = 'job')
        SELECT *, eligible AND symptom_coverage >= 0.5 AND job_coverage < 0.5 AND round(symptom_coverage - job_coverage, 6) >= 0.1 AS is_misunderstood FROM v""",
    "q30_verdict_tree": f"WITH {MATCHED} SELECT id, item_id, similarity, {VERDICT} AS verdict FROM m",
    "q31_closed_guard": f"""WITH {MATCHED}, g AS (SELECT closed, CASE WHEN {VERDICT} = 'COVERED' AND closed THEN 'IGNORED' ELSE {VERDICT} END AS verdict FROM m)
        SELECT verdict, CASE verdict WHEN 'IGNORED' THEN 'no matching item' WHEN 'UNDER-PRIORITIZED' THEN 'planned late' WHEN 'MISUNDERSTOOD' THEN 'planned for the symptom' ELSE 'planned' END AS state, closed, count(*) AS n FROM g GROUP BY ALL""",
    "q32_verdict_stability": f"""WITH {MATCHED}, x AS (SELECT *, round(0.5 + similarity / 4, 6) - 0.5 AS a, 0.5 - round(0.5 - similarity / 5, 6) AS b, {PLAIN} AS plain, round(abs(similarity - {LOW}), 6) AS ms FROM m),
        y AS (SELECT *, round(least(a, b), 6) AS mf, CASE WHEN plain <> 'IGNORED' THEN 'IGNORED' WHEN low_priority THEN 'UNDER-PRIORITIZED' WHEN similarity >= {(LOW + HIGH) / 2} THEN 'COVERED' END AS target FROM x)
        SELECT id, CASE WHEN closed AND NOT misunderstood AND plain = 'COVERED' THEN 'closed' WHEN misunderstood THEN CASE WHEN a <= b THEN 'symptom' ELSE 'job' END ELSE 'low' END AS gate,
               CASE WHEN closed AND NOT misunderstood AND plain = 'COVERED' THEN NULL WHEN misunderstood THEN mf WHEN target IS NOT NULL THEN ms END AS margin,
               CASE WHEN closed AND NOT misunderstood AND plain = 'COVERED' THEN NULL WHEN misunderstood THEN CASE WHEN mf <= 0.05 THEN plain END ELSE target END AS flips_to,
               CASE WHEN closed AND NOT misunderstood AND plain = 'COVERED' THEN false WHEN misunderstood THEN mf <= 0.05 ELSE target IS NOT NULL AND ms <= 0.05 END AS is_borderline FROM y""",
    "q33_threshold_grid": f"""WITH {MATCHED}, grid AS (SELECT lo.v AS low, hi.v AS high FROM (VALUES (0.3::DOUBLE), (0.32), (0.34), (0.36)) lo(v), (VALUES (0.38::DOUBLE), (0.42), (0.46)) hi(v) WHERE lo.v < hi.v),
        e2 AS (SELECT *, CASE WHEN misunderstood THEN 'MISUNDERSTOOD' WHEN similarity < 0.33 THEN 'IGNORED' WHEN low_priority THEN 'UNDER-PRIORITIZED' ELSE 'COVERED' END AS expected FROM m),
        c AS (SELECT low, high, id % 5 AS fold, (CASE WHEN misunderstood THEN 'MISUNDERSTOOD' WHEN similarity < low THEN 'IGNORED' WHEN low_priority THEN 'UNDER-PRIORITIZED' WHEN similarity >= high THEN 'COVERED' WHEN similarity < (low + high) / 2 THEN 'IGNORED' ELSE 'COVERED' END = expected)::INTEGER AS ok FROM e2, grid),
        f AS (SELECT low, high, fold, sum(ok) AS ok, count(*) AS n FROM c GROUP BY ALL), w AS (SELECT low, high, sum(ok) AS ok, sum(n) AS n FROM f GROUP BY ALL),
        o AS (SELECT f.fold, f.ok, f.n, row_number() OVER (PARTITION BY fold ORDER BY (w.ok - f.ok)::DOUBLE / (w.n - f.n) DESC, round(f.high - f.low, 9), f.low, f.high) AS k FROM f JOIN w USING (low, high))
        SELECT low, high, round(ok::DOUBLE / n, 6) AS accuracy, (SELECT round(sum(ok)::DOUBLE / sum(n), 6) FROM o WHERE k = 1) AS fold_accuracy, row_number() OVER (ORDER BY round(ok::DOUBLE / n, 6) DESC, round(high - low, 9), low, high)::INTEGER AS rank FROM w""",
    "q34_evidence_join": "SELECT conv_id AS gap_id, count(*) AS n_cited, count(*) FILTER (role = 'user') AS n_quotes, md5(coalesce(string_agg(left(text, 280), '|' ORDER BY turn) FILTER (role = 'user'), '')) AS spans FROM conversations GROUP BY 1",
    "q35_conf_features": f"WITH {FEATURES} SELECT * FROM feat",
    "q36_evidence_score": f"WITH {FEATURES}, r AS (SELECT gap_id, selfc, {RAW} AS raw, gap_id % 3 > 0 AS seen FROM feat) SELECT gap_id, round(raw, 6) AS raw, round(CASE WHEN seen THEN 2 * raw * selfc / (raw + selfc) ELSE raw END, 6) AS harmonic, round(CASE WHEN seen THEN least(raw, selfc) ELSE raw END, 6) AS minimum, round(CASE WHEN seen THEN raw * selfc ELSE raw END, 6) AS product FROM r",
    "q37_breakdown_unpivot": f"WITH {FEATURES}, {BREAKDOWN} SELECT gap_id, feature, value, weight, round(contribution, 6) AS contribution FROM breakdown",
    "q38_feature_diagnostics": f"""WITH {FEATURES}, {BREAKDOWN}, a AS (SELECT feature, value, weight FROM breakdown UNION ALL SELECT 'selfc', selfc, 0.0 FROM feat), d AS (SELECT feature, min(value) AS lowest, max(value) AS highest, max(value) - min(value) <= 1e-9 AS is_constant, any_value(weight)::DOUBLE AS weight FROM a GROUP BY 1)
        SELECT *, (SELECT round(sum(CASE WHEN is_constant THEN abs(weight) ELSE 0 END) / sum(abs(weight)), 6) FROM d) AS dead_share FROM d""",
    "q39_counterevidence": f"WITH {DISSENT} SELECT gap_id, resolved, n_dissent, CASE WHEN resolved > 0 THEN round(n_dissent::DOUBLE / resolved, 6) ELSE 0.0 END::DOUBLE AS share, ids FROM counter",
    "q40_cohesion": "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM e), p AS (SELECT x.label, avg(list_dot_product(x.v, y.v) / (x.norm * y.norm)) AS c FROM n x JOIN n y ON x.label = y.label AND x.vec_id <> y.vec_id GROUP BY 1), z AS (SELECT label, count(*) AS n FROM e GROUP BY 1) SELECT z.label, z.n, round(coalesce(p.c, 0.5), 6) AS cohesion FROM z LEFT JOIN p USING (label)",
    "q41_weakest_assumption": f"""WITH {FEATURES}, counter AS (SELECT gap_id, CASE WHEN count(*) FILTER (resolved) > 0 THEN round((count(*) FILTER (resolved AND sentiment > 0.35))::DOUBLE / count(*) FILTER (resolved), 6) ELSE 0 END AS share FROM cited GROUP BY 1),
        x AS (SELECT gap_id, gap_id % 2 = 0 AS is_low, (gap_id % 7) / 50.0::DOUBLE <= 0.05 AS near, share, coh, gap_id % 4 = 0 AS unfit, vol FROM feat JOIN counter USING (gap_id)),
        k AS (SELECT gap_id, 4 AS s, 'similarity near the low threshold' AS f FROM x WHERE is_low AND near UNION ALL SELECT gap_id, 4, 'framing coverage near the cutoff' FROM x WHERE NOT is_low AND near UNION ALL SELECT gap_id, 3, 'dissenting evidence' FROM x WHERE share >= 0.25
              UNION ALL SELECT gap_id, 3, 'loosely related evidence' FROM x WHERE coh < 0.1 UNION ALL SELECT gap_id, 2, 'too few terms to compare framings' FROM x WHERE unfit UNION ALL SELECT gap_id, 2, 'little evidence' FROM x WHERE vol < 0.6 UNION ALL SELECT gap_id, 1, 'the score isn''t calibrated' FROM x),
        r AS (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY s DESC, f) AS k FROM k) SELECT gap_id, s AS severity, f AS factor FROM r WHERE k = 1""",
    "q42_reliability_bins": f"WITH {BINS} SELECT bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM bins",
    "q43_ece": f"WITH {BINS} SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM bins",
    "q44_brier": f"WITH {PREDICTED} SELECT round(avg((p - y) * (p - y)), 6) AS brier, count(*) AS n FROM pred",
    "q48_quote_exact": """WITH q AS (SELECT doc_id AS gap_id, text AS source, substring(text, 11, 60) AS quote, CASE n_chars % 3 WHEN 0 THEN 10 WHEN 1 THEN 4 END AS s FROM documents), r AS (SELECT *, s + length(quote) AS e FROM q),
        x AS (SELECT *, CASE WHEN trim(quote) = '' OR coalesce(e > length(source), false) THEN 'invalid' WHEN s IS NOT NULL AND substring(source, s + 1, length(quote)) = quote THEN 'exact' WHEN strpos(source, quote) > 0 THEN 'found' ELSE 'search' END AS k FROM r)
        SELECT gap_id, CASE k WHEN 'found' THEN 'exact' ELSE k END AS status, CASE k WHEN 'exact' THEN s WHEN 'found' THEN strpos(source, quote) - 1 END::INTEGER AS start, CASE k WHEN 'exact' THEN e WHEN 'found' THEN strpos(source, quote) - 1 + length(quote) END::INTEGER AS end FROM x""",
    "q50_reference_integrity": f"WITH {GAPS} SELECT issue, count(*) AS n, count(DISTINCT gap_id) AS gaps, sum(value)::BIGINT AS values FROM issues GROUP BY 1",
    "q51_critique_class": f"WITH {GAPS}, bad AS (SELECT gap_id, count(*) AS k FROM issues WHERE issue IN ('unknown item', 'unknown need') GROUP BY 1) SELECT gap_id, CASE WHEN coalesce(k, 0) > 0 THEN 'UNSUPPORTED' WHEN len(signal_ids) < 2 OR valid = 0 OR (o_orderstatus <> 'F' AND item_id IS NULL) THEN 'WEAK' ELSE 'DEFENSIBLE' END AS critique FROM gaps LEFT JOIN bad USING (gap_id)",
    "q52_verification_totals": "SELECT count(DISTINCT l_orderkey) AS gaps, count(*) FILTER (l_returnflag = 'N') AS valid_quotes, count(*) AS checked_quotes FROM lineitem",
    "q53_rank_calibrated": f"WITH {RANKED} SELECT id, title, score, rank FROM top",
    "q54_title_dedup": f"WITH {PARTS} SELECT id, title, score FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY score DESC, id) AS k FROM sc) WHERE k = 1",
    "q55_priority_bands": f"""WITH RECURSIVE {PARTS}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY score DESC, confidence DESC, opportunity DESC, id) AS tk FROM sc WHERE verdict <> 'COVERED' AND critique <> 'UNSUPPORTED') WHERE tk = 1),
        others AS (SELECT count(*) FILTER (NOT starts_with(lower(title), 'small ')) AS k FROM one), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, confidence DESC, opportunity DESC, id)::INTEGER AS rank FROM one, others WHERE k < 3 OR NOT starts_with(lower(title), 'small ')),
        top AS (SELECT * FROM r WHERE rank <= 20), b AS (SELECT rank, score, 1 AS band, score AS high FROM top WHERE rank = 1 UNION ALL SELECT t.rank, t.score, CASE WHEN (b.high - t.score) / nullif(b.high, 0) > 0.01 THEN b.band + 1 ELSE b.band END, CASE WHEN (b.high - t.score) / nullif(b.high, 0) > 0.01 THEN t.score ELSE b.high END FROM b JOIN top t ON t.rank = b.rank + 1)
        SELECT t.id, t.title, t.score, t.rank, b.band::INTEGER AS band, CASE WHEN count(*) OVER (PARTITION BY b.band) > 1 THEN 'order only' ELSE 'separated' END AS label, round((lag(t.score) OVER (ORDER BY t.rank) - t.score) / nullif(lag(t.score) OVER (ORDER BY t.rank), 0), 6) AS margin_to_previous FROM top t JOIN b USING (rank)""",
    "q56_assignment_counts": "WITH c AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45) SELECT count(*) AS signals, count(c.id) AS assigned, count(*) - count(c.id) AS unassigned FROM part LEFT JOIN c ON id = p_partkey",
    "q57_corpus_term_search": f"""WITH {SIGNALS}, o AS (SELECT doc_id AS id, 'G' || toxic AS owner FROM labels), h AS (SELECT s.id, s.rating, o.owner FROM signals s LEFT JOIN o USING (id) WHERE contains(lower(text), 'tion') OR contains(lower(text), 'heit')),
        w AS (SELECT id, rating FROM h WHERE owner IS NULL ORDER BY coalesce(rating, 5), id LIMIT 3)
        SELECT 'summary' AS kind, count(owner)::VARCHAR AS key, count(*) AS n, round(avg(rating) FILTER (owner IS NULL AND rating > 0), 6) AS x FROM h UNION ALL SELECT 'owner', owner, count(*), NULL FROM h WHERE owner IS NOT NULL GROUP BY owner UNION ALL SELECT 'worst', id::VARCHAR, 1, rating FROM w""",
    "q58_need_search": "SELECT p_partkey AS id, p_name AS title, round((contains(lower(p_name), 'red')::INTEGER + contains(lower(p_name), 'widget')::INTEGER + contains(lower(p_name), 'ring')::INTEGER) / 3.0::DOUBLE, 6) AS hit_share FROM part WHERE hit_share > 0 ORDER BY hit_share DESC, id LIMIT 5",
    "q59_evidence_bands": """WITH n AS (SELECT o_custkey AS c_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1), x AS (SELECT * FROM customer LEFT JOIN n USING (c_custkey))
        SELECT CASE WHEN n IS NULL THEN 'Unverified' WHEN n * 3 >= 50 AND p = 0 THEN 'Strong' WHEN n * 3 >= 10 THEN 'Moderate' ELSE 'Limited' END AS evidence_band, CASE WHEN coalesce(n, 0) >= 12 THEN 'High' WHEN coalesce(n, 0) >= 8 THEN 'Moderate' ELSE 'Low' END AS opportunity_band,
               CASE WHEN c_acctbal / 10000 >= 0.9 THEN 'Stable' WHEN c_acctbal / 10000 >= 0.6 THEN 'Fairly stable' ELSE 'Unstable' END AS stability_band, count(*) AS customers FROM x GROUP BY 1, 2, 3""",
    "q60_pairwise_explain": f"WITH {FEATURES}, {BREAKDOWN}, d AS (SELECT a.feature, a.contribution AS ca, b.contribution AS cb, round(a.contribution - b.contribution, 6) AS delta FROM breakdown a JOIN breakdown b USING (feature) WHERE a.gap_id = 1 AND b.gap_id = 2) SELECT feature, round(ca, 6) AS contribution_a, round(cb, 6) AS contribution_b, delta, row_number() OVER (ORDER BY abs(delta) DESC, feature)::INTEGER AS position FROM d",
    "q61_audit_counts": f"WITH {ROADMAP} SELECT type, 'open' AS state, tier, count(*) AS n, 0::BIGINT AS bad_ids, 0::BIGINT AS no_priority, count(*) FILTER (is_low) AS low FROM roadmap GROUP BY ALL",
    "q62_reconcile_full_outer": """WITH a AS (SELECT c_custkey, c_name, c_mktsegment AS segment, c_nationkey FROM customer WHERE c_acctbal > -900), b AS (SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS segment, nullif(c_nationkey, 3) AS c_nationkey FROM customer WHERE c_acctbal < 9800),
        j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'right only' WHEN b.c_custkey IS NULL THEN 'left only' ELSE 'differs' END AS status, CASE WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.segment IS DISTINCT FROM b.segment THEN 'segment' END, CASE WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'c_nationkey' END) END AS differing FROM a FULL JOIN b ON a.c_custkey = b.c_custkey)
        SELECT * FROM j WHERE status <> 'differs' OR differing <> ''""",
    "q63_except_compare": """WITH o AS (SELECT o_orderpriority, o_orderstatus, o_custkey % 10 AS k FROM orders), a AS (SELECT * FROM o WHERE o_orderstatus <> 'F'), b AS (SELECT * FROM o WHERE o_orderpriority <> '1-URGENT'), d AS (SELECT *, 'before' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'after' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
        SELECT side, o_orderpriority, o_orderstatus, count(*) AS n, sum(k)::BIGINT AS k FROM d GROUP BY 1, 2, 3""",
    "q64_reviewer_merge": """WITH x AS (SELECT CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS v1, CASE WHEN quality + toxic > 0 THEN CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END END AS v2 FROM labels)
        SELECT v1 AS verdict_1, v2 AS verdict_2, v1 = v2 AS agreed, CASE WHEN v1 = v2 THEN v1 END AS verdict, 'first' AS notes, false AS adjudicated, count(*) AS n FROM x WHERE v2 IS NOT NULL GROUP BY ALL""",
    "q65_label_binding": """WITH l AS (SELECT l_orderkey AS gap_id, l_linenumber AS position, bool_or(l_returnflag = 'A') AS y FROM lineitem WHERE l_quantity > 40 AND l_linenumber <> 1 GROUP BY 1, 2), d AS (SELECT gap_id, arg_max(y, position) AS y FROM l GROUP BY 1)
        SELECT o_orderkey AS gap_id, coalesce(d.y, c_acctbal > 5000) AS y FROM orders LEFT JOIN d ON gap_id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey WHERE coalesce(d.y, c_acctbal > 5000) IS NOT NULL""",
    "q70_report_projection": f"""WITH {RANKED}, v AS (SELECT l_partkey AS id, count(*) AS checked, count(*) FILTER (l_returnflag = 'N') AS valid FROM lineitem GROUP BY 1), s AS (SELECT title, round(avg(confidence), 6) AS survival FROM g GROUP BY 1)
        SELECT top.id, top.title, rank, score, n_name AS item_title, CASE WHEN n_name IS NOT NULL THEN 'open' END AS item_state, coalesce(checked, 0) AS checked_quotes, coalesce(valid, 0) AS valid_quotes, coalesce(valid, 0) AS withheld, survival FROM top LEFT JOIN v USING (id) LEFT JOIN nation ON n_nationkey = top.id % 25 LEFT JOIN s ON s.title = top.title""",
    "q71_inventory_states": f"""WITH {RANKED} SELECT CASE g.verdict WHEN 'IGNORED' THEN 'no matching item' WHEN 'UNDER-PRIORITIZED' THEN 'planned late' ELSE 'planned' END || '/' || CASE WHEN top.id IS NULL THEN 'false' ELSE 'true' END AS state, count(*) AS n FROM g LEFT JOIN top USING (id) GROUP BY 1""",
    "q72_consensus": """WITH a AS (SELECT user_id, lower(event_type) AS s, count(*) AS k FROM events WHERE value >= 5 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, s) AS p, sum(k) OVER (PARTITION BY user_id) AS valid FROM a)
        SELECT user_id, s AS signature, round(k / valid::DOUBLE, 6) AS agreement, round(k / valid::DOUBLE * valid / 400, 6) AS self_consistency FROM r WHERE p = 1""",
    "q73_snapshot_time": "SELECT max(greatest(o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END)) AS snapshot FROM orders",
    "q74_packet_validation": """WITH r AS (SELECT doc_id AS id, quality = 1 AS ok FROM labels), s AS (SELECT doc_id AS id FROM documents WHERE lang <> 'es'), x AS (SELECT coalesce(r.id, s.id) AS id, r.id IS NULL AS missing, s.id IS NULL AS alien, ok FROM r FULL JOIN s ON r.id = s.id)
        SELECT CASE WHEN missing THEN 'missing' WHEN alien THEN 'alien' WHEN id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000) THEN 'unmatched' WHEN NOT ok THEN 'unadjudicated' ELSE 'matched' END AS status, count(*) AS n, sum(id)::BIGINT AS ids FROM x GROUP BY 1""",
    "q75_worklist_drift": "SELECT o_totalprice <= 20000 AS stale, CASE WHEN o_totalprice > 20000 AND o_orderstatus = 'P' THEN 'o_orderstatus' ELSE '' END AS drifted, count(*) AS n FROM orders GROUP BY 1, 2",
}


SQL["q78_blind_packets"] = "SELECT reviewer, count(*) AS n, count(*) AS places, 0::BIGINT AS least, count(*) - 1 AS most, sum(doc_id)::BIGINT AS ids FROM labels, (VALUES ('ann'), ('ben'), ('cleo')) r(reviewer) GROUP BY 1"
SQL["q80_stream_ingest"] = SQL["q01_ingest_dedup"]


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
