"""The engine's operators applied to the driver's tables, one query for each group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.functions import numbers, text, udfs
from gapengine.functions.shared import Tables, spread
from gapengine.lexicon import Lexicon
from gapengine.operators import audit, calibration, clustering, confidence, evidence, framing, ingest, labeling, needs, priority, rank, report, similarity, verdict, verify
from gapengine.plans import analyze, inference
from gapengine.streaming import ingest as stream_ingest

#: Function words of the tables' invented languages stand in for sentiment and domain words, so that the operators have something to find.
LEXICON = Lexicon(positive=frozenset({"is", "was"}), negative=frozenset({"that", "with"}), intense=frozenset({"for"}), friction=frozenset({"by"}), phrases=("thshe", "the of"))
DOMAINS = {"access": ("of", "the"), "content": ("de", "la", "les"), "stability": ("der", "die", "und")}
ASPECTS = ("and", "de", "der", "is", "la", "of", "que", "the")
AS_OF = "2001-08-01 00:00:00"
LOW, HIGH = 0.30, 0.45
TERMS = ("tion", "heit")


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "orders", "customer", "conversations") else df  # dear to go through: texts, label rules


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """documents as signals: rated by the quality label, where there is one."""
    docs, labels = t(spark, sf, "documents"), t(spark, sf, "labels")
    rated = docs.select("doc_id", "text", "source", "lang").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return rated.select(F.col("doc_id").alias("id"), "text", "source", "lang", (1.0 + 4 * F.col("quality")).alias("rating"))


def felt(spark: SparkSession, sf: str) -> DataFrame:
    return needs.sentiment(signals(spark, sf), LEXICON)


def domain_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, w) for d, ws in DOMAINS.items() for w in ws], "domain string, word string")


def review_rows(spark: SparkSession, sf: str, rating=None) -> DataFrame:
    docs = t(spark, sf, "documents")
    if rating is None:
        docs = signals(spark, sf).withColumnRenamed("id", "doc_id")
        rating = F.col("rating")
    return docs.select(F.col("source").alias("package"), "text", rating.cast("string").alias("rating"), F.lit(None).cast("string").alias("time"), F.col("doc_id").alias("source_id"), F.lit("").alias("version"))


def q01_ingest_dedup(spark, sf):
    rows = ingest.triaged(review_rows(spark, sf)).where("status = 'ok'")
    return ingest.deduplicated(rows, "documents").select("id", "source_id", "package_name", "rating", F.col("metadata.duplicate_count").alias("duplicate_count"), F.length("text").alias("text_length"))


def q02_ingest_stats(spark, sf):
    return ingest.statistics(ingest.triaged(review_rows(spark, sf, F.col("n_chars") % 6 + 1), "SRC0"))


def q03_dataset_profile(spark, sf):
    return ingest.profile(t(spark, sf, "events"), "event_type", "props", "ts")


def q04_text_tokens(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.get("w", F.lit(0)).alias("first_token"))


def q05_stable_ids(spark, sf):
    d = t(spark, sf, "documents").select("source", text.stable_id("S", [F.col("source"), F.col("doc_id"), text.folded(F.col("text"))]).alias("id"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.min("id").alias("least"), text.ids_id("N", F.collect_list("id")).alias("need_id"))


def backlog(spark, sf):
    """orders as items, customers' segments as milestones."""
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    both = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    milestone = F.when(F.col("c_mktsegment") == "MACHINERY", "Backlog").when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    created = F.col("o_orderdate").cast("timestamp")
    due = F.timestamp_add("DAY", (F.col("o_custkey") % 400).cast("int"), created)
    items = both.select(F.col("o_orderkey").alias("item_id"), F.array("o_orderpriority").alias("labels"), milestone.alias("milestone"), due.alias("due"), created.alias("created"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"))
    return items.withColumn("priority", priority.derived(F.col("labels"), F.col("milestone"), F.col("due"), F.col("created"), F.col("state"), as_of()))


def low_backlog(spark, sf):
    b = backlog(spark, sf)
    return b.withColumn("low_reasons", priority.low_reasons(F.col("priority"), F.col("milestone"), F.col("due"), F.col("created"), F.col("state"), as_of()))


def q06_label_tier(spark, sf):
    o = t(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("label"), F.coalesce(priority.tier(F.array("o_orderpriority")), F.lit("unspecified")).alias("tier")).groupBy("label", "tier").agg(F.count("*").alias("n"))


def q07_priority_metadata(spark, sf):
    p = F.col("priority")
    return backlog(spark, sf).select("item_id", p["tier"].alias("tier"), p["score"].alias("score"), p["is_low_priority"].alias("is_low"), p["has_explicit_priority"].alias("is_explicit"), F.array_join(p["reasons"], "; ").alias("reasons"))


def q08_priority_is_low(spark, sf):
    return low_backlog(spark, sf).select("item_id", (F.size("low_reasons") > 0).alias("is_low"), F.array_join("low_reasons", ",").alias("reasons"))


def q09_reason_firing_rates(spark, sf):
    return priority.firing_rates(low_backlog(spark, sf))


def forge(spark, sf):
    """customers as issues, nations outside the first region as listed milestones."""
    c, n = t(spark, sf, "customer"), t(spark, sf, "nation")
    none = lambda kind: F.lit(None).cast(kind)
    milestones = n.where("n_regionkey <> 0").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("title"), F.lit("").alias("body"), F.lit("open").alias("state"), F.to_timestamp(F.lit("2001-12-01 00:00:00")).alias("due"), *[none("timestamp").alias(x) for x in ("created_at", "updated_at", "closed_at")], none("string").alias("html_url"))
    issues = c.select(
        F.col("c_custkey").cast("int").alias("number"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body"), F.lit("open").alias("state"), none("string").alias("state_reason"), F.array(F.when(F.col("c_acctbal") > 8000, "P1").otherwise("p3"), F.col("c_mktsegment")).alias("labels"),
        F.lit("embedded").alias("milestone"), F.col("c_nationkey").alias("milestone_number"), none("timestamp").alias("milestone_due"), *[none("timestamp").alias(x) for x in ("created_at", "updated_at", "closed_at")], none("string").alias("html_url"), F.when(F.col("c_acctbal") < 0, "yes").alias("pull_request"),
    )
    return issues, milestones


def q10_milestone_join(spark, sf):
    return ingest.with_milestones(*forge(spark, sf)).select("number", "milestone", "milestone_due")


def q11_roadmap_union(spark, sf):
    out = ingest.roadmap(*forge(spark, sf), "owner/name", as_of())
    return out.select("id", "type", "number", "title", F.array_join("labels", ",").alias("labels"), "milestone", F.col("priority.tier").alias("tier"), F.col("priority.is_low_priority").alias("is_low"))


def q12_sentiment(spark, sf):
    return felt(spark, sf).select("id", F.col("n_positive").cast("long").alias("n_positive"), F.col("n_negative").cast("long").alias("n_negative"), F.round("sentiment", 6).alias("sentiment"), F.round("intensity", 6).alias("intensity"))


def q13_friction_partition(spark, sf):
    marked = felt(spark, sf).withColumn("kept", needs.has_friction(LEXICON))
    return marked.groupBy("source", "kept").agg(F.count("*").alias("n"))


def q14_signal_aspect(spark, sf):
    return needs.aspect(felt(spark, sf), ASPECTS)


def q15_cluster_aspects(spark, sf):
    out = needs.cluster_aspects(felt(spark, sf), "source")
    return out.select("source", "aspect", "tf", "df", "score", "rank")


def q16_domain_match(spark, sf):
    return needs.domain_match(felt(spark, sf), domain_words(spark), "source")


def q17_grounding_semi(spark, sf):
    f, d = felt(spark, sf), domain_words(spark)
    return needs.grounded(f, needs.domain_match(f, d, "source"), d, "source").groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def q18_kano(spark, sf):
    k = needs.kano(felt(spark, sf), "source")
    return k.select("source", F.round("negative_share", 6).alias("negative_share"), F.round("mean_intensity", 6).alias("mean_intensity"), "kano_class")


def q19_need_score(spark, sf):
    f = felt(spark, sf)
    total = t(spark, sf, "documents").count()
    s = needs.scored(f, "source", total)
    return s.select("source", "support", *[F.round(x, 6).alias(x) for x in ("importance", "satisfaction", "opportunity")])


def q20_temporal_scope(spark, sf):
    return needs.temporal_scope(t(spark, sf, "events"), "user_id", "ts")


def q21_attach_stragglers(spark, sf):
    f = felt(spark, sf)
    table = spark.createDataFrame([("N1", "access"), ("N2", "content"), ("N3", "content"), ("N4", "stability")], "need_id string, domain string")
    return needs.stragglers(f, f.where("lang = 'en'"), table, domain_words(spark))


def pairs(spark, sf):
    return similarity.redundant_pairs(t(spark, sf, "embeddings"), 0.4, "vec_id", "embedding")


def q22_redundancy_pairs(spark, sf):
    return pairs(spark, sf).select("a", "b", F.round("similarity", 6).alias("similarity"))


def q23_components(spark, sf):
    return similarity.redundant_groups(t(spark, sf, "embeddings"), 0.4, "vec_id", "embedding")


def q24_merge_groups(spark, sf):
    e = t(spark, sf, "embeddings")
    table = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("need "), F.col("label")).alias("latent_need"), ((F.col("vec_id") * 37) % 2000 / 100).alias("opportunity"), F.array("vec_id", F.col("vec_id") % 50).alias("signal_ids"), F.array(F.concat(F.lit("a"), F.col("label"))).alias("aspects"), (F.col("label") / 100).alias("self_consistency"), F.col("label").cast("long").alias("failures"))
    out = needs.merged(table, similarity.redundant_groups(e, 0.4, "vec_id", "embedding"))
    return out.select("id", "latent_need", F.array_join("signal_ids", ",").alias("signal_ids"), F.array_join("aspects", ",").alias("aspects"), F.round("self_consistency", 6).alias("self_consistency"), "failures", F.array_join("merged_from", ",").alias("merged_from"))


def q25_cosine_topk_pool(spark, sf):
    e = t(spark, sf, "embeddings")
    return similarity.top_k(e, e, framing.POOL, "vec_id", "vec_id", "embedding", "embedding").select("query_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


def doc_terms(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), text.framing_terms(F.col("text"), sorted(LEXICON.stop)).alias("terms"))


def turns(spark, sf):
    """A user's turn (symptom) and the answer that follows (job)."""
    c = t(spark, sf, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("symptom"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("job"))
    both = user.join(answer, ["conv_id", "turn"])
    stop = sorted(LEXICON.stop)
    return both.select(F.concat_ws(":", "conv_id", "turn").alias("need_id"), text.framing_terms(F.col("symptom"), stop).alias("symptom_terms"), text.framing_terms(F.col("job"), stop).alias("job_terms"))


def probe_parts(spark, sf):
    tables = Tables(spark, "probes")
    own, docs = tables.keep(turns(spark, sf), "turns"), tables.keep(doc_terms(spark, sf), "terms")  # each is read several times
    probe = framing.probes(own, framing.document_frequency(docs), t(spark, sf, "documents").count())
    return own, docs, tables.keep(probe, "probes")


def q26_document_frequency(spark, sf):
    return framing.document_frequency(doc_terms(spark, sf))


def q27_probes(spark, sf):
    _, _, probe = probe_parts(spark, sf)
    return probe.select("need_id", "side", "term", F.round("idf", 6).alias("idf"), F.col("k").cast("int").alias("k"))


def q28_coverage(spark, sf):
    _, docs, probe = probe_parts(spark, sf)
    return framing.best_covered(probe, docs)


def q29_framing_verdict(spark, sf):
    own, docs, probe = probe_parts(spark, sf)
    return framing.verdicts(own, probe, framing.best_covered(probe, docs))


def matched(spark, sf):
    """Each vector with the nearest other one, and attributes that stand for priority and state."""
    e = t(spark, sf, "embeddings")
    top = similarity.top_k(e, e, 2, "vec_id", "vec_id", "embedding", "embedding").where("rank = 2")
    other = e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label"))
    m = top.join(other, "item_id").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    m = m.withColumn("similarity", F.round("similarity", 6))
    return m.select(F.col("query_id").alias("id"), "item_id", "similarity", (F.col("item_label") % 2 == 1).alias("low_priority"), (F.col("item_label") % 3 == 0).alias("closed"), (F.col("label") % 5 == 4).alias("misunderstood"), F.col("label"))


def verdict_of(m):
    return verdict.verdict(F.col("misunderstood"), F.col("similarity"), F.col("low_priority"), LOW, HIGH)


def q30_verdict_tree(spark, sf):
    m = matched(spark, sf)
    return m.select("id", "item_id", "similarity", verdict_of(m).alias("verdict"))


def q31_closed_guard(spark, sf):
    m = matched(spark, sf)
    v = verdict.guarded(verdict_of(m), F.col("closed"))
    return m.select(v.alias("verdict"), verdict.public_state(v).alias("state"), "closed").groupBy("verdict", "state", "closed").agg(F.count("*").alias("n"))


def q32_verdict_stability(spark, sf):
    m = matched(spark, sf).withColumn("symptom", F.round(0.5 + F.col("similarity") / 4, 6)).withColumn("job", F.round(0.5 - F.col("similarity") / 5, 6))
    s = verdict.stability(F.col("misunderstood"), F.col("similarity"), F.col("low_priority"), F.col("symptom"), F.col("job"), F.col("closed"), LOW, HIGH)
    return m.select("id", s["gate"].alias("gate"), s["margin"].alias("margin"), s["flips_to"].alias("flips_to"), s["is_borderline"].alias("is_borderline"))


def q33_threshold_grid(spark, sf):
    m = matched(spark, sf)
    expected = F.when(F.col("misunderstood"), "MISUNDERSTOOD").when(F.col("similarity") < 0.33, "IGNORED").when(F.col("low_priority"), "UNDER-PRIORITIZED").otherwise("COVERED")
    rows = m.select(F.col("id").alias("position"), "similarity", "low_priority", F.col("misunderstood").alias("is_misunderstood"), expected.alias("expected"))
    return verdict.tuned(rows, [0.3, 0.32, 0.34, 0.36], [0.38, 0.42, 0.46])


def q34_evidence_join(spark, sf):
    c = t(spark, sf, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    gaps = c.groupBy(F.col("conv_id").alias("gap_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"]).alias("signal_ids"))
    out = evidence.evidence(gaps, c.where("role = 'user'").select("id", "text"))
    return out.select("gap_id", F.col("n_cited").cast("long").alias("n_cited"), F.size("quotes").cast("long").alias("n_quotes"), F.md5(F.array_join(F.transform("quotes", lambda q: q["span"]), "|").cast("binary")).alias("spans"))


def cited(spark, sf):
    """events as citations: a user is a gap, an event type a source."""
    e = t(spark, sf, "events")
    rating = F.least(1 + F.floor(F.col("value") / 100), F.lit(5)).cast("double")
    return e.select(F.col("user_id").alias("gap_id"), F.col("event_id").alias("signal_id"), (F.col("event_type") != "error").alias("resolved"), F.col("event_type").alias("source"), confidence.signal_sentiment(F.lit(None).cast("double"), rating).alias("sentiment"), F.col("ts").cast("timestamp").alias("timestamp"))


def scored_gaps(spark, sf):
    f = confidence.features(cited(spark, sf))
    agree = confidence.agreement(F.col("resolved"), F.lit(0))
    f = f.withColumn("agree", agree).withColumn("coh", F.round(0.05 + (F.col("gap_id") % 10) / 20, 6)).withColumn("selfc", confidence.self_consistency(F.lit(0.8), F.col("gap_id") % 3))
    return f.select("gap_id", "cited", "resolved", *[F.round(x, 6).alias(x) for x in ("vol", "div", "sent", "rec", "cons", "agree", "coh", "selfc")])


def q35_conf_features(spark, sf):
    return scored_gaps(spark, sf)


def q36_evidence_score(spark, sf):
    g = scored_gaps(spark, sf).withColumn("raw", confidence.evidence_score())
    fuse = lambda how: F.round(confidence.fused(F.col("raw"), F.col("selfc"), how, F.col("gap_id") % 3 > 0), 6).alias(how)
    return g.select("gap_id", F.round("raw", 6).alias("raw"), fuse("harmonic"), fuse("minimum"), fuse("product"))


def q37_breakdown_unpivot(spark, sf):
    b = confidence.breakdown(scored_gaps(spark, sf))
    return b.select("gap_id", "feature", "value", "weight", F.round("contribution", 6).alias("contribution"))


def q38_feature_diagnostics(spark, sf):
    return confidence.diagnostics(scored_gaps(spark, sf))


def q39_counterevidence(spark, sf):
    c = confidence.counterevidence(cited(spark, sf))
    return c.select("gap_id", "resolved", "n_dissent", "share", F.md5(F.array_join("signal_ids", ",").cast("binary")).alias("ids"))


def q40_cohesion(spark, sf):
    c = similarity.cohesion(t(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", "n", F.round("cohesion", 6).alias("cohesion"))


def q41_weakest_assumption(spark, sf):
    c = confidence.counterevidence(cited(spark, sf)).select("gap_id", "share")
    g = scored_gaps(spark, sf).join(c, "gap_id")
    gate = F.when(F.col("gap_id") % 2 == 0, "low").otherwise("symptom")
    w = confidence.weakest_assumption(gate, (F.col("gap_id") % 7) / 50, 0.38, F.col("share"), F.col("coh"), F.col("gap_id") % 4 != 0, F.col("vol"))
    return g.select("gap_id", w["severity"].alias("severity"), w["factor"].alias("factor"))


def predicted(spark, sf):
    d, labels = t(spark, sf, "documents"), t(spark, sf, "labels")
    p = F.least(F.lit(1.0), F.log1p(F.col("n_chars").cast("double")) / F.log(F.lit(20001.0)))
    return labels.select("doc_id", F.col("quality").alias("y")).join(d.select("doc_id", F.round(p, 9).alias("p")), "doc_id")


def q42_reliability_bins(spark, sf):
    r = calibration.reliability(predicted(spark, sf))
    return r.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


def q43_ece(spark, sf):
    return calibration.expected_error(calibration.reliability(predicted(spark, sf))).select(F.round("ece", 6).alias("ece"), "n")


def q44_brier(spark, sf):
    return calibration.brier(predicted(spark, sf)).select(F.round("brier", 6).alias("brier"), "n")


def q45_platt(spark, sf):
    rows = predicted(spark, sf).withColumnRenamed("p", "score")
    return calibration.fit(rows, "platt").apply(rows).select("doc_id", "score", "p", "y")


def q46_isotonic(spark, sf):
    rows = predicted(spark, sf).withColumnRenamed("p", "score")
    return calibration.fit(rows, "isotonic").apply(rows).select("doc_id", "score", "p", "y")


def q47_crossfit(spark, sf):
    rows = predicted(spark, sf).withColumnRenamed("p", "score")
    return calibration.cross_fitted(rows, "doc_id").select("doc_id", "fold", "p", "y")


def quotes(spark, sf):
    """A piece of each document as a quote of it, with right offsets, wrong ones or none."""
    q = t(spark, sf, "documents").select(F.col("doc_id").alias("gap_id"), "n_chars", F.col("text").alias("source"), F.substring("text", 11, 60).alias("quote"))
    start = F.when(F.col("n_chars") % 3 == 0, 10).when(F.col("n_chars") % 3 == 1, 4)
    return q.withColumn("start", start).withColumn("end", F.col("start") + F.length("quote"))


def q48_quote_exact(spark, sf):
    q = quotes(spark, sf)
    x = verify.exact_quote(F.col("quote"), F.col("source"), F.col("start"), F.col("end"))
    return q.select("gap_id", x["status"].alias("status"), x["start"].alias("start"), x["end"].alias("end"))


def q49_quote_fuzzy(spark, sf):
    b = t(spark, sf, "benchmark")
    changed = F.regexp_replace(F.col("text"), r"^(\S+) (\S+)", "$2 $1x")
    q = b.select(F.col("item_id").alias("gap_id"), F.col("text").alias("source"), changed.alias("quote"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return verify.canonicalised(verify.verified_quotes(q, 0.8)).select("gap_id", "valid", "score", "method", "start", "end", "quote")


def order_gaps(spark, sf):
    """orders as gaps that cite their parts and quote some of them."""
    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("gap_id")).agg(F.array_sort(F.collect_list("l_partkey")).alias("signal_ids"), F.array_sort(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey") + F.col("l_linenumber") % 2 * (F.col("l_suppkey") % 2)))).alias("quote_ids"), F.count_if(F.col("l_returnflag") == "N").alias("valid"))
    return o.select(F.col("o_orderkey").alias("gap_id"), F.col("o_custkey").alias("need_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 40).alias("item_id"), "o_orderstatus").join(lines, "gap_id")


def issues(spark, sf):
    parts = t(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"))
    people = t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    nations = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return verify.reference_issues(order_gaps(spark, sf), parts, people, nations)


def q50_reference_integrity(spark, sf):
    return issues(spark, sf).groupBy("issue").agg(F.count("*").alias("n"), F.countDistinct("gap_id").alias("gaps"), F.sum("value").alias("values"))


def q51_critique_class(spark, sf):
    bad = issues(spark, sf).where("issue in ('unknown item', 'unknown need')").groupBy("gap_id").agg(F.count("*").alias("issues"))
    g = order_gaps(spark, sf).join(bad, "gap_id", "left")
    kind = F.when(F.col("o_orderstatus") == "F", "IGNORED").otherwise("COVERED")
    c = verify.critique(F.coalesce("issues", F.lit(0)), F.size("signal_ids"), F.col("valid"), kind, F.col("item_id"))
    return g.select("gap_id", c.alias("critique"))


def q52_verification_totals(spark, sf):
    return verify.totals(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("gap_id"), (F.col("l_returnflag") == "N").alias("valid")))


def part_gaps(spark, sf):
    """parts as gaps; few names, so titles repeat."""
    p = t(spark, sf, "part")
    kind = F.when(F.col("p_size") % 4 == 0, "COVERED").when(F.col("p_size") % 4 == 1, "IGNORED").otherwise("UNDER-PRIORITIZED")
    crit = F.when(F.col("p_type") == "ECONOMY", "UNSUPPORTED").otherwise("DEFENSIBLE")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), kind.alias("verdict"), crit.alias("critique"), F.round(F.least(F.lit(1.0), F.col("p_retailprice") / 3000), 6).alias("confidence"), F.round(F.col("p_size") * 0.4, 6).alias("opportunity"), F.col("p_size").cast("long").alias("evidence"))


def q53_rank_calibrated(spark, sf):
    return rank.ranked(part_gaps(spark, sf), 5).select("id", "title", "score", "rank")


def q54_title_dedup(spark, sf):
    g = part_gaps(spark, sf).withColumn("score", rank.rank_score(F.col("confidence"), F.col("opportunity")))
    return rank.unique_titles(g, [-F.col("score"), F.col("id")]).select("id", "title", "score")


def q55_priority_bands(spark, sf):
    g = part_gaps(spark, sf).withColumnRenamed("confidence", "raw")
    return rank.ranked_uncalibrated(g, 20, "small ").select("id", "title", "score", "rank", "band", "label", "margin_to_previous")


def q56_assignment_counts(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    n = t(spark, sf, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("signal_ids"))
    return rank.assignment(p, n)


def owners(spark, sf):
    return t(spark, sf, "labels").select(F.col("doc_id").alias("signal_id"), F.concat(F.lit("G"), F.col("toxic")).alias("gap_id"), F.col("doc_id").alias("position"))


def q57_corpus_term_search(spark, sf):
    summary, by_owner, worst = report.corpus_search(signals(spark, sf), owners(spark, sf), list(TERMS))
    cols = lambda kind, key, n, x: [F.lit(kind).alias("kind"), key.cast("string").alias("key"), n.cast("long").alias("n"), x.cast("double").alias("x")]
    out = summary.select(*cols("summary", F.col("cited"), F.col("matches"), F.col("mean_uncovered_rating")))
    return out.unionByName(by_owner.select(*cols("owner", F.col("owner"), F.col("n"), F.lit(None)))).unionByName(worst.select(*cols("worst", F.col("id"), F.lit(1), F.col("rating"))))


def q58_need_search(spark, sf):
    return report.need_search(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), "a red widget or ring")


def q59_evidence_bands(spark, sf):
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    x = c.join(n, "c_custkey", "left")
    bands = [report.evidence_band(F.coalesce(F.col("n") * 3, F.lit(0)), F.coalesce("p", F.lit(0)) == 0, F.col("n").isNotNull()).alias("evidence_band"), report.opportunity_band(F.coalesce("n", F.lit(0))).alias("opportunity_band"), report.stability_band(F.col("c_acctbal") / 10000).alias("stability_band")]
    return x.select(*bands).groupBy("evidence_band", "opportunity_band", "stability_band").agg(F.count("*").alias("customers"))


def q60_pairwise_explain(spark, sf):
    return report.pairwise(confidence.breakdown(scored_gaps(spark, sf)), 1, 2).select("feature", F.round("contribution_a", 6).alias("contribution_a"), F.round("contribution_b", 6).alias("contribution_b"), "delta", "position")


def q61_audit_counts(spark, sf):
    return audit.ingest_audit(ingest.roadmap(*forge(spark, sf), "owner/name", as_of()))


def q62_reconcile_full_outer(spark, sf):
    c = t(spark, sf, "customer")
    raw = c.where("c_acctbal > -900").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), "c_nationkey")
    now = c.where("c_acctbal < 9800").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") == "BUILDING", "CONSTRUCTION").otherwise(F.col("c_mktsegment")).alias("segment"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("c_nationkey"))
    return audit.reconciled(raw, now, ["c_custkey"], ["c_name", "segment", "c_nationkey"])


def q63_except_compare(spark, sf):
    o = t(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 10).alias("k"))
    return audit.changed(o.where("o_orderstatus <> 'F'"), o.where("o_orderpriority <> '1-URGENT'")).groupBy("side", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def reviewers(spark, sf):
    x = t(spark, sf, "labels")
    name = lambda c: F.when(F.col(c) == 1, "yes").otherwise("no")
    one = x.select(F.col("doc_id").alias("pair_id"), name("quality").alias("verdict"), F.lit("first").alias("notes"))
    two = x.select(F.col("doc_id").alias("pair_id"), F.when(F.col("quality") + F.col("toxic") > 0, name("toxic")).alias("verdict"), F.lit(None).cast("string").alias("notes"))
    return one, two


def q64_reviewer_merge(spark, sf):
    m = labeling.merged(*reviewers(spark, sf))
    return m.groupBy("verdict_1", "verdict_2", "agreed", "verdict", "notes", "adjudicated").agg(F.count("*").alias("n"))


def q65_label_binding(spark, sf):
    o = t(spark, sf, "orders")
    gaps = o.select(F.col("o_orderkey").alias("gap_id"), F.col("o_custkey").alias("need_id"), (F.col("o_custkey") % 40).alias("roadmap_id"))
    li = t(spark, sf, "lineitem")
    direct = li.where("l_quantity > 40").select(F.col("l_orderkey").alias("gap_id"), F.lit(None).cast("long").alias("need_id"), F.lit(None).cast("long").alias("roadmap_id"), (F.col("l_returnflag") == "A").alias("outcome"), F.when(F.col("l_linenumber") == 1, False).alias("adjudicated"), F.col("l_linenumber").alias("position"))
    c = t(spark, sf, "customer")
    pair = c.select(F.lit(None).cast("long").alias("gap_id"), F.col("c_custkey").alias("need_id"), (F.col("c_custkey") % 40).alias("roadmap_id"), (F.col("c_acctbal") > 5000).alias("outcome"), F.lit(True).alias("adjudicated"), F.lit(0).alias("position"))
    # a line number can repeat within an order here: the later of equals is the outcome that is true
    direct = direct.groupBy("gap_id", "need_id", "roadmap_id", "adjudicated", "position").agg(F.max("outcome").alias("outcome"))
    direct = direct.groupBy("gap_id", "need_id", "roadmap_id", "position").agg(F.max("outcome").alias("outcome"), F.max("adjudicated").alias("adjudicated"))
    return calibration.joined_labels(gaps, direct.unionByName(pair))


def q66_stability_resample(spark, sf):
    s = signals(spark, sf).select("id", "source")
    group = lambda df, *keys: df.groupBy(*keys, F.col("source").alias("title")).agg(F.collect_set("id").alias("signal_ids"))
    return clustering.bootstrap(s, lambda r: group(r, "replicate"), group(s), 10)


def q67_kmeans(spark, sf):
    e = t(spark, sf, "embeddings")
    return clustering.k_means(e, "vec_id", "embedding", e.count())


def q68_greedy_cluster(spark, sf):
    e = t(spark, sf, "embeddings").withColumn("part", F.floor(F.col("vec_id") / 90))
    return clustering.greedy(e, "vec_id", "embedding", "part")


def q69_hash_embed(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", udfs.hash_embed(F.col("text")).alias("v")).select("doc_id", F.size("v").alias("size"), F.round(numbers.dot(F.col("v"), F.col("v")), 4).alias("norm"))


def q70_report_projection(spark, sf):
    top = rank.ranked(part_gaps(spark, sf), 5)
    findings = top.select("id", "title", "verdict", (F.col("id") % 25).alias("item_id"), "rank", "score")
    li = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("gap_id"), (F.col("l_returnflag") == "N").alias("valid"), F.col("l_linestatus").alias("span"))
    items = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"), F.lit("open").alias("state"))
    stable = part_gaps(spark, sf).groupBy("title").agg(F.round(F.avg("confidence"), 6).alias("survival"))
    return report.projection(findings, li, items, stable).select("id", "title", "rank", "score", "item_title", "item_state", "checked_quotes", "valid_quotes", "withheld", "survival")


def q71_inventory_states(spark, sf):
    g = part_gaps(spark, sf)
    out = report.inventory(g, rank.ranked(g, 5)).withColumn("state", verdict.public_state(F.col("verdict")))
    return report.state_counts(out.withColumn("state", F.concat_ws("/", "state", F.col("is_shipped").cast("string"))))


def q72_consensus(spark, sf):
    e = t(spark, sf, "events")
    answers = e.select("user_id", F.when(F.col("value") >= 5, F.concat(F.lit("  "), F.upper("event_type"))).alias("answer"))
    return needs.consensus(answers, "user_id", "answer", F.lit(400))


def q73_snapshot_time(spark, sf):
    o = t(spark, sf, "orders")
    return evidence.snapshot_time(o.select(F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.timestamp_add("DAY", F.lit(3), F.col("o_orderdate").cast("timestamp"))).alias("updated_at")))


def q74_packet_validation(spark, sf):
    x, d = t(spark, sf, "labels"), t(spark, sf, "documents")
    returned = x.select(F.col("doc_id").alias("pair_id"), (F.col("quality") == 1).alias("adjudicated"))
    sent = d.where("lang <> 'es'").select(F.col("doc_id").alias("pair_id"))
    gaps = d.where("n_chars > 1000").select(F.col("doc_id").alias("pair_id"))
    return labeling.validated(returned, sent, gaps).groupBy("status").agg(F.count("*").alias("n"), F.sum("pair_id").alias("ids"))


def q75_worklist_drift(spark, sf):
    o = t(spark, sf, "orders")
    work = o.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    now = o.where("o_totalprice > 20000").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    return labeling.drift(work, now, "o_orderkey", ["o_orderstatus", "o_orderpriority"]).groupBy("stale", "drifted").agg(F.count("*").alias("n"))


def q76_pool_coverage(spark, sf):
    """Coverage within a pool: of a turn, the first ten documents by id of the source whose number is the conversation's modulo 20."""
    own, docs, probe = probe_parts(spark, sf)
    d = t(spark, sf, "documents")
    rank = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    top = d.select("source", F.col("doc_id").alias("item_id"), rank.alias("pool_rank")).where("pool_rank <= 10")
    pool = own.select("need_id", F.concat(F.lit("src"), F.substring_index("need_id", ":", 1).cast("long") % 20).alias("source")).join(top, "source").select("need_id", "item_id", "pool_rank")
    return framing.best_covered(probe, docs, pool)


def q77_analysis(spark, sf):
    """The whole analysis: users' turns as signals, benchmark items as the backlog."""
    c, b = t(spark, sf, "conversations"), t(spark, sf, "benchmark")
    s = c.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("turns").alias("source"), "text", as_of().alias("timestamp"), (1.0 + F.col("conv_id") % 5).alias("rating"))
    none = lambda kind: F.lit(None).cast(kind)
    issues = b.select(
        F.col("item_id").cast("int").alias("number"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"), F.when(F.col("item_id") % 3 == 0, "closed").otherwise("open").alias("state"), none("string").alias("state_reason"), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("P3"))).otherwise(F.array().cast("array<string>")).alias("labels"),
        none("string").alias("milestone"), none("int").alias("milestone_number"), none("timestamp").alias("milestone_due"), as_of().alias("created_at"), as_of().alias("updated_at"), none("timestamp").alias("closed_at"), none("string").alias("html_url"), none("string").alias("pull_request"),
    )
    milestones = spark.createDataFrame([], "number int, title string, body string, state string, due timestamp, created_at timestamp, updated_at timestamp, closed_at timestamp, html_url string")
    lexicon = Lexicon(negative=LEXICON.negative, positive=LEXICON.positive, domains={d: frozenset(w) for d, w in DOMAINS.items()}, templates={d: (f"Needs of {d}", f"When {d} matters") for d in DOMAINS})
    result = analyze.analyze(s, ingest.roadmap(issues, milestones, "owner/name", as_of()), analyze.Config(low=0.1, high=0.6, lexicon=lexicon), as_of=AS_OF)
    return result.ranked.select("id", "title", "verdict", "critique", "score", "rank")


def q78_blind_packets(spark, sf):
    """labels as pairs for three reviewers: each has all of them, once, in places from 0 on."""
    pairs = t(spark, sf, "labels").select(F.col("doc_id").alias("pair_id"), "quality")
    out = labeling.packets(pairs, ["pair_id"], ["ann", "ben", "cleo"], 7)
    return out.groupBy("reviewer").agg(F.count("*").alias("n"), F.count_distinct("position").alias("places"), F.min("position").alias("least"), F.max("position").alias("most"), F.sum("pair_id").alias("ids"))


def q79_need_stability(spark, sf):
    """Users' turns as signals: how often each need comes back on five subsamples."""
    c = t(spark, sf, "conversations")
    s = c.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("turns").alias("source"), "text", as_of().alias("timestamp"), (1.0 + F.col("conv_id") % 5).alias("rating"))
    lexicon = Lexicon(negative=LEXICON.negative, positive=LEXICON.positive, domains={d: frozenset(w) for d, w in DOMAINS.items()}, templates={d: (f"Needs of {d}", f"When {d} matters") for d in DOMAINS})
    return inference.stability(s, analyze.Config(lexicon=lexicon), 5)


def q80_stream_ingest(spark, sf):
    """documents arrive as a stream of reviews; its state ends as q01's signals."""
    tables = Tables(spark, "stream")
    review_rows(spark, sf).write.parquet(f"{tables.folder}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{tables.folder}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{tables.folder}/in")
    stream_ingest.write(rows, f"{tables.folder}/out", f"{tables.folder}/state").awaitTermination()
    out = stream_ingest.current(spark.read.parquet(f"{tables.folder}/out"), "documents")
    return out.select("id", "source_id", "package_name", "rating", F.col("metadata.duplicate_count").alias("duplicate_count"), F.length("text").alias("text_length"))


def flagship(spark, sf):
    """Adjacent turns as needs, documents as the backlog: probes, coverage, verdicts, stability, unique titles and rank."""
    own, docs, probe = probe_parts(spark, sf)
    v = framing.verdicts(own, probe, framing.best_covered(probe, docs))
    low, closed = F.col("job_coverage") > 0, F.lit(False)
    kind = verdict.guarded(verdict.verdict(F.col("is_misunderstood"), F.col("symptom_coverage"), low), closed)
    told = verdict.stability(F.col("is_misunderstood"), F.col("symptom_coverage"), low, F.col("symptom_coverage"), F.col("job_coverage"), closed)
    rows = v.select(F.col("need_id").alias("id"), F.coalesce(F.col("symptom_item").cast("string"), F.lit("")).alias("title"), kind.alias("verdict"), F.lit("DEFENSIBLE").alias("critique"), F.round(F.greatest("symptom_coverage", F.lit(0.05)), 6).alias("confidence"), F.round(numbers.opportunity(10 * F.col("symptom_coverage"), 10 * F.col("job_coverage")), 6).alias("opportunity"), F.lit(1).cast("long").alias("evidence"), told.alias("told"))
    return rank.ranked(rows, 50).select("id", "title", "verdict", "score", "rank", F.col("told.gate").alias("gate"), F.col("told.margin").alias("margin"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k[0] == "q" and k[1:3].isdigit() and callable(f)}
