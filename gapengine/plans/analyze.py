"""The whole analysis: signals and backlog in, ranked and verified gaps out, as one chain of DataFrames.

What several later steps read is written to the run's tables, so each plan begins at a scan and no step is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapengine.functions import numbers, text, udfs
from gapengine.functions.shared import Tables
from gapengine.lexicon import DEFAULT, Lexicon
from gapengine.operators import calibration, confidence, evidence, framing, needs, priority, rank, similarity, verdict, verify
from gapengine.plans import guards, inference


@dataclass
class Config:
    low: float = verdict.LOW
    high: float = verdict.HIGH
    merge_at: float = 0.9
    min_cluster: int = 3
    #: Members of a cluster that a model is shown at a time; all are shown.
    max_members: int = 40
    top_k: int = 5
    dimensions: int = 256
    fuzzy: float = verify.THRESHOLD
    lexicon: Lexicon = field(default_factory=lambda: DEFAULT)
    weights: dict[str, float] = field(default_factory=lambda: dict(confidence.WEIGHTS))
    fusion: str = "harmonic"


def infer_needs(signals: DataFrame, config: Config, embed: Callable | None = None, tables: Tables | None = None, extract: Callable | None = None, merge: Callable | None = None, told: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Needs (id, latent_need, jtbd_statement, symptom, signal_ids, kano_class, importance, satisfaction, opportunity_score, …), the highest opportunity first, ties by id, and the members (need_id, id, …).

    signals(id, text, source, rating, timestamp); told: inference.felt(signals), if it was made before. extract and merge: see inference.infer().
    """
    tables = tables or Tables(signals.sparkSession, "needs")
    told = tables.keep(inference.felt(signals, config, embed), "felt") if told is None else told
    out, own, _ = inference.infer(told.withColumn("run", F.lit(0).cast("long")), config, tables, embed, extract, merge)
    return out.drop("run").orderBy(F.desc("opportunity_score"), "id"), own.drop("run")


def detect_gaps(need: DataFrame, items: DataFrame, config: Config, embed: Callable | None = None, as_of=None, keep_covered: bool = False, tables: Tables | None = None, adjudicate: Callable | None = None) -> DataFrame:
    """A row for each need: its matched item, similarity, framing, priority, verdict and stability, highest opportunity first. items as operators.ingest.roadmap() gives them.

    adjudicate: see operators.verdict.adjudicated(); without it the thresholds decide alone.
    """
    tables = tables or Tables(need.sparkSession, "gaps")
    embed = embed or (lambda c: udfs.hash_embed(c, config.dimensions))
    stop = sorted(config.lexicon.stop)
    whole = text.joined_text(F.col("title"), F.col("body"), F.array_join("labels", " "), F.col("milestone"))
    backlog = items.withColumn("full", whole).withColumn("vec", embed(F.col("full"))).withColumn("terms", text.framing_terms(F.col("full"), stop))
    backlog = tables.keep(backlog, "backlog")
    latent = text.joined_text(F.col("latent_need"), F.col("jtbd_statement"))
    side = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col("latent_need"))
    parts = {"vec": latent, "symptom_vec": side("symptom"), "job_vec": side("jtbd_statement")}
    own = need.withColumns({k: embed(v) for k, v in parts.items()}).withColumn("symptom_terms", text.framing_terms(side("symptom"), stop)).withColumn("job_terms", text.framing_terms(side("jtbd_statement"), stop))
    own = tables.keep(own, "own")
    pool = tables.keep(similarity.top_k(own, backlog, framing.POOL, "id", "id", "vec", "vec", tables).select(F.col("query_id").alias("need_id"), "item_id", "similarity", F.col("rank").alias("pool_rank")), "pool")
    df = framing.document_frequency(backlog)
    named = own.select(F.col("id").alias("need_id"), "symptom_terms", "job_terms")
    probe = tables.keep(framing.probes(named, df, backlog.count()), "probes")
    item_terms = backlog.select(F.col("id").alias("item_id"), "terms")
    frames = tables.keep(framing.verdicts(named, probe, framing.best_covered(probe, item_terms, pool.select("need_id", "item_id", "pool_rank"))), "framings")
    # whether any item at all covers the job, in the pool or not: told beside the verdict, which goes by the pool
    wide = framing.best_covered(probe.where("side = 'job'"), item_terms, tables=tables).select("need_id", F.col("item_id").alias("job_item_corpus"), F.col("coverage").alias("job_coverage_corpus"))
    frames = frames.join(tables.keep(wide, "wide"), "need_id", "left").withColumn("job_coverage_corpus", F.coalesce("job_coverage_corpus", F.lit(0.0)))
    first = pool.where("pool_rank = 1").select("need_id", F.col("item_id").alias("top_item"))
    own = own if "samples" in own.columns else own.withColumn("samples", F.lit(0))
    m = own.select(F.col("id").alias("need_id"), "latent_need", "jtbd_statement", "signal_ids", "opportunity_score", "kano_class", "self_consistency", "samples").join(frames, "need_id").join(first, "need_id", "left")
    m = m.withColumn("item_id", F.when(F.col("is_misunderstood"), F.col("symptom_item")).otherwise(F.col("top_item")))
    when = F.lit(as_of).cast("timestamp") if as_of is not None else F.col("snapshot")
    low = priority.low_reasons(F.col("priority"), F.col("milestone"), F.col("milestone_due"), F.col("created_at"), F.col("state"), when)
    told = backlog.crossJoin(F.broadcast(evidence.snapshot_time(items))).select(F.col("id").alias("item_id"), F.col("title").alias("item_title"), "full", "state", low.alias("low_reasons"))
    # all three similarities are to the one item that the gap cites
    three = similarity.candidate_similarity(own, backlog, {"similarity": "vec", "symptom_similarity": "symptom_vec", "job_similarity": "job_vec"}, "vec", m.where("item_id is not null").select("need_id", "item_id"))
    m = tables.keep(m.join(told, "item_id", "left").join(three, ["need_id", "item_id"], "left"), "matched")
    m = m.withColumns({c: F.coalesce(numbers.clip(F.col(c)), F.lit(0.0)) for c in ("similarity", "symptom_similarity", "job_similarity")})
    m = m.withColumn("is_low", F.coalesce(F.size("low_reasons") > 0, F.lit(False))).withColumn("closed", F.coalesce(F.col("state") == "closed", F.lit(False)))
    v = verdict.guarded(verdict.verdict(F.col("is_misunderstood"), F.col("similarity"), F.col("is_low"), config.low, config.high), F.col("closed"))
    s = verdict.stability(F.col("is_misunderstood"), F.col("similarity"), F.col("is_low"), F.col("symptom_coverage"), F.col("job_coverage"), F.col("closed"), config.low, config.high)
    m = tables.keep(m.withColumn("verdict", v).withColumn("stability", s), "verdicts")
    if adjudicate:
        m = tables.keep(verdict.adjudicated(m, adjudicate, config.low, config.high), "adjudicated")
    hit_terms = probe.where("side = 'symptom'").groupBy("need_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("o"), "term"))), lambda x: x["term"]).alias("probe_terms"))
    m = m.join(hit_terms, "need_id", "left").withColumn("roadmap_quote", framing.quote(F.col("full"), F.col("item_title"), F.coalesce("probe_terms", F.array().cast("array<string>"))))
    out = m.select(evidence.gap_id(F.col("need_id"), F.coalesce("item_id", F.lit("")), F.col("verdict")).alias("id"), "need_id", "item_id", "latent_need", "jtbd_statement", "kano_class", "verdict", *[F.round(c, 6).alias(c) for c in ("similarity", "symptom_similarity", "job_similarity")], "signal_ids", "opportunity_score", "self_consistency", "samples", "eligible", "symptom_coverage", "job_coverage", "job_coverage_corpus", "job_item_corpus", "is_low", "closed", "stability", "item_title", "roadmap_quote", F.col("full").alias("item_text"))
    out = tables.keep(out if keep_covered else out.where("verdict <> 'COVERED'"), "gaps")
    return out.orderBy(F.desc("opportunity_score"), "id")


def score_gaps(gaps: DataFrame, signals: DataFrame, config: Config, embed: Callable | None = None, tables: Tables | None = None, told: DataFrame | None = None, calibrator: calibration.Calibrator | None = None) -> DataFrame:
    """Gaps with the features, the evidence score fused with self-consistency where answers were observed, dissent, the weakest assumption, their evidence's time scope, a calibrated confidence (null without a calibrator) and a status.

    told: inference.felt(signals), if it was made before. Only cited signals are embedded that have no vector there.
    """
    tables = tables or Tables(gaps.sparkSession, "scores")
    embed = embed or (lambda c: udfs.hash_embed(c, config.dimensions))
    if told is None:
        told = needs.sentiment(signals, config.lexicon).withColumn("vec", F.lit(None).cast("array<float>"))
    value = F.when(F.col("rating").isNotNull(), confidence.signal_sentiment(F.lit(None).cast("double"), F.col("rating"))).otherwise(F.col("sentiment"))
    told = told.select(F.col("id").alias("signal_id"), "source", value.alias("sentiment"), "timestamp", "text", "vec")
    cited = gaps.select(F.col("id").alias("gap_id"), F.explode(F.array_distinct("signal_ids")).alias("signal_id")).join(told, "signal_id", "left").withColumn("resolved", F.col("source").isNotNull())
    cited = cited.withColumn("vec", F.coalesce("vec", embed(F.when(F.col("vec").isNull(), F.col("text"))))).drop("text")
    cited = tables.keep(cited, "cited")
    feats = confidence.features(cited)
    coh = similarity.cohesion(cited.where("resolved"), "gap_id", "vec").select("gap_id", F.col("cohesion").alias("coh"))
    against = confidence.counterevidence(cited).select("gap_id", F.col("share").alias("dissent"))
    out = gaps.withColumnRenamed("id", "gap_id").join(feats, "gap_id", "left").join(coh, "gap_id", "left").join(against, "gap_id", "left")
    out = out if "samples" in out.columns else out.withColumn("samples", F.lit(0))
    out = out.withColumns({"agree": confidence.agreement(F.col("resolved"), F.col("samples")), "coh": F.coalesce("coh", F.lit(0.5)), "selfc": confidence.self_consistency(F.col("self_consistency"), F.col("samples"))})
    out = out.withColumn("analytic", confidence.evidence_score(weights=config.weights))
    out = out.withColumn("raw", F.round(confidence.fused(F.col("analytic"), F.col("selfc"), config.fusion, F.col("samples") > 0), 12)).withColumn("fusion", F.when(F.col("samples") > 0, config.fusion).otherwise("analytic-only"))
    weak = confidence.weakest_assumption(F.col("stability.gate"), F.col("stability.margin"), config.low, F.coalesce("dissent", F.lit(0.0)), F.col("coh"), F.col("eligible"), F.col("vol"))
    scope = cited.where("resolved").groupBy("gap_id").agg(F.min("timestamp").alias("evidence_start"), F.max("timestamp").alias("evidence_end"))
    known = calibrator is not None and calibrator.kind != "identity"
    out = out.withColumn("weakest", weak).withColumn("confidence_status", F.lit("calibrated_probability" if known else "uncalibrated_evidence_score_not_probability")).join(scope, "gap_id", "left")
    out = calibrator.apply(out, "raw", "calibrated").withColumn("calibrated", F.round(numbers.clip(F.col("calibrated")), 6)) if known else out.withColumn("calibrated", F.lit(None).cast("double"))
    return tables.keep(out.withColumnRenamed("gap_id", "id"), "scored")


def verify_gaps(gaps: DataFrame, signals: DataFrame, need: DataFrame, items: DataFrame, config: Config, tables: Tables | None = None, critic: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Gaps that aren't unsupported, with a critique, and the report of each quote of a signal or (kind item) of the backlog.

    critic: see operators.verify.criticised(); it can only raise a severity.
    """
    tables = tables or Tables(gaps.sparkSession, "verification")
    named = gaps.select(F.col("id").alias("gap_id"), "need_id", "item_id", "signal_ids", "verdict", F.col("signal_ids").alias("quote_ids"))
    spans = evidence.spans(named.select("gap_id", "signal_ids"), signals).where("span is not null")
    quotes = spans.join(signals.select("id", F.col("text").alias("source")), "id").select("gap_id", "id", F.col("span").alias("quote"), "source", F.lit(0).alias("start"), F.length("span").alias("end"))
    planned = verify.item_quotes(gaps, items)
    quotes = quotes.select("gap_id", "id", F.lit("signal").alias("kind"), "quote", "source", "start", "end").unionByName(planned)
    reports = tables.keep(verify.canonicalised(verify.verified_quotes(quotes, config.fuzzy)), "reports")
    issues = verify.reference_issues(named, signals, need, items).groupBy("gap_id").agg(F.count("*").alias("issues"))
    of_signals = F.col("kind") == "signal"
    valid = reports.groupBy("gap_id").agg(F.count_if(F.col("valid") & of_signals).alias("valid_quotes"), F.count_if(of_signals).alias("checked_quotes"), F.count_if(~of_signals & ~F.col("valid")).alias("bad_item_quotes"))
    out = gaps.join(issues.withColumnRenamed("gap_id", "id"), "id", "left").join(valid.withColumnRenamed("gap_id", "id"), "id", "left")
    out = out.withColumn("critique", verify.critique(F.coalesce("issues", F.lit(0)) + F.coalesce("bad_item_quotes", F.lit(0)), F.size(F.array_distinct("signal_ids")), F.coalesce("valid_quotes", F.lit(0)), F.col("verdict"), F.col("item_id")))
    out = tables.keep(out, "critiqued")
    if critic:
        out = tables.keep(verify.criticised(out, critic), "criticised")
    return out.where("critique <> 'UNSUPPORTED'"), reports


@dataclass
class Result:
    """The tables of a run. release() deletes them; until then they can be read as often as needed. stability is None unless it was asked for."""

    needs: DataFrame
    gaps: DataFrame
    ranked: DataFrame
    reports: DataFrame
    manifest: dict
    tables: Tables
    stability: DataFrame | None = None

    def release(self) -> None:
        self.tables.release()


def analyze(
    signals: DataFrame, items: DataFrame, config: Config | None = None, embed: Callable | None = None, as_of=None, calibrate: Callable[[DataFrame], DataFrame] | None = None, adjudicate: Callable | None = None, critic: Callable | None = None,
    extract: Callable | None = None, merge: Callable | None = None, calibrator: calibration.Calibrator | None = None, replicates: int = 0,
) -> Result:
    """needs, gaps, scores, calibration, verification, ranking and a manifest of counts; with replicates, the needs' stability under resampling.

    A calibrator ranks gaps by calibrated confidence; calibrate, a function that adds confidence to verified gaps, does so in its place. An empty backlog, and signals or items with empty or repeated ids, are errors.
    """
    config = config or Config()
    guards.unique_ids(signals, "signals")
    guards.unique_ids(items, "items")
    if items.isEmpty():
        raise ValueError("there is no backlog to compare with")
    tables = Tables(signals.sparkSession, "analysis")
    told = tables.keep(inference.felt(signals, config, embed), "felt")
    need, own = infer_needs(signals, config, embed, tables, extract, merge, told)
    gaps = score_gaps(detect_gaps(need, items, config, embed, as_of, tables=tables, adjudicate=adjudicate), signals, config, embed, tables, told, calibrator)
    verified, reports = verify_gaps(gaps, signals, need, items, config, tables, critic)
    rows = verified.withColumnRenamed("latent_need", "title").withColumnRenamed("opportunity_score", "opportunity").withColumn("evidence", F.size(F.array_distinct("signal_ids")))
    if calibrate is None and calibrator is not None and calibrator.kind != "identity":
        calibrate = lambda df: df.withColumn("confidence", F.col("calibrated"))
    ranked = tables.keep(rank.ranked(calibrate(rows), config.top_k) if calibrate else rank.ranked_uncalibrated(rows, config.top_k), "ranked")
    steady = inference.stability(signals, config, replicates, embed=embed, tables=tables, told=told, baseline=need) if replicates else None
    n, total = ranked.count(), told.count()
    assigned = own.select("id").distinct().count()
    manifest = {"signals": total, "assigned_signals": assigned, "unassigned_signals": total - assigned, "needs": need.count(), "gaps": gaps.count(), "verified": verified.count(), "ranked": n, "shortfall": rank.shortfall(config.top_k, n), "calibrated": calibrate is not None, "replicates": replicates}
    return Result(need, gaps, ranked, reports, manifest, tables, steady)
