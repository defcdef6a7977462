"""Need inference: resampled runs in one plan, stragglers, injected models, scores, similarities."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gapengine.functions.shared import Tables
from gapengine.operators import calibration, clustering
from gapengine.plans import analyze, inference
from tests.test_analyze import NOW, backlog, framing_need, signals

CONFIG = analyze.Config(low=0.05, high=0.95, min_cluster=2)


@pytest.fixture(scope="module")
def told(spark):
    return Tables(spark, "felt").keep(inference.felt(signals(spark), CONFIG))


def test_runs_in_one_plan_are_single_runs(spark, told):
    tables = Tables(spark)
    drawn = tables.keep(clustering.replicates(told, 2, 0.7, seed=5).withColumn("run", F.col("replicate").cast("long")).drop("replicate"))
    together, _, totals = inference.infer(drawn, CONFIG, tables)
    columns = ["latent_need", "signal_ids", "aspects", "kano_class", "importance", "opportunity_score", "support", "merged_from"]
    got = {}
    for r in together.collect():
        got.setdefault(r.run, []).append(tuple(map(str, (r[c] for c in columns))))
    assert totals == {1: 18, 2: 18} and len(got) == 2
    runs = []
    for k in (1, 2):
        alone = inference.infer(drawn.where(F.col("run") == k).withColumn("run", F.lit(0).cast("long")), CONFIG, tables)[0].collect()
        assert sorted(got[k]) == sorted(tuple(map(str, (r[c] for c in columns))) for r in alone)
        runs.append({r.latent_need: set(r.signal_ids) for r in alone})
    base_needs = inference.infer(told.withColumn("run", F.lit(0).cast("long")), CONFIG, tables)[0]
    base = base_needs.collect()
    steady = {r.title: r for r in inference.stability(signals(spark), CONFIG, 2, 0.7, 5, told=told, baseline=base_needs).collect()}
    for r in base:
        seen = [x[r.latent_need] for x in runs if r.latent_need in x]
        mean = sum(len(x & set(r.signal_ids)) / len(x | set(r.signal_ids)) for x in seen) / len(seen) if seen else 0.0
        assert (steady[r.latent_need].survival, steady[r.latent_need].mean_jaccard, steady[r.latent_need].shipped) == (round(len(seen) / 2, 4), round(mean, 4), True)
    assert {t for t, r in steady.items() if not r.shipped} == {t for x in runs for t in x} - {r.latent_need for r in base}
    with pytest.raises(ValueError):
        inference.stability(signals(spark), CONFIG, 0)


def test_stragglers_join_the_one_need_of_their_domain(spark):
    late = spark.createDataFrame([("S9000", "reviews", "my password, of the account; zebra quokka", NOW, 1.0), ("S9001", "reviews", "quokka zebra wombat lost", NOW, 1.0)], signals(spark).schema)
    rows = signals(spark).where("text like 'cannot login%'").unionByName(late)
    need, own = analyze.infer_needs(rows, CONFIG)
    found = need.collect()
    assert len(found) == 1 and "S9000" in found[0].signal_ids and "S9001" not in found[0].signal_ids and found[0].support == len(found[0].signal_ids) == own.count() == 9


def test_answers_of_a_model_are_checked_and_counted(spark, told):
    def extract(cluster):
        good = {"latent_need": "Stay signed in", "jtbd_statement": "When I return, I am in", "symptom": "login fails", "kano_class": "performance", "cited": cluster["ids"][:2]}
        if "login" not in cluster["texts"][0]:
            return [{**good, "cited": ["S_unknown"]}, {**good, "kano_class": "nonsense"}]  # nothing of it counts
        return [good, {**good, "latent_need": " stay  SIGNED in"}, {**good, "latent_need": "Another"}, {**good, "symptom": ""}]

    rows = told.withColumn("run", F.lit(0).cast("long"))
    found = inference.infer(rows, CONFIG, Tables(spark), extract=extract)[0].collect()
    plain = {r.latent_need for r in inference.infer(rows, CONFIG, Tables(spark))[0].collect()}
    mine = next(r for r in found if r.latent_need == "Stay signed in")
    assert (mine.kano_class, mine.symptom, mine.self_consistency, mine.samples, mine.failures, mine.support) == ("performance", "login fails", 0.5, 4, 1, 2)
    others = [r for r in found if r is not mine]
    assert others and all(r.latent_need in plain and (r.self_consistency, r.samples, r.failures) == (0.0, 2, 2) for r in others)


def test_proposed_merges_are_checked(spark, told):
    rows = told.withColumn("run", F.lit(0).cast("long"))
    before = inference.infer(rows, CONFIG, Tables(spark))[0].collect()
    assert len(before) >= 2
    for propose, left in ((lambda ns: [[ns[0]["id"], ns[1]["id"]]], len(before) - 1), (lambda ns: [[ns[0]["id"], "N_unknown"], [ns[0]["id"], ns[1]["id"]], [ns[0]["id"], ns[-1]["id"]]], len(before))):
        after = inference.infer(rows, CONFIG, Tables(spark), merge=propose)[0].collect()
        assert len(after) == left and (left == len(before) or max(len(r.merged_from) for r in after) == 2)


def test_scores_fuse_self_consistency_and_calibration(spark):
    gaps = spark.createDataFrame([("G1", ["S1", "S2"], 0.8, 3), ("G2", ["S1"], 0.4, 0)], "id string, signal_ids array<string>, self_consistency double, samples int")
    gaps = gaps.withColumn("stability", F.struct(F.lit("low").alias("gate"), F.lit(0.2).alias("margin"))).withColumn("eligible", F.lit(True))
    rows = spark.createDataFrame([("S1", "a", "login fails", 1.0, datetime(2025, 1, 1)), ("S2", "b", "login is bad", 2.0, datetime(2025, 2, 1))], "id string, source string, text string, rating double, timestamp timestamp")
    got = {}
    for how in ("harmonic", "minimum", "product", "none"):
        got[how] = {r.id: r for r in analyze.score_gaps(gaps, rows, analyze.Config(fusion=how)).collect()}
    a = got["none"]["G1"].analytic
    assert [round(got[h]["G1"].raw, 9) for h in ("harmonic", "minimum", "product", "none")] == [round(x, 9) for x in (2 * a * 0.8 / (a + 0.8), min(a, 0.8), a * 0.8, a)]
    assert got["harmonic"]["G1"].agree == 1.0 and got["harmonic"]["G2"].raw == got["none"]["G2"].raw and got["harmonic"]["G2"].fusion == "analytic-only" and got["harmonic"]["G2"].calibrated is None
    sure = analyze.score_gaps(gaps, rows, analyze.Config(), calibrator=calibration.Calibrator("platt", 2.0, -1.0)).collect()
    assert all(abs(r.calibrated - 1 / (1 + 2.718281828459045 ** (1 - 2 * r.raw))) < 1e-5 and r.confidence_status == "calibrated_probability" for r in sure)


def test_three_similarities_and_coverage_of_the_whole_backlog(spark):
    """The job is covered by an item outside of the pool: told, but not part of the verdict."""
    near = [(k, "Dependable sync of records arrive together duplicate", "conflict spinner merge", []) for k in range(1, 11)]
    items = backlog(spark, [*near, (11, "across devices reliably tomorrow", " ".join(f"unlike{k} other{k * 7}" for k in range(80)), [])])
    r = analyze.detect_gaps(framing_need(spark), items, CONFIG, as_of="2026-01-02", keep_covered=True).first()
    assert r.job_coverage_corpus > r.job_coverage and r.job_item_corpus is not None and r.job_item_corpus != r.item_id
    assert len({r.similarity, r.symptom_similarity, r.job_similarity}) == 3 and all(0 <= x <= 1 for x in (r.similarity, r.symptom_similarity, r.job_similarity))


def many_signals(spark, n):
    return spark.createDataFrame([(f"S{k:05d}", "reviews", f"cannot login, the password and account session is broken number{k % 2}", NOW, 1.0) for k in range(n)], signals(spark).schema)


def test_all_members_of_a_large_cluster_count(spark):
    """130 equal complaints, of which 40 were kept before: all stand in the needs and in stability, and all are quoted."""
    need, own = analyze.infer_needs(many_signals(spark, 130), CONFIG)
    found = need.collect()
    assert sorted(i for r in found for i in r.signal_ids) == [f"S{k:05d}" for k in range(130)] and sum(r.support for r in found) == own.count() == 130
    assert sum(r.baseline_signals for r in inference.stability(many_signals(spark, 130), CONFIG, 1).collect() if r.shipped) == 130
    result = analyze.analyze(many_signals(spark, 130), backlog(spark), CONFIG, as_of="2026-01-02")
    assert result.manifest["assigned_signals"] == 130 and result.reports.where("kind = 'signal'").select("id").distinct().count() == 130
    result.release()


def test_a_model_is_shown_every_member_once(spark, monkeypatch):
    """In pages of at most max_members; what it cites on each page is in the need."""
    monkeypatch.setattr(inference, "BIN", 50)
    members = spark.createDataFrame([(c, f"S{k:05d}") for c, n in ((1, 130), (2, 7)) for k in range(n)], "cluster_no long, item string")
    pages = inference.paged(members, 20).groupBy("cluster_no", "bin", "page").agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in pages) <= 20 and sum(r.n for r in pages) == 137 and len({r.bin for r in pages}) == 3

    def extract(cluster):
        assert len(cluster["ids"]) <= 40
        return [{"latent_need": "Stay signed in", "jtbd_statement": "When I return, I am in", "symptom": "login fails", "kano_class": "basic", "cited": cluster["ids"]}]

    rows = inference.felt(many_signals(spark, 130), CONFIG).withColumn("run", F.lit(0).cast("long"))
    found = inference.infer(rows, CONFIG, Tables(spark), extract=extract)[0].collect()
    assert {i for r in found for i in r.signal_ids} == {f"S{k:05d}" for k in range(130)}
    assert all((r.latent_need, r.self_consistency, r.failures) == ("Stay signed in", 1.0, 0) for r in found) and max(r.samples for r in found) >= 2
