"""The whole analysis on small signals and backlogs, its guards, and the injected judges."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gapengine.functions.shared import Tables
from gapengine.operators import clustering, ingest, verdict, verify
from gapengine.plans import analyze, guards

NOW = datetime(2026, 1, 1)
THEMES = {
    "access": ("cannot login, the password and account session is broken", 8), "content": ("draft lost in the editor, publish of the post fails", 6),
    "stability": ("crash and freeze, a bug makes the screen stuck", 6), "images": ("image upload fails and the page editor is slow", 6),
}


def signals(spark):
    rows = [(f"S{k:04d}", "reviews", f"{text} number{k % 2}", NOW, 1.0 + k % 2) for k, text in enumerate(t for t, n in THEMES.values() for _ in range(n))]
    return spark.createDataFrame(rows, "id string, source string, text string, timestamp timestamp, rating double")


def backlog(spark, rows=None):
    rows = rows or [(1, "Login and password session problems", "account login fails", []), (2, "Keep written drafts", "publish a post without loss", ["P3"]), (3, "New colours", "palette", []), (4, "Translate menus", "languages", []), (5, "Update licences", "legal", [])]
    issues = spark.createDataFrame([(n, t, b, "open", None, labels, None, None, None, NOW, NOW, None, "u", None) for n, t, b, labels in rows], "number int, title string, body string, state string, state_reason string, labels array<string>, milestone string, milestone_number int, milestone_due timestamp, created_at timestamp, updated_at timestamp, closed_at timestamp, html_url string, pull_request string")
    none = spark.createDataFrame([], "number int, title string, body string, state string, due timestamp, created_at timestamp, updated_at timestamp, closed_at timestamp, html_url string")
    return ingest.roadmap(issues, none, "owner/name", F.lit(NOW))


def test_analysis_from_signals_to_ranking(spark):
    result = analyze.analyze(signals(spark), backlog(spark), analyze.Config(low=0.05, high=0.95, min_cluster=2), as_of="2026-01-02")
    needs = result.needs.collect()
    assert needs and [(-n.opportunity_score, n.id) for n in needs] == sorted((-n.opportunity_score, n.id) for n in needs)
    assert sum(len(n.signal_ids) for n in needs) <= 26 and all(n.kano_class == "basic" for n in needs)
    m = result.manifest
    assert m["signals"] == 26 and m["assigned_signals"] + m["unassigned_signals"] == 26 and m["needs"] == len(needs) and m["ranked"] + m["shortfall"] == 5
    assert all(r.valid for r in result.reports.collect()) and result.reports.count() >= m["verified"]
    ranked = result.ranked.collect()
    assert len(ranked) == m["ranked"] >= 1 and len({r.title for r in ranked}) == len(ranked)
    result.release()
    with pytest.raises(Exception):  # noqa: B017 - its tables are gone
        result.gaps.collect()


def test_analysis_refuses_bad_input(spark):
    s, b = signals(spark), backlog(spark)
    for x, y in ((s.union(s.limit(1)), b), (s.withColumn("id", F.lit("")), b), (s, b.limit(0))):
        with pytest.raises(ValueError):
            analyze.analyze(x, y)


def framing_need(spark):
    return spark.createDataFrame([("N1", "Dependable sync of records", "arrive together across devices reliably tomorrow", "duplicate merge conflict spinner", ["S1"], 12.0, "basic", 1.0)], "id string, latent_need string, jtbd_statement string, symptom string, signal_ids array<string>, opportunity_score double, kano_class string, self_consistency double")


@pytest.mark.parametrize("titles, misunderstood", [(["duplicate merge conflict spinner"], True), (["duplicate merge conflict spinner", "arrive together across devices reliably tomorrow"], False), (["arrive together across devices reliably tomorrow"], False)])
def test_misunderstood_needs(spark, titles, misunderstood):
    items = backlog(spark, [(k, t, "", []) for k, t in enumerate([*titles, "palette of colours"], 1)])
    gap = analyze.detect_gaps(framing_need(spark), items, analyze.Config(low=0.05, high=0.95), as_of="2026-01-02", keep_covered=True).collect()
    assert [g.verdict == "MISUNDERSTOOD" for g in gap] == [misunderstood]


def ambiguous(spark):
    schema = "need_id string, item_id string, latent_need string, jtbd_statement string, full string, similarity double, verdict string, closed boolean, is_misunderstood boolean"
    return spark.createDataFrame([("N1", "R1", "a", "b", "the whole text", 0.5, "IGNORED", False, False), ("N2", "R1", "a", "b", "the whole text", 0.5, "IGNORED", True, False), ("N3", "R1", "a", "b", "the whole text", 0.9, "COVERED", False, False), ("N4", "R1", "a", "b", "the whole text", 0.5, "MISUNDERSTOOD", False, True), ("N5", None, "a", "b", None, 0.5, "IGNORED", False, False)], schema)


@pytest.mark.parametrize("answer, first", [({"verdict": "COVERED", "item_id": "R1", "quote": "whole"}, "COVERED"), ({"verdict": "COVERED", "item_id": "R1", "quote": "hole in it"}, "IGNORED"), ({"verdict": "COVERED", "item_id": "R2", "quote": "whole"}, "IGNORED"), ({"verdict": "MISUNDERSTOOD", "item_id": "R1", "quote": "whole"}, "IGNORED"), (None, "IGNORED")])
def test_adjudicator_is_checked(spark, answer, first):
    got = {r.need_id: r.verdict for r in verdict.adjudicated(ambiguous(spark), lambda row: answer).collect()}
    assert got == {"N1": first, "N2": "IGNORED", "N3": "COVERED", "N4": "MISUNDERSTOOD", "N5": "IGNORED"}


def test_critic_can_only_raise_severity(spark):
    gaps = spark.createDataFrame([("G1", "x", "IGNORED", "WEAK", ["S1", "S2"])], "id string, latent_need string, verdict string, critique string, signal_ids array<string>")
    for answer, want in (({"critique": "UNSUPPORTED", "cited": ["S1"]}, "UNSUPPORTED"), ({"critique": "DEFENSIBLE", "cited": []}, "WEAK"), ({"critique": "UNSUPPORTED", "cited": ["S9"]}, "WEAK"), (None, "WEAK")):
        assert verify.criticised(gaps, lambda row, answer=answer: answer).first().critique == want


def test_item_quotes_and_spans(spark):
    gaps = spark.createDataFrame([("G1", "R1", "second line"), ("G2", "R1", "not there at all, never"), ("G3", None, "x")], "id string, item_id string, roadmap_quote string")
    items = spark.createDataFrame([("R1", "Title", "second line", ["a"], None)], "id string, title string, body string, labels array<string>, milestone string")
    got = {r.gap_id: (r.valid, r.found_start) for r in verify.verified_quotes(verify.item_quotes(gaps, items)).collect()}
    assert got == {"G1": (True, 6), "G2": (False, None)}
    reports = spark.createDataFrame([("G1", "S1", "signal", True, "first", 0), ("G1", "S1", "signal", True, "last", 1), ("G1", "S2", "signal", False, "no", 0)], "gap_id string, id string, kind string, valid boolean, found_span string, position int")
    assert [(r.id, r.span) for r in verify.verified_spans(reports).collect()] == [("S1", "last")]


def test_guards(spark):
    s = signals(spark)
    assert guards.time_scope(s, "current", datetime(2026, 2, 1))["evidence_end"] == NOW
    for mode, when, states in (("current", datetime(2030, 1, 1), "all"), ("archive", NOW, "open"), ("other", NOW, "all")):
        with pytest.raises(ValueError):
            guards.time_scope(s, mode, when, states)
    assert guards.time_scope(s, "archive", datetime(2030, 1, 1), "all")["mode"] == "archive"
    label = lambda ys: spark.createDataFrame([(float(y),) for y in ys], "y double")
    assert guards.labels_suffice(label([0, 1] * 50)) and not guards.labels_suffice(label([0, 1] * 49)) and not guards.labels_suffice(label([1] * 200))
    assert [guards.model_status(*x) for x in ((False, 0, 0), (True, 0, 0), (True, 3, 1), (True, 3, 0))] == ["not_requested", "requested_but_no_calls", "partial", "ok"]


@pytest.mark.parametrize("n, fraction", [(1, 0.8), (37, 0.8), (5000, 0.3)])
def test_replicates_have_the_exact_size(spark, n, fraction):
    got = clustering.replicates(spark.range(n), 5, fraction).groupBy("replicate").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect()
    assert len(got) == 5 and all(r.n == r.ids == max(1, int(n * fraction)) for r in got)


def test_tables_are_deleted(spark):
    t = Tables(spark)
    kept = t.keep(spark.range(5).toDF("x"))
    assert kept.count() == 5
    t.release()
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(f"{t.folder}/0-table").count()
