"""Sources and sinks: aliases, limits, JSON artifacts, backlogs of a forge, downloads, pages. No network."""

from __future__ import annotations

import json
import os
import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gapengine.operators import ingest
from gapengine.plans import guards
from gapengine.sources import artifacts, download, forge, render, reviews

REVIEWS = '''id,package_name,review,date,star,version_id
1,org.demo,Crashes   on start,2026-01-01,1,10
2,org.demo,Crashes on start,2026-02-01,1,11
3,org.demo,Crashes on start,2026-02-01,5,11
4,org.demo,   ,2026-02-02,4,11
5,org.demo,Fine,2026-02-03,9,11
6,org.other,Great,2026-02-03,5,11
7,ORG.demo,"Works, ""mostly""",2/3/2026,4,11
'''
BACKLOG = {
    "repository": "Owner/Name", "state_scope": "open",
    "milestones": [{"number": 3, "title": "Backlog", "description": "later", "state": "open", "created_at": "2025-01-01T00:00:00Z", "updated_at": "2025-01-01T00:00:00Z", "due_on": "2027-01-01T00:00:00Z", "html_url": "https://github.com/Owner/Name/milestone/3"}],
    "issues": [
        {"number": 1, "title": "Login fails", "body": "text", "state": "open", "labels": [{"name": "P1"}, "p1"], "created_at": "2025-12-01T00:00:00Z", "updated_at": "2025-12-02T00:00:00Z", "html_url": "https://github.com/Owner/Name/issues/1"},
        {"number": 2, "title": "Dark mode", "state": "open", "labels": [], "milestone": {"number": 3, "title": "Backlog"}, "created_at": "2025-12-01T00:00:00Z", "updated_at": "2025-12-02T00:00:00Z", "html_url": "x"},
        {"number": 9, "title": "A pull request", "state": "open", "labels": [], "created_at": "2025-12-01T00:00:00Z", "updated_at": "2025-12-02T00:00:00Z", "html_url": "x", "pull_request": {"url": "y"}},
    ],
}


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_reviews_with_aliases(spark, tmp_path, kind):
    path = tmp_path / "reviews.csv"
    path.write_text("﻿" + REVIEWS)
    if kind == "parquet":
        reviews.read(spark, str(path)).withColumnRenamed("package", "App_ID").withColumnRenamed("text", " Review ").withColumnsRenamed({"rating": "stars", "time": "date", "source_id": "id", "version": "version_id"}).write.parquet(str(tmp_path / "r.parquet"))
        path = tmp_path / "r.parquet"
    rows = reviews.read(spark, str(path))
    assert rows.columns == list(reviews.ALIASES)
    triage = ingest.triaged(rows, "org.demo")
    stats = ingest.statistics(triage).first()
    assert (stats.total_rows, stats.matching_rows, stats.blank_rows, stats.invalid_rows, stats.duplicate_rows) == (7, 6, 1, 1, 1)
    signals = ingest.deduplicated(triage.where("status = 'ok'")).collect()
    twice = [s for s in signals if s.metadata.duplicate_count == 2]
    assert len(signals) == 3 and [s.source_id for s in twice] == ["2"] and {s.rating for s in signals if s.text == "Crashes on start"} == {1.0, 5.0}
    back = ingest.deduplicated(ingest.triaged(rows.orderBy(F.desc("source_id")), "org.demo").where("status = 'ok'")).collect()
    assert {s.id for s in back} == {s.id for s in signals}
    guards.require_match(ingest.statistics(triage), "org.demo")
    with pytest.raises(ValueError):
        guards.require_match(ingest.statistics(ingest.triaged(rows, "none")), "none")
    assert reviews.corpus_facts(rows, "org.demo").first().asDict() == {"rows": 7, "package_rows": 6, "packages": 2}
    assert reviews.limits(rows).isEmpty()


def test_reviews_refuse_what_they_cannot_read(spark, tmp_path):
    for path in ("//host/share", "\\\\host\\share", "/dev/zero", "ftp://x/y"):
        with pytest.raises(ValueError):
            reviews.safe_path(path)
    with pytest.raises(ValueError):
        reviews.resolve(["id", "star"])


def test_compatibility_forms_meet(spark):
    rows = spark.createDataFrame([("p", "ﬁne  app", "5", None, "1", None), ("p", "fine app", "5", None, "2", None)], "package string, text string, rating string, time string, source_id string, version string")
    assert ingest.deduplicated(ingest.triaged(rows)).count() == 1


def test_backlog_fixture(spark, tmp_path):
    path = tmp_path / "backlog.json"
    path.write_text(json.dumps(BACKLOG))
    issues, milestones, rest = forge.fixture(spark, [str(path)])
    guards.require_repository("owner/NAME", rest["repository"])
    guards.unique_numbers(issues, milestones)
    with pytest.raises(ValueError):
        guards.require_repository("other/name", rest["repository"])
    with pytest.raises(ValueError):
        guards.unique_numbers(issues.union(issues.where("number = 1")), milestones)
    guards.unique_numbers(issues.union(issues.where("number = 9")), milestones)
    scope = guards.scope(issues, milestones, "Owner/Name", rest["state_scope"])
    assert (scope["issues"], scope["pull_requests_excluded"], scope["milestones"]) == (2, 1, 1)
    items = {(r.type, r.number): r for r in ingest.roadmap(issues, milestones, "Owner/Name", F.lit("2026-01-01").cast("timestamp")).collect()}
    assert sorted(items) == [("issue", 1), ("issue", 2), ("milestone", 3)]
    one, two, m = items["issue", 1], items["issue", 2], items["milestone", 3]
    assert one.labels == ["P1"] and one.priority.tier == "high" and one.priority.has_explicit_priority and not one.priority.is_low_priority
    assert two.priority.is_low_priority and two.priority.tier == "backlog" and two.milestone_due == datetime(2027, 1, 1) and m.priority.tier == "backlog"


def fetch(url):
    """Transport of the forge source's test: two pages of issues."""
    rows = [i | {"number": i["number"] + (10 if "page=2" in url else 0)} for i in BACKLOG["issues"]] if "/issues" in url else BACKLOG["milestones"]
    link = f'<{url}&page=2>; rel="next"' if "/issues" in url and "page=2" not in url else None
    return rows, link


def test_forge_source(spark):
    spark.dataSource.register(forge.ForgeSource)
    df = spark.read.format("forge").option("base", "https://api.example.org").option("repository", "owner/name").option("transport", "tests.test_sources:fetch").load()
    issues, milestones = forge.from_source(df)
    assert sorted(r.number for r in issues.collect()) == [1, 2, 9, 11, 12, 19] and milestones.count() == 1


def test_forge_pages_and_answers():
    loop = lambda url: ([{}], f'<{url}>; rel="next"')
    away = lambda url: ([{}], '<https://elsewhere.org/x>; rel="next"')
    on = lambda url: ([{}] * 60, f'<{url}1>; rel="next"')
    for f, arguments in ((loop, {}), (away, {}), (on, {"max_pages": 3}), (on, {"max_items": 100})):
        with pytest.raises(ValueError):
            list(forge.pages(f, "https://api.example.org/x", **arguments))
    seen = []

    def transport(url, headers):
        seen.append(headers.get("authorization"))
        return 200, {"link": None}, "[]"

    forge.web_fetch("https://api.example.org/x", transport, "secret", "https://api.example.org")
    forge.web_fetch("https://elsewhere.org/x", transport, "secret", "https://api.example.org")
    assert seen == ["Bearer secret", None]
    with pytest.raises(PermissionError, match="rate limit"):
        forge.web_fetch("https://a.org", lambda u, h: (403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "9"}, ""))
    with pytest.raises(ValueError):
        forge.web_fetch("https://a.org", lambda u, h: (500, {}, ""))


def test_json_artifacts(spark, tmp_path):
    p = tmp_path / "a.json"
    artifacts.atomic_json(p, {"needs": [{"id": "N1", "n": 1}, {"id": "N2", "n": None}], "b": "é"})
    assert artifacts.strict_json(p, tmp_path)["b"] == "é" and [x.name for x in tmp_path.iterdir()] == ["a.json"]
    assert {r.id: r.n for r in artifacts.records(spark, str(p), "id string, n int", ("needs",)).collect()} == {"N1": 1, "N2": None}
    (tmp_path / "list.json").write_text('﻿[{"id": "x", "n": 3}]')
    assert artifacts.records(spark, str(tmp_path / "list.json"), "id string, n int").first().n == 3
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError):
            artifacts.strict_json(tmp_path / "bad.json")
    with pytest.raises(ValueError):
        artifacts.atomic_json(p, {"x": float("nan")})
    assert artifacts.strict_json(p)["b"] == "é"
    os.symlink(p, tmp_path / "link.json")
    with pytest.raises(ValueError):
        artifacts.strict_json(tmp_path / "link.json")
    with pytest.raises(ValueError):
        artifacts.strict_json(p, tmp_path / "deeper")


def test_artifact_digests(tmp_path):
    artifacts.atomic_json(tmp_path / "n.json", {"needs": [{"id": "N1"}, {"id": "N1"}]})
    artifacts.atomic_json(tmp_path / "g.json", [{"id": "G1"}])
    manifest = {"artifacts": {n: artifacts.sha256_file(tmp_path / n) for n in ("n.json", "g.json")} | {"gone.json": "0"}}
    assert artifacts.validated(manifest, tmp_path, {"n.json": "id", "g.json": "id"}) == ["gone.json is missing", "n.json has empty or repeated ids"]
    artifacts.atomic_json(tmp_path / "g.json", [])
    assert "g.json has changed" in artifacts.validated(manifest, tmp_path, {})
    assert artifacts.contract_hash({"a": 1, "b": {"d": 1, "c": 2}}) == artifacts.contract_hash({"b": {"c": 2, "d": 1}, "a": 1})
    assert artifacts.stale({"x": "1", "y": "2"}, {"x": "1", "y": "3", "z": "4"}) == ["y", "z"]


def test_download():
    public = lambda host: ["93.184.216.34"]
    answers = {"https://a.org/x": (302, {"location": "/y"}, []), "https://a.org/y": (200, {}, [b"ab", b"c"])}
    assert download.fetched("https://a.org/x", ["a.org"], answers.get, public) == b"abc"
    with pytest.raises(ValueError):
        download.fetched("https://a.org/y", ["a.org"], answers.get, public, most=2)
    with pytest.raises(ValueError):
        download.fetched("https://a.org/l", ["a.org"], lambda u: (302, {"location": u}, []), public)
    for url, resolve in (("http://a.org/", public), ("https://b.org/", public), ("https://u:p@a.org/", public), ("https://a.org:8443/", public), ("https://a.org/", lambda h: ["10.0.0.1"]), ("https://a.org/", lambda h: [])):
        with pytest.raises(ValueError):
            download.allowed(url, ["a.org"], resolve)


def test_page_and_plot(tmp_path):
    render.write_page(tmp_path / "p.html", "Findings", [{"rank": 1, "title": "<script>x</script>", "score": 2.5}], {"needs": 3}, private=True)
    text = (tmp_path / "p.html").read_text()
    assert "<script" not in text and "&lt;script&gt;" in text and "default-src 'none'" in text and os.stat(tmp_path / "p.html").st_mode & 0o777 == 0o600
    data = render.reliability_plot([{"bin": 0, "n": 3, "mean_p": 0.2, "mean_y": 0.3}, {"bin": 1, "n": 0, "mean_p": None, "mean_y": None}], 120)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (120, 120)
    at = data.index(b"IDAT")
    assert len(zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])) == 120 * 361


def test_commands(spark, tmp_path):
    from gapengine import __main__ as cli

    (tmp_path / "reviews.csv").write_text(REVIEWS)
    (tmp_path / "backlog.json").write_text(json.dumps(BACKLOG))
    at = ["--as-of", "2026-03-01", "--folder", str(tmp_path / "out")]
    told = cli.run_ingest(spark, cli.arguments(["ingest", "--reviews", str(tmp_path / "reviews.csv"), "--package", "org.demo", "--backlog", str(tmp_path / "backlog.json"), "--repository", "owner/name", *at]))
    assert told["signals"]["matching_rows"] == 6 and told["roadmap"]["issues"] == 2
    manifest = cli.run_analysis(spark, cli.arguments(["run", "--top", "3", *at]))
    assert manifest["signals"] == 3 and manifest["language_model"] == "not_requested" and (tmp_path / "out/report.html").is_file()
    assert artifacts.strict_json(tmp_path / "out/manifest.json") == manifest
    with pytest.raises(ValueError):
        cli.run_analysis(spark, cli.arguments(["run", "--as-of", "2031-01-01", "--folder", str(tmp_path / "out")]))
