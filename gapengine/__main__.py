"""python -m gapengine ingest|run: reviews and a backlog in, tables and a report out.

ingest writes signals and roadmap as Parquet with ingest.json; run reads them, writes needs, gaps, reports and the ranking as Parquet, and manifest.json and report.html of the few ranked rows.
"""

from __future__ import annotations

import argparse
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gapengine.operators import ingest
from gapengine.plans import analyze, guards
from gapengine.sources import artifacts, forge, render, reviews


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="gapengine", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("--reviews", required=True)
    i.add_argument("--package", required=True)
    i.add_argument("--backlog", required=True, nargs="+", help="JSON fixtures")
    i.add_argument("--repository", required=True)
    i.add_argument("--state-scope", choices=("open", "all"), default="open")
    r = sub.add_parser("run")
    r.add_argument("--mode", choices=("current", "archive"), default="current")
    r.add_argument("--top", type=int, default=5)
    r.add_argument("--private", action="store_true")
    for x in (i, r):
        x.add_argument("--as-of", default=None, help="ISO time; now by default")
        x.add_argument("--folder", required=True)
    return p.parse_args(argv)


def moment(text: str | None) -> datetime:
    at = datetime.fromisoformat(text) if text else datetime.now(UTC)
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


def run_ingest(spark: SparkSession, a: argparse.Namespace) -> dict:
    folder, as_of = Path(a.folder), moment(a.as_of)
    folder.mkdir(parents=True, exist_ok=True)
    rows = reviews.read(spark, a.reviews)
    if over := [r.check for r in reviews.limits(rows).collect()]:
        raise ValueError(f"the reviews are over the limits of {', '.join(over)}")
    triage = ingest.triaged(rows, a.package)
    stats = ingest.statistics(triage)
    guards.require_match(stats, a.package)
    issues, milestones, rest = forge.fixture(spark, a.backlog)
    guards.require_repository(a.repository, rest.get("repository"))
    guards.unique_numbers(issues, milestones)
    signals = ingest.deduplicated(triage.where("status = 'ok'"))
    guards.unique_ids(signals, "signals")
    signals.orderBy("id").write.mode("overwrite").parquet(str(folder / "signals.parquet"))
    ingest.roadmap(issues, milestones, a.repository, F.lit(as_of)).write.mode("overwrite").parquet(str(folder / "roadmap.parquet"))
    out = {"signals": stats.first().asDict(), "roadmap": guards.scope(issues, milestones, a.repository, rest.get("state_scope", a.state_scope), rest.get("retrieved_at")), "as_of": as_of.isoformat()}
    artifacts.atomic_json(folder / "ingest.json", out)
    return out


def run_analysis(spark: SparkSession, a: argparse.Namespace) -> dict:
    folder, as_of = Path(a.folder), moment(a.as_of)
    told = artifacts.strict_json(folder / "ingest.json", folder)
    signals, items = (spark.read.parquet(str(folder / f"{x}.parquet")) for x in ("signals", "roadmap"))
    scope = guards.time_scope(signals, a.mode, as_of, told["roadmap"]["state_scope"])
    result = analyze.analyze(signals, items, analyze.Config(top_k=a.top), as_of=as_of)
    for name in ("needs", "gaps", "reports", "ranked"):
        getattr(result, name).write.mode("overwrite").parquet(str(folder / f"{name}.parquet"))
    ranked = [r.asDict() for r in result.ranked.select("id", "title", "verdict", "critique", "score", "rank").orderBy("rank").collect()]
    result.release()
    manifest = result.manifest | {"mode": scope["mode"], "evidence_start": str(scope["evidence_start"]), "evidence_end": str(scope["evidence_end"]), "language_model": guards.model_status(False, 0, 0), "inputs": artifacts.contract_hash(told)}
    artifacts.atomic_json(folder / "manifest.json", manifest)
    render.write_page(folder / "report.html", "Findings", ranked, manifest, a.private)
    return manifest


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("gapengine").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print((run_ingest if a.command == "ingest" else run_analysis)(spark, a))


if __name__ == "__main__":
    main()
