"""Checks of a run's inputs and scope. Each is an aggregate; what it finds is raised as an error or returned as a small dict."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Evidence older than so many days isn't current.
CURRENT_DAYS = 730
MIN_LABELS = 100


def unique_ids(df: DataFrame, what: str, column: str = "id") -> None:
    """Empty, null and repeated ids are errors; the message names one."""
    key = F.coalesce(F.trim(F.col(column).cast("string")), F.lit(""))
    bad = df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("k = '' or n > 1").orderBy("k").first()
    if bad:
        raise ValueError(f"{what}: an id is empty" if not bad.k else f"{what}: the id {bad.k} occurs {bad.n} times")


def require_match(stats: DataFrame, package: str) -> None:
    """stats: of operators.ingest.statistics(). No row of the package is an error."""
    row = stats.first()
    if not row or not row.matching_rows:
        raise ValueError(f"no row of {package} was found")


def require_repository(wanted: str, found: str | None) -> None:
    """A fixture that names its repository must name the one that is asked for, in any case."""
    if found and found.strip().casefold() != wanted.strip().casefold():
        raise ValueError(f"the backlog is of {found}, not of {wanted}")


def unique_numbers(issues: DataFrame, milestones: DataFrame) -> None:
    """Numbers that repeat among issues that aren't pull requests, or among milestones, are errors."""
    for what, df in (("issue", issues.where("pull_request is null")), ("milestone", milestones)):
        bad = df.groupBy("number").count().where("count > 1").orderBy("number").first()
        if bad:
            raise ValueError(f"{what} {bad.number} occurs {bad['count']} times")


def scope(issues: DataFrame, milestones: DataFrame, repository: str, state_scope: str = "open", retrieved_at: str | None = None) -> dict:
    """Counts of a backlog's sources: issues, pull requests left out, milestones, states."""
    i = issues.agg(F.count_if(F.col("pull_request").isNull()).alias("issues"), F.count_if(F.col("pull_request").isNotNull()).alias("pull_requests_excluded"), F.count_if(F.col("pull_request").isNull() & (F.col("state") == "closed")).alias("closed_issues")).first()
    m = milestones.agg(F.count("*").alias("n"), F.count_if(F.col("state") == "closed").alias("closed")).first()
    if state_scope not in ("open", "all"):
        raise ValueError("the scope of states is open or all")
    return {"repository": repository, "state_scope": state_scope, "retrieved_at": retrieved_at, "issues": i.issues, "closed_issues": i.closed_issues, "pull_requests_excluded": i.pull_requests_excluded, "milestones": m.n, "closed_milestones": m.closed}


def time_scope(signals: DataFrame, mode: str, as_of: datetime, state_scope: str = "open") -> dict:
    """First and last time of the evidence. Mode current refuses evidence whose last time is over CURRENT_DAYS old (and evidence without any time); mode archive takes backlogs of all states only."""
    if mode not in ("current", "archive"):
        raise ValueError("the mode is current or archive")
    if mode == "archive" and state_scope != "all":
        raise ValueError("an archive analysis needs items of all states")
    row = signals.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
    if mode == "current" and (row.last is None or row.last < as_of - timedelta(days=CURRENT_DAYS)):
        raise ValueError(f"the evidence isn't current: its last time is {row.last}")
    return {"mode": mode, "evidence_start": row.first, "evidence_end": row.last}


def labels_suffice(labelled: DataFrame, least: int = MIN_LABELS, y: str = "y") -> bool:
    """Whether there are enough labels, and of both classes; with fewer or of one class a run stays uncalibrated."""
    row = labelled.agg(F.count(y).alias("n"), F.count_if(F.col(y).cast("double") > 0.5).alias("ones")).first()
    return row.n >= least and 0 < row.ones < row.n


def model_status(requested: bool, calls: int, failures: int) -> str:
    """What came of a requested language model: not_requested, requested_but_no_calls, partial or ok."""
    if not requested:
        return "not_requested"
    if calls <= 0:
        return "requested_but_no_calls"
    return "partial" if failures else "ok"
