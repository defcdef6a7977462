"""Schemas of the stages' tables, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapengine.functions.text import valid_id

PRIORITY = "struct<tier:string,score:double,is_low_priority:boolean,has_explicit_priority:boolean,reasons:array<string>,matched_labels:array<string>>"
SIGNALS = "id string, source string, source_id string, text string, timestamp timestamp, rating double, package_name string, metadata struct<duplicate_count:int,deduplication:string,version_id:string>"
ROADMAP = f"id string, type string, repository string, number int, title string, body string, state string, state_reason string, labels array<string>, milestone string, milestone_number int, milestone_due timestamp, created_at timestamp, updated_at timestamp, closed_at timestamp, html_url string, priority {PRIORITY}"
#: The names of verdicts, kinds of needs, priority tiers and confidence features.
VERDICTS = ("IGNORED", "UNDER-PRIORITIZED", "MISUNDERSTOOD", "COVERED")
KANO = ("basic", "performance", "excitement")
TIERS = ("critical", "high", "medium", "low", "backlog", "unspecified")
FEATURES = ("vol", "div", "sent", "rec", "cons", "selfc", "agree", "coh")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, rows) of the checks that rows fail; a null outcome is a failure. One pass."""
    sums = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    return sums.unpivot([], list(checks), "check", "rows").where("rows > 0")


def signal_checks() -> dict[str, Column]:
    return {
        "id": valid_id(F.col("id")), "text": F.length(F.trim("text")) > 0, "rating": F.col("rating").isNull() | F.col("rating").between(1, 5),
    }


def roadmap_checks() -> dict[str, Column]:
    p = F.col("priority")
    return {
        "id": valid_id(F.col("id")), "title": F.length(F.trim("title")) > 0, "state": F.col("state").isin("open", "closed"), "type": F.col("type").isin("issue", "milestone"),
        "repository": F.col("repository").rlike("^[^/\\s]+/[^/\\s]+$"), "milestone_of_milestone": (F.col("type") != "milestone") | F.col("milestone_number").isNull(),
        "low_tier": ~p["tier"].isin("low", "backlog") | p["is_low_priority"], "tier": p["tier"].isin(*TIERS),
    }


def gap_checks() -> dict[str, Column]:
    unit = lambda x: F.coalesce(x.between(0, 1), F.lit(False))
    return {
        "verdict": F.col("verdict").isin(*VERDICTS), "opportunity": F.col("opportunity_score").between(0, 20), "features": F.forall(F.map_values("features"), unit),
    }
