"""Priority: derived from labels, milestones and dates at ingestion, and judged again when gaps are detected."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapengine.functions import numbers

#: Our own label rules, tiers in the order in which they are tried. Rules of one or two letters must be the whole label.
RULES = {
    "critical": ("critical", "blocker", "urgent", "p0", "sev1"),
    "high": ("high", "high priority", "p1", "important"),
    "medium": ("medium", "normal", "p2"),
    "low": ("low", "minor", "trivial", "p3", "p4"),
    "backlog": ("backlog", "someday", "icebox", "wishlist", "future"),
}
SCORES = {"critical": 1.0, "high": 0.85, "medium": 0.65, "low": 0.35, "backlog": 0.15, "unspecified": 0.5}
BACKLOG = "backlog|future|someday|icebox|maybe later"
DUE_DAYS, OPEN_DAYS = 183, 365


def plain_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\[\](){}_/\s-]+", " "))


def label_matches(label: Column, rule: str) -> Column:
    plain = plain_label(label)
    return plain == rule if len(rule) <= 2 else plain.rlike(rf"\b{rule}\b")


def _fits(rules):
    """A label predicate: one of the rules matches."""
    return lambda label: reduce(or_, [label_matches(label, rule) for rule in rules])


def tier(labels: Column, rules=RULES) -> Column:
    """The first tier that a label fits; null without one."""
    out = None
    for name, words in rules.items():
        fits = F.exists(labels, _fits(words))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def matched(labels: Column, rules=RULES) -> Column:
    """The labels that fit some rule."""
    words = [w for ws in rules.values() for w in ws]
    return F.filter(labels, _fits(words))


def derived(labels: Column, milestone: Column, due: Column, created: Column, state: Column, as_of: Column, rules=RULES) -> Column:
    """The priority struct. as_of is always given, so that results don't depend on the clock.

    An explicit tier wins; else a backlog milestone makes it backlog; else a missing milestone, a due date over 183 days ahead or 365 days open make it low.
    """
    labels = F.coalesce(labels, F.array().cast("array<string>"))
    explicit = tier(labels, rules)
    in_backlog = F.coalesce(F.lower(milestone).rlike(BACKLOG), F.lit(False))
    none = milestone.isNull()
    far = F.coalesce(due > as_of + F.expr(f"INTERVAL {DUE_DAYS} DAYS"), F.lit(False))
    stale = F.coalesce((state == "open") & (created < as_of - F.expr(f"INTERVAL {OPEN_DAYS} DAYS")), F.lit(False))
    name = F.coalesce(explicit, F.when(in_backlog, "backlog").when(none | far | stale, "low").otherwise("unspecified"))
    structural = in_backlog | none | far | stale
    low = name.isin("low", "backlog") | (structural & ~name.isin("critical", "high"))
    own = F.array_sort(matched(labels, rules), lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0))
    reasons = F.array_compact(F.array(F.when(explicit.isNotNull(), F.concat(F.lit("label: "), F.array_join(own, ", "))), F.when(in_backlog, "backlog milestone").when(none, "no milestone"), F.when(far, "due date far ahead"), F.when(stale, "open for long")))
    score = F.element_at(F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv]), name)
    return F.struct(name.alias("tier"), score.alias("score"), low.alias("is_low_priority"), explicit.isNotNull().alias("has_explicit_priority"), F.when(F.size(reasons) == 0, F.array(F.lit("no priority evidence"))).otherwise(reasons).alias("reasons"), own.alias("matched_labels"))


def low_reasons(priority: Column, milestone: Column, due: Column, created: Column, state: Column, as_of: Column) -> Column:
    """Why an item is low at gap time; empty if it isn't. An explicit critical or high tier vetoes all."""
    tier_name = priority["tier"]
    veto = F.coalesce(priority["has_explicit_priority"] & tier_name.isin("critical", "high"), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    found = F.array_compact(F.array(
        F.when(yes(priority["is_low_priority"]), "ingest"), F.when(yes(tier_name.isin("low", "backlog")), "tier"), F.when(yes(priority["score"] <= 0.35), "score"),
        F.when(F.lower(F.coalesce(F.trim(milestone), F.lit(""))).isin("", "none", "backlog", "future"), "milestone"),
        F.when(yes(numbers.whole_days(due, as_of) > DUE_DAYS), "due"),
        F.when(yes((state == "open") & (numbers.whole_days(as_of, created) > OPEN_DAYS)) & ~yes(priority["has_explicit_priority"]), "age"),
    ))
    return F.when(veto, F.array().cast("array<string>")).otherwise(found)


def firing_rates(items: DataFrame, reasons: str = "low_reasons", flag: float = 0.9) -> DataFrame:
    """(reason, items, rate, dominant): how many items each reason fires on."""
    n = items.agg(F.count("*").alias("all_items"))
    fired = items.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("items"))
    return fired.crossJoin(F.broadcast(n)).select("reason", "items", F.round(F.col("items") / F.col("all_items"), 6).alias("rate"), (F.col("items") >= flag * F.col("all_items")).alias("dominant"))
