"""Report and exploration: projections, bands, searches, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def projection(findings: DataFrame, verification: DataFrame, items: DataFrame, stability: DataFrame, private: bool = False) -> DataFrame:
    """Findings(id, title, verdict, item_id, rank, score) with checked and valid quotes, the item's title and state, and stability by title. Public reports withhold spans and count them.

    verification(gap_id, valid, span); every other table is aggregated to one row a key before it is joined.
    """
    spans = F.array_sort(F.collect_list(F.when(F.col("valid"), F.col("span"))))
    v = verification.groupBy(F.col("gap_id").alias("id")).agg(F.count("*").alias("checked_quotes"), F.count_if("valid").alias("valid_quotes"), spans.alias("spans"))
    r = items.select(F.col("id").alias("item_id"), F.col("title").alias("item_title"), F.col("state").alias("item_state"))
    s = stability.select("title", "survival")
    out = findings.join(v, "id", "left").join(r, "item_id", "left").join(s, "title", "left")
    zero = F.lit(0).cast("long")
    return out.select("id", "title", "verdict", "rank", "score", "item_id", "item_title", "item_state", F.coalesce("checked_quotes", zero).alias("checked_quotes"), F.coalesce("valid_quotes", zero).alias("valid_quotes"), F.when(F.lit(private), F.col("spans")).otherwise(F.array().cast("array<string>")).alias("spans"), F.when(F.lit(private), zero).otherwise(F.coalesce("valid_quotes", zero)).alias("withheld"), "survival")


def inventory(gaps: DataFrame, shipped: DataFrame) -> DataFrame:
    """All gaps, each with whether it is among the shipped ones."""
    return gaps.join(shipped.select("id", F.lit(True).alias("is_shipped")).distinct(), "id", "left").withColumn("is_shipped", F.coalesce("is_shipped", F.lit(False)))


def state_counts(gaps: DataFrame, state: str = "state") -> DataFrame:
    return gaps.groupBy(state).agg(F.count("*").alias("n"))


def evidence_band(signals: Column, complete: Column, verified: Column) -> Column:
    return F.when(~verified, "Unverified").when((signals >= 50) & complete, "Strong").when(signals >= 10, "Moderate").otherwise("Limited")


def opportunity_band(x: Column) -> Column:
    return F.when(x >= 12, "High").when(x >= 8, "Moderate").otherwise("Low")


def stability_band(x: Column) -> Column:
    return F.when(x.isNull(), "Not measured").when(x >= 0.9, "Stable").when(x >= 0.6, "Fairly stable").otherwise("Unstable")


def search_terms(query: str) -> list[str]:
    return [w for w in query.lower().split() if len(w) > 2]


def corpus_search(signals: DataFrame, owners: DataFrame, terms: list[str], text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals that hold any of the terms as a substring: a summary row, counts by owner, and the three worst rated uncited ones.

    owners(signal_id, gap_id, position): the first gap that cites a signal owns it. Zero and null ratings don't enter the mean; null sorts like 5.
    """
    low = F.lower(F.col(text_col))
    match = F.lit(False)
    for t in terms:
        match = match | F.contains(low, F.lit(t))
    first = owners.groupBy(F.col("signal_id").alias("id")).agg(F.min_by("gap_id", "position").alias("owner"))
    hits = signals.where(match).join(first, "id", "left")
    free = F.col("owner").isNull()
    rated = F.when(free & (F.col("rating") > 0), F.col("rating"))
    summary = hits.agg(F.count("*").alias("matches"), F.count("owner").alias("cited"), F.count_if(free).alias("uncovered"), F.round(F.avg(rated), 6).alias("mean_uncovered_rating"))
    by_owner = hits.where(~free).groupBy("owner").agg(F.count("*").alias("n"))
    worst = hits.where(free).orderBy(F.coalesce("rating", F.lit(5.0)), "id").limit(3)
    return summary, by_owner, worst


def need_search(needs: DataFrame, query: str, title: str = "title", k: int = 5) -> DataFrame:
    """(id, title, hit_share): the needs whose titles hold the largest share of the terms; ties by id."""
    terms = search_terms(query)
    low = F.lower(F.col(title))
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.contains(low, F.lit(t)).cast("int")
    share = F.round(hits / F.lit(max(1, len(terms))), 6)
    return needs.select("id", title, share.alias("hit_share")).where("hit_share > 0").orderBy(F.desc("hit_share"), "id").limit(k)


def pairwise(breakdown: DataFrame, a, b, gap: str = "gap_id") -> DataFrame:
    """(feature, contribution_a, contribution_b, delta, position): what sets two gaps apart, largest difference first."""
    side = lambda g, name: breakdown.where(F.col(gap) == g).select("feature", F.col("contribution").alias(name))
    out = side(a, "contribution_a").join(side(b, "contribution_b"), "feature").withColumn("delta", F.round(F.col("contribution_a") - F.col("contribution_b"), 6))
    return out.withColumn("position", F.row_number().over(W.orderBy(F.desc(F.abs("delta")), "feature")))


def ticket(row: dict, quotes: list[str], budget: int = 8, width: int = 220) -> str:
    """A markdown draft of one finding."""
    lines = [f"# {row['title']}", "", f"Verdict: {row['verdict']}", f"Score: {row['score']:.3f}", ""]
    lines += [f"> {q[:width]}" for q in quotes[:budget]]
    if len(quotes) > budget:
        lines.append(f"({len(quotes) - budget} more)")
    return "\n".join(lines) + "\n"
