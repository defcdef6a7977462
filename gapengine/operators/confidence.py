"""Confidence features, the evidence score and what explains it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapengine.functions import numbers
from gapengine.types import FEATURES

#: Weights of the evidence score.
WEIGHTS = {"vol": 1.0, "div": 0.5, "sent": 0.0, "rec": 0.0, "cons": 1.0, "agree": 1.0, "coh": 1.0}
VOLUME_CAP, MAX_SOURCES, HALF_LIFE = 20, 3, 365.0
DISSENT, SUPPORT = 0.35, -0.05


def signal_sentiment(stored: Column, rating: Column) -> Column:
    return numbers.clip(F.coalesce(stored, (rating - 3) / 2), -1, 1)


def features(cited: DataFrame, gap: str = "gap_id", as_of: Column | None = None) -> DataFrame:
    """(gap, cited, resolved, vol, div, sent, rec, cons): from cited(gap, signal_id, resolved, source, sentiment, timestamp), a row for each distinct citation.

    Volume counts cited ids, resolved or not. Without as_of a gap's recency counts from its own last evidence.
    """
    own = cited if as_of is not None else cited.join(cited.groupBy(gap).agg(F.max("timestamp").alias("as_of")), gap)
    now = as_of if as_of is not None else F.col("as_of")
    age = F.greatest(numbers.whole_days(now, F.col("timestamp")), F.lit(0))
    known = F.col("resolved")
    out = own.groupBy(gap).agg(
        F.count("*").alias("cited"), F.count_if(known).alias("resolved"), F.countDistinct(F.when(known, F.col("source"))).alias("sources"), F.avg(F.when(known, F.abs("sentiment"))).alias("mean"),
        F.avg(F.when(known, numbers.recency(age, HALF_LIFE))).alias("decay"), F.count_if(known & (F.col("sentiment") < SUPPORT)).alias("s"), F.count_if(known & (F.col("sentiment") > DISSENT)).alias("c"),
    )
    return out.select(
        gap, "cited", "resolved", numbers.log_saturation(F.col("cited"), VOLUME_CAP).alias("vol"), F.when(F.col("resolved") > 0, numbers.clip((F.col("sources") - 1) / (MAX_SOURCES - 1))).otherwise(F.lit(0.0)).alias("div"),
        F.coalesce("mean", F.lit(0.5)).alias("sent"), F.coalesce("decay", F.lit(0.5)).alias("rec"), F.when(F.col("resolved") > 0, (F.col("s") + 1) / (F.col("s") + F.col("c") + 2)).otherwise(F.lit(0.5)).alias("cons"),
    )


def self_consistency(value: Column, samples: Column) -> Column:
    return F.when(F.coalesce(samples, F.lit(0)) > 0, value).otherwise(F.lit(0.5))


def agreement(signals: Column, samples: Column) -> Column:
    vote = lambda k: F.when(k >= 2, 1.0).when(k == 1, 0.5).otherwise(0.0)
    return (vote(F.coalesce(signals, F.lit(0))) + vote(F.coalesce(samples, F.lit(0)))) / 2


def evidence_score(values: dict[str, Column] | None = None, weights: dict[str, float] | None = None, intercept: float | None = None) -> Column:
    """The sigmoid of the weighted features, without self-consistency; the intercept is minus half the weights unless given. Rounded to 12 digits."""
    weights = WEIGHTS if weights is None else weights
    z = F.lit(-sum(weights.values()) / 2 if intercept is None else intercept)
    for k, w in weights.items():
        z = z + F.lit(float(w)) * (values[k] if values else F.col(k))
    return F.round(numbers.sigmoid(z), 12)


def fused(score: Column, consistency: Column, how: str, observed: Column) -> Column:
    """The score with self-consistency, where answers were observed: harmonic, minimum, product or none."""
    both = score + consistency
    value = {"harmonic": F.when(both > 0, 2 * score * consistency / both).otherwise(F.lit(0.0)), "minimum": F.least(score, consistency), "product": score * consistency, "none": score}[how]
    return F.when(observed, value).otherwise(score)


def breakdown(gaps: DataFrame, gap: str = "gap_id", weights: dict[str, float] | None = None) -> DataFrame:
    """(gap, feature, value, weight, contribution), a row for each feature."""
    weights = WEIGHTS if weights is None else weights
    rows = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("value"), F.lit(float(w)).alias("weight"), (F.col(k) * F.lit(float(w))).alias("contribution")) for k, w in weights.items()])
    return gaps.select(gap, F.inline(rows))


def counterevidence(cited: DataFrame, gap: str = "gap_id") -> DataFrame:
    """(gap, resolved, n_dissent, share, signal_ids): resolved citations whose sentiment speaks against the gap."""
    against = F.col("resolved") & (F.col("sentiment") > DISSENT)
    out = cited.groupBy(gap).agg(F.count_if("resolved").alias("resolved"), F.count_if(against).alias("n_dissent"), F.array_sort(F.collect_list(F.when(against, F.col("signal_id")))).alias("signal_ids"))
    return out.select(gap, "resolved", "n_dissent", F.when(F.col("resolved") > 0, F.round(F.col("n_dissent") / F.col("resolved"), 6)).otherwise(F.lit(0.0)).alias("share"), "signal_ids")


def weakest_assumption(gate: Column, margin: Column, low: float, dissent: Column, cohesion: Column, framing_eligible: Column, vol: Column) -> Column:
    """struct<severity, factor>: the severest of the assumptions that may not hold; of equals the first by name. framing_eligible is null if framing wasn't looked at."""
    near = F.coalesce(margin <= 0.05, F.lit(False))
    case = lambda where, severity, factor: F.when(where, F.struct((-F.lit(severity)).alias("s"), F.lit(factor).alias("factor")))
    found = F.array_compact(F.array(
        case((gate == "low") & near & F.lit(low != 0), 4, "similarity near the low threshold"), case(gate.isin("symptom", "job") & near, 4, "framing coverage near the cutoff"), case(dissent >= 0.25, 3, "dissenting evidence"),
        case(cohesion < 0.10, 3, "loosely related evidence"), case(framing_eligible.isNotNull() & ~framing_eligible, 2, "too few terms to compare framings"), case(vol < 0.6, 2, "little evidence"), case(F.lit(True), 1, "the score isn't calibrated"),
    ))
    best = F.array_min(found)
    return F.struct((-best["s"]).alias("severity"), best["factor"].alias("factor"))


def diagnostics(gaps: DataFrame, weights: dict[str, float] | None = None, columns: Iterable[str] = FEATURES) -> DataFrame:
    """(feature, lowest, highest, is_constant, weight, dead_share): which features can't tell gaps apart, and the share of the weight that is theirs. No rows below two gaps."""
    weights = WEIGHTS if weights is None else weights
    columns = [c for c in columns if c in gaps.columns]
    low = gaps.agg(F.count("*").alias("n"), *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("lowest"), F.col(f"hi_{c}").alias("highest"), F.lit(float(weights.get(c, 0.0))).alias("weight")) for c in columns])
    out = low.where("n >= 2").select(F.inline(rows)).withColumn("is_constant", F.col("highest") - F.col("lowest") <= 1e-9)
    dead = out.agg(F.try_divide(F.sum(F.when(F.col("is_constant"), F.abs("weight")).otherwise(0.0)), F.sum(F.abs("weight"))).alias("dead_share"))
    return out.crossJoin(F.broadcast(dead)).select("feature", "lowest", "highest", "is_constant", "weight", F.round("dead_share", 6).alias("dead_share"))
