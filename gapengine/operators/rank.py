"""Ranking, title deduplication, near-tie bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.functions import text

TIE_MARGIN = 0.01


def rank_score(confidence: Column, opportunity: Column) -> Column:
    """Their product, rounded to 6 digits; values out of [0, 1] and [0, 20] are an error."""
    ok = confidence.between(0, 1) & opportunity.between(0, 20)
    return F.when(~ok, F.raise_error(F.lit("confidence or opportunity out of range"))).otherwise(F.round(confidence * opportunity, 6))


def title_key(title: Column, ident: Column) -> Column:
    """Blank titles are keys of their own."""
    key = text.folded(F.coalesce(title, F.lit("")))
    return F.when(key == "", F.concat(F.lit("\x00"), ident.cast("string"))).otherwise(key)


def unique_titles(rows: DataFrame, order: list[Column], title: str = "title", ident: str = "id") -> DataFrame:
    """The first row of each title in the given order, chosen by a partial aggregation: no window sorts a hot title's rows."""
    key = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    body = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(title_key(F.col(title), F.col(ident)).alias("_title")).agg(F.min_by(body, key).alias("_x"))
    return best.select("_x.*")


def ranked(rows: DataFrame, k: int | None = 5, min_confidence: float = 0.0) -> DataFrame:
    """Calibrated ranking of gaps(id, title, verdict, critique, confidence, opportunity, evidence): filter, score, unique titles, order, top k.

    Order: score, confidence, opportunity, number of distinct citations (all falling), id. Only k rows meet in one task.
    """
    own = rows.where((F.col("verdict") != "COVERED") & (F.coalesce("critique", F.lit("")) != "UNSUPPORTED") & (F.col("confidence") >= min_confidence))
    own = own.withColumn("score", rank_score(F.col("confidence"), F.col("opportunity")))
    order = [-F.col("score"), -F.col("confidence"), -F.col("opportunity"), -F.col("evidence"), F.col("id")]
    return numbered(unique_titles(own, order), order, k)


def numbered(rows: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    """Rows with their rank. With k, a distributed top-k comes first and only k rows are numbered."""
    cut = rows if k is None else rows.orderBy(*order).limit(k)
    return cut.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("int"))


def without_generic(rows: DataFrame, prefix: str, least: int = 3, title: str = "title") -> DataFrame:
    """Drops titles that begin with the generic prefix if at least so many others remain; else all stay."""
    generic = F.lower(F.col(title)).startswith(prefix.lower())
    others = rows.agg(F.count_if(~generic).alias("_others"))
    return rows.crossJoin(F.broadcast(others)).where((F.col("_others") < least) | ~generic).drop("_others")


def ranked_uncalibrated(rows: DataFrame, k: int | None = 5, generic_prefix: str = "recurring problem") -> DataFrame:
    """Filter, score (evidence score by opportunity), unique titles, generic titles, top k, bands, labels; rows(id, title, verdict, critique, raw, opportunity)."""
    own = rows.where((F.col("verdict") != "COVERED") & (F.coalesce("critique", F.lit("")) != "UNSUPPORTED") & F.col("raw").isNotNull())
    own = own.withColumn("score", rank_score(F.col("raw"), F.col("opportunity")))
    order = [-F.col("score"), -F.col("raw"), -F.col("opportunity"), F.col("id")]
    return banded(numbered(without_generic(unique_titles(own, order), generic_prefix), order, k))


def bands(scores: Column, margin: float = TIE_MARGIN) -> Column:
    """The band of each of an array of falling scores: a new one begins where a score is over margin below the band's first (not its neighbour)."""
    start = F.struct(F.lit(None).cast("double").alias("high"), F.lit(0).alias("band"), F.array().cast("array<int>").alias("all"))

    def step(acc, s):
        new = acc["high"].isNull() | F.coalesce(F.try_divide(acc["high"] - s, acc["high"]) > margin, F.lit(False))
        band = F.when(new, acc["band"] + 1).otherwise(acc["band"])
        return F.struct(F.when(new, s).otherwise(acc["high"]).alias("high"), band.alias("band"), F.concat(acc["all"], F.array(band)).alias("all"))

    return F.aggregate(scores, start, step, lambda acc: acc["all"])


def banded(ranked_rows: DataFrame, margin: float = TIE_MARGIN) -> DataFrame:
    """The (few) ranked rows with band, label and margin_to_previous."""
    all_scores = ranked_rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("_s"))
    out = ranked_rows.crossJoin(F.broadcast(all_scores.select(bands(F.col("_s"), margin).alias("_b"), "_s")))
    out = out.withColumn("band", F.element_at("_b", F.col("rank"))).withColumn("_n", F.size(F.filter("_b", lambda x: x == F.col("band"))))
    before = F.when(F.col("rank") > 1, F.element_at("_s", F.greatest(F.col("rank") - 1, F.lit(1))))
    return out.withColumn("label", F.when(F.col("_n") > 1, "order only").otherwise("separated")).withColumn("margin_to_previous", F.round(F.try_divide(before - F.col("score"), before), 6)).drop("_b", "_s", "_n")


def shortfall(k: int, n: int) -> int:
    return max(0, k - n)


def assignment(signals: DataFrame, needs: DataFrame) -> DataFrame:
    """One row: signals, those that some need cites, the rest. needs(signal_ids)."""
    cited = needs.select(F.explode("signal_ids").alias("id")).distinct().withColumn("cited", F.lit(1))
    return signals.select("id").join(cited, "id", "left").agg(F.count("*").alias("signals"), F.count("cited").alias("assigned"), (F.count("*") - F.count("cited")).alias("unassigned"))
