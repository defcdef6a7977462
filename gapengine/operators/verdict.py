"""Verdicts of needs against the backlog, their guards and their stability."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.operators.framing import CUTOFF

LOW, HIGH, BORDERLINE = 0.38, 0.62, 0.05
#: Public planning states.
STATES = {"IGNORED": "no matching item", "UNDER-PRIORITIZED": "planned late", "MISUNDERSTOOD": "planned for the symptom", "COVERED": "planned"}


def verdict(misunderstood: Column, similarity: Column, low_priority: Column, low: Column | float = LOW, high: Column | float = HIGH) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(misunderstood, "MISUNDERSTOOD").when(similarity < low, "IGNORED").when(low_priority, "UNDER-PRIORITIZED").when(similarity >= high, "COVERED").when(similarity < (low + high) / 2, "IGNORED").otherwise("COVERED")


def guarded(verdict_col: Column, closed: Column) -> Column:
    """Closed history isn't coverage."""
    return F.when((verdict_col == "COVERED") & closed, "IGNORED").otherwise(verdict_col)


def stability(misunderstood: Column, similarity: Column, low_priority: Column, symptom: Column, job: Column, closed: Column, low: float = LOW, high: float = HIGH, borderline: float = BORDERLINE) -> Column:
    """struct<gate, margin, flips_to, is_borderline>: how far the deciding gate is from turning, and into what."""
    plain = verdict(F.lit(False), similarity, low_priority, low, high)
    a, b = symptom - CUTOFF, CUTOFF - job
    margin_f = F.round(F.least(a, b), 6)
    near_f = margin_f <= borderline
    margin_s = F.round(F.abs(similarity - low), 6)
    target = F.when(plain != "IGNORED", "IGNORED").when(low_priority, "UNDER-PRIORITIZED").when(similarity >= (low + high) / 2, "COVERED")
    framing = F.struct(F.when(a <= b, "symptom").otherwise("job").alias("gate"), margin_f.alias("margin"), F.when(near_f, plain).alias("flips_to"), near_f.alias("is_borderline"))
    ratio = F.struct(F.lit("low").alias("gate"), F.when(target.isNotNull(), margin_s).alias("margin"), target.alias("flips_to"), (target.isNotNull() & (margin_s <= borderline)).alias("is_borderline"))
    shut = F.struct(F.lit("closed").alias("gate"), F.lit(None).cast("double").alias("margin"), F.lit(None).cast("string").alias("flips_to"), F.lit(False).alias("is_borderline"))
    return F.when(closed & ~misunderstood & (plain == "COVERED"), shut).when(misunderstood, framing).otherwise(ratio)


def public_state(verdict_col: Column, states=STATES) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in states.items() for x in kv]), verdict_col)


def tuned(rows: DataFrame, lows: list[float], highs: list[float], folds: int = 5) -> DataFrame:
    """(low, high, accuracy, fold_accuracy, rank) of every pair with low < high.

    rows(position, similarity, low_priority, is_misunderstood, expected), few and labelled; folds are interleaved by position. fold_accuracy is the out-of-fold accuracy when each
    fold takes the best pair of the others; it is the same in all rows. Best: accuracy, then the narrower band, lower low, lower high.
    """
    spark = rows.sparkSession
    grid = spark.createDataFrame([(lo, hi) for lo, hi in product(lows, highs) if lo < hi], "low double, high double")
    right = (verdict(F.col("is_misunderstood"), F.col("similarity"), F.col("low_priority"), F.col("low"), F.col("high")) == F.col("expected")).cast("long")
    # rows between the same neighbouring thresholds have the same verdict under every pair, so they are counted once and only the counts, of bounded number, meet the grid
    edges = sorted({x for lo, hi in product(lows, highs) if lo < hi for x in (lo, hi, (lo + hi) / 2)})
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("similarity")))
    counts = rows.groupBy(F.pmod("position", F.lit(folds)).alias("fold"), "low_priority", "is_misunderstood", "expected", place.alias("place")).agg(F.count("*").alias("k"), F.min("similarity").alias("similarity"))
    each = counts.crossJoin(F.broadcast(grid)).withColumn("right", right * F.col("k"))
    by_fold = each.groupBy("low", "high", "fold").agg(F.sum("right").alias("right"), F.sum("k").alias("n"))
    order = [F.desc("accuracy"), F.expr("round(high - low, 9)"), F.col("low"), F.col("high")]
    whole = by_fold.groupBy("low", "high").agg(F.sum("right").alias("all_right"), F.sum("n").alias("all_n"))
    out = whole.withColumn("accuracy", F.round(F.col("all_right") / F.col("all_n"), 6)).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    others = by_fold.join(whole, ["low", "high"]).withColumn("accuracy", F.try_divide(F.col("all_right") - F.col("right"), F.col("all_n") - F.col("n")))
    picked = others.withColumn("k", F.row_number().over(W.partitionBy("fold").orderBy(*order))).where("k = 1")
    fold = picked.agg(F.round(F.sum("right") / F.sum("n"), 6).alias("fold_accuracy"))
    return out.crossJoin(F.broadcast(fold)).select("low", "high", "accuracy", "fold_accuracy", "rank")


def adjudicated(matches: DataFrame, adjudicate: Callable[[dict], dict | None], low: float = LOW, high: float = HIGH) -> DataFrame:
    """matches with the verdicts that adjudicate gives for ambiguous rows: low <= similarity < high, not a matter of framing.

    adjudicate takes a row (need_id, item_id, latent_need, jtbd_statement, full, similarity, verdict) as a dict and returns {verdict, item_id, quote} or None. An answer counts only if its
    verdict is one of IGNORED, UNDER-PRIORITIZED and COVERED, its item is the row's, its quote stands in the item's text word for word and it doesn't call a closed item covered; others are passed over.
    Rows are asked about where they are, a batch at a time; adjudicate must be a function that workers can import or unpickle.
    """
    ambiguous = (F.col("similarity") >= low) & (F.col("similarity") < high) & ~F.col("is_misunderstood") & F.col("item_id").isNotNull()
    asked = ("need_id", "item_id", "latent_need", "jtbd_statement", "full", "similarity", "verdict", "closed")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers = []
            for row in f.to_dict("records"):
                got = adjudicate({k: row[k] for k in asked if k != "closed"}) or {}
                named = got.get("verdict")
                fine = named in ("IGNORED", "UNDER-PRIORITIZED", "COVERED") and got.get("item_id") == row["item_id"] and bool(got.get("quote")) and got["quote"] in (row["full"] or "") and not (named == "COVERED" and row["closed"])
                answers.append(named if fine else None)
            yield pd.DataFrame({"need_id": f["need_id"], "adjudicated_verdict": pd.Series(answers, index=f.index, dtype=object)})

    told = matches.where(ambiguous).select(*asked).mapInPandas(run, "need_id string, adjudicated_verdict string")
    out = matches.join(told, "need_id", "left")
    return out.withColumn("verdict", F.coalesce("adjudicated_verdict", "verdict")).drop("adjudicated_verdict")
