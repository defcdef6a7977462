"""Evidence of gaps: cited signals in their order, with excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapengine.functions import text


def spans(gaps: DataFrame, signals: DataFrame, width: int = 280) -> DataFrame:
    """(gap_id, n_cited, position, id, span) of gaps(gap_id, signal_ids): a row for each distinct id; span is null for unknown signals. Excerpts are cut before the exchange."""
    cited = gaps.select("gap_id", F.size(F.array_distinct("signal_ids")).alias("n_cited"), F.posexplode(F.array_distinct("signal_ids")).alias("position", "id"))
    return cited.join(signals.select("id", text.excerpt(F.col("text"), width).alias("span")), "id", "left")


def evidence(gaps: DataFrame, signals: DataFrame, width: int = 280) -> DataFrame:
    """(gap_id, n_cited, quotes array<struct<position, id, span>>) of gaps(gap_id, signal_ids): distinct ids in their first order; unknown signals are skipped."""
    found = spans(gaps, signals, width)
    quotes = F.array_sort(F.collect_list(F.when(F.col("span").isNotNull(), F.struct("position", "id", "span"))))
    return found.groupBy("gap_id").agg(F.max("n_cited").alias("n_cited"), quotes.alias("quotes"))


def gap_id(need: Column, item: Column, verdict: Column) -> Column:
    return text.stable_id("G", [need, item, verdict], text.STAGE_SEPARATOR)


def snapshot_time(items: DataFrame) -> DataFrame:
    """One row: the last time that an item was made or changed; due dates say nothing about it."""
    return items.agg(F.max(F.greatest("updated_at", "created_at")).alias("snapshot"))
