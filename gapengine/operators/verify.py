"""Verification of quotes and references."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapengine.functions import udfs

THRESHOLD = 0.92


def exact_quote(quote: Column, source: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """struct<status, start, end>: status is invalid (blank, or offsets that can't be), exact or search; offsets that are well formed but wrong fall through to a search of the text."""
    none = F.lit(None).cast("int")
    start, end = none if start is None else start.cast("int"), none if end is None else end.cast("int")
    blank = F.coalesce(F.trim(quote), F.lit("")) == ""
    bad = (start.isNull() != end.isNull()) | F.coalesce((start < 0) | (end < start) | (end > F.length(source)), F.lit(False))
    at = F.coalesce(start.isNotNull() & (F.substring(source, start + 1, end - start) == quote), F.lit(False))
    found = F.coalesce(F.position(quote, source), F.lit(0))
    out = lambda status, a, b: F.struct(F.lit(status).alias("status"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    return F.when(blank | bad, out("invalid", none, none)).when(at, out("exact", start, end)).when(found > 0, out("exact", found - 1, found - 1 + F.length(quote))).otherwise(out("search", none, none))


def verified_quotes(quotes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """quotes(…, quote, source, start, end) with valid, score, method, found_start, found_end and found_span. Python sees only what isn't found exactly."""
    q = quotes.withColumn("_x", exact_quote(F.col("quote"), F.col("source"), F.col("start"), F.col("end")))
    span = F.substring(F.col("source"), F.col("_x.start") + 1, F.col("_x.end") - F.col("_x.start"))
    done = q.where("_x.status <> 'search'")
    ok = F.col("_x.status") == "exact"
    done = done.withColumns({"valid": ok, "score": F.when(ok, 1.0).otherwise(0.0), "method": F.col("_x.status"), "found_start": F.col("_x.start"), "found_end": F.col("_x.end"), "found_span": F.when(ok, span)})
    rest = q.where("_x.status = 'search'").withColumn("_f", udfs.fuzzy_span(F.col("quote"), F.col("source"), threshold))
    rest = rest.withColumns({"valid": F.col("_f.valid"), "score": F.col("_f.score"), "method": F.lit("fuzzy"), "found_start": F.nullif(F.col("_f.start"), F.lit(-1)), "found_end": F.nullif(F.col("_f.end"), F.lit(-1)), "found_span": F.col("_f.span")}).drop("_f")
    return done.unionByName(rest).drop("_x")


def canonicalised(quotes: DataFrame) -> DataFrame:
    """Valid quotes take the text and offsets that were found."""
    ok = F.col("valid")
    return quotes.withColumns({"quote": F.when(ok, F.col("found_span")).otherwise(F.col("quote")), "start": F.when(ok, F.col("found_start")).otherwise(F.col("start")), "end": F.when(ok, F.col("found_end")).otherwise(F.col("end"))})


def reference_issues(gaps: DataFrame, signals: DataFrame, needs: DataFrame, items: DataFrame) -> DataFrame:
    """(gap_id, issue, value): unknown and repeated signal ids, quoted ids that aren't cited, unknown items and needs.

    gaps(gap_id, need_id, item_id, signal_ids, quote_ids).
    """
    cited = gaps.select("gap_id", F.explode("signal_ids").alias("value"))
    per = cited.groupBy("gap_id", "value").agg(F.count("*").alias("k"))
    unknown = per.join(signals.select(F.col("id").alias("value")), "value", "left_anti").select("gap_id", F.lit("unknown signal").alias("issue"), "value")
    twice = per.where("k > 1").select("gap_id", F.lit("repeated signal").alias("issue"), "value")
    quoted = gaps.select("gap_id", F.explode(F.array_except("quote_ids", "signal_ids")).alias("value")).select("gap_id", F.lit("quote not cited").alias("issue"), "value")
    item = gaps.where("item_id is not null").select("gap_id", F.col("item_id").alias("value")).join(items.select(F.col("id").alias("value")), "value", "left_anti").select("gap_id", F.lit("unknown item").alias("issue"), "value")
    need = gaps.select("gap_id", F.col("need_id").alias("value")).join(needs.select(F.col("id").alias("value")), "value", "left_anti").select("gap_id", F.lit("unknown need").alias("issue"), "value")
    out = unknown
    for part in (twice, quoted, item, need):
        out = out.unionByName(part)
    return out


def critique(issues: Column, cited: Column, valid: Column, verdict: Column, item: Column) -> Column:
    weak = (cited < 2) | (valid == 0) | ((verdict != "IGNORED") & item.isNull())
    return F.when(issues > 0, "UNSUPPORTED").when(weak, "WEAK").otherwise("DEFENSIBLE")


def totals(reports: DataFrame) -> DataFrame:
    """One row from reports(gap_id, valid): gaps with a record, valid and checked quotes."""
    return reports.agg(F.countDistinct("gap_id").alias("gaps"), F.count_if("valid").alias("valid_quotes"), F.count("valid").alias("checked_quotes"))


def worse(before: Column, proposed: Column) -> Column:
    """A critic may only raise the severity."""
    rank = lambda c: F.when(c == "UNSUPPORTED", 2).when(c == "WEAK", 1).otherwise(0)
    return F.when(proposed.isNotNull() & (rank(proposed) > rank(before)), proposed).otherwise(before)


def item_quotes(gaps: DataFrame, items: DataFrame) -> DataFrame:
    """(gap_id, id, kind, quote, source, start, end) of the backlog quotes of gaps(id, item_id, roadmap_quote). The source is the item's four parts in lines of their own, blank ones too, as offsets count them."""
    part = lambda c: F.coalesce(c, F.lit(""))
    source = F.concat_ws("\n", part(F.col("title")), part(F.col("body")), part(F.array_join("labels", " ")), part(F.col("milestone")))
    told = items.select(F.col("id").alias("item_id"), source.alias("source"))
    none = F.lit(None).cast("int")
    return gaps.where("item_id is not null and trim(coalesce(roadmap_quote, '')) <> ''").select(F.col("id").alias("gap_id"), "item_id", F.col("roadmap_quote").alias("quote")).join(told, "item_id").select("gap_id", F.col("item_id").alias("id"), F.lit("item").alias("kind"), "quote", "source", none.alias("start"), none.alias("end"))


def verified_spans(reports: DataFrame) -> DataFrame:
    """(gap_id, id, span): of each gap and signal the last valid report's span; reports(gap_id, id, kind, valid, found_span, position)."""
    ok = reports.where("valid and id is not null and found_span is not null and kind = 'signal'")
    return ok.groupBy("gap_id", "id").agg(F.max_by("found_span", "position").alias("span"))


def criticised(gaps: DataFrame, critic: Callable[[dict], dict | None]) -> DataFrame:
    """gaps with the critique that critic proposes where that is worse; the ids that it cites must all be the gap's own, else its answer is passed over.

    critic takes (id, latent_need, verdict, critique, signal_ids) as a dict and returns {critique, cited} or None.
    """
    asked = ("id", "latent_need", "verdict", "critique", "signal_ids")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers = []
            for row in f.to_dict("records"):
                row["signal_ids"] = list(row["signal_ids"])
                got = critic(row) or {}
                fine = got.get("critique") in ("DEFENSIBLE", "WEAK", "UNSUPPORTED") and set(got.get("cited") or ()) <= set(row["signal_ids"])
                answers.append(got["critique"] if fine else None)
            yield pd.DataFrame({"id": f["id"], "proposed": pd.Series(answers, index=f.index, dtype=object)})

    told = gaps.select(*asked).mapInPandas(run, "id string, proposed string")
    return gaps.join(told, "id", "left").withColumn("critique", worse(F.col("critique"), F.col("proposed"))).drop("proposed")
