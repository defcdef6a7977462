"""Ingestion: triage, deduplication, identifiers, backlog normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapengine.functions import numbers, text, udfs
from gapengine.operators import priority


def of_package(rows: DataFrame, package: str) -> DataFrame:
    return rows.where(text.folded(F.col("package")) == package.strip().lower())


def triaged(rows: DataFrame, package: str | None = None) -> DataFrame:
    """rows(package, text, rating, time, source_id, version as strings) with parsed columns and status: other, blank, invalid or ok."""
    match = F.lit(True) if package is None else F.coalesce(text.folded(F.col("package")) == package.strip().lower(), F.lit(False))
    clean = F.coalesce(text.canonical(udfs.nfkc(F.col("text"))), F.lit(""))
    bad = numbers.invalid_rating(F.col("rating")) | numbers.invalid_datetime(F.col("time"))
    status = F.when(~match, "other").when(clean == "", "blank").when(bad, "invalid").otherwise("ok")
    return rows.select(F.col("package").alias("package_name"), clean.alias("text"), numbers.parse_rating(F.col("rating")).alias("rating"), numbers.parse_datetime(F.col("time")).alias("timestamp"), F.coalesce(F.col("source_id").cast("string"), F.lit("")).alias("source_id"), F.coalesce(F.col("version").cast("string"), F.lit("")).alias("version_id"), status.alias("status"))


def dedup_key(text_col: Column, rating: Column) -> Column:
    """One digest of the folded text and the rating, so that the exchange carries no texts as keys."""
    return F.sha2(F.concat_ws(text.INGEST_SEPARATOR, text.folded(text_col), F.coalesce(rating.cast("string"), F.lit(""))).cast("binary"), 256)


def deduplicated(rows: DataFrame, source: str = "reviews") -> DataFrame:
    """Signals: of rows with equal text and rating the one that is last by (time, source_id, version, text), with their number.

    max_by aggregates partially before the only exchange. Contradictory ratings of one text survive.
    """
    rep = F.struct(iso(F.col("timestamp")).alias("iso"), "source_id", "version_id", "text")
    body = F.struct("package_name", "text", "rating", "timestamp", "source_id", "version_id")
    groups = rows.groupBy(dedup_key(F.col("text"), F.col("rating")).alias("key")).agg(F.count("*").cast("int").alias("n"), F.max_by(body, rep).alias("x"))
    return signals(groups, source)


def iso(time: Column) -> Column:
    """A time as text that sorts as times do, with none first."""
    return F.coalesce(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))


def signals(groups: DataFrame, source: str = "reviews") -> DataFrame:
    """Signals of groups(n, x): the number of equal rows and the one that stands for them."""
    x = F.col("x")
    ident = text.stable_id("S", [F.lit(source), text.folded(x["package_name"]), text.folded(x["text"]), x["rating"]])
    return groups.select(ident.alias("id"), F.lit(source).alias("source"), x["source_id"].alias("source_id"), x["text"].alias("text"), x["timestamp"].alias("timestamp"), x["rating"].alias("rating"), x["package_name"].alias("package_name"), F.struct(F.col("n").alias("duplicate_count"), F.lit("text+rating").alias("deduplication"), x["version_id"].alias("version_id")).alias("metadata"))


def statistics(triage: DataFrame) -> DataFrame:
    """One row: total, matching, blank, invalid, duplicates and emitted rows. Distinct keys are counted by digest, in the same aggregation."""
    ok = F.col("status") == "ok"
    key = F.when(ok, dedup_key(F.col("text"), F.col("rating")))
    # two steps: the digests are pre-aggregated where they are read
    keyed = triage.groupBy(key.alias("key"), "status").agg(F.count("*").alias("n"))
    total = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("n"))), F.lit(0))
    emitted = F.count_if(F.col("status") == "ok")
    return keyed.agg(total("ok", "blank", "invalid", "other").alias("total_rows"), total("ok", "blank", "invalid").alias("matching_rows"), total("blank").alias("blank_rows"), total("invalid").alias("invalid_rows"), (total("ok") - emitted).alias("duplicate_rows"), emitted.alias("emitted_rows"))


def duplicate_ids(df: DataFrame, column: str = "id") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def profile(rows: DataFrame, by: str, text_col: str, time_col: str | None = None) -> DataFrame:
    """Per package: rows, distinct texts (by digest), first and last time."""
    own = rows.groupBy(by, F.xxhash64(text_col).alias("h")).agg(F.count("*").alias("n"), *([F.min(time_col).alias("first"), F.max(time_col).alias("last")] if time_col else []))
    times = [F.min("first").alias("first_time"), F.max("last").alias("last_time")] if time_col else []
    return own.groupBy(by).agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_texts"), *times)


def with_milestones(issues: DataFrame, milestones: DataFrame) -> DataFrame:
    """Issues without pull requests, each with its milestone's title and due date: the listed milestone's, else those embedded in the issue."""
    m = milestones.select(F.col("number").alias("m_number"), F.col("title").alias("m_title"), F.col("due").alias("m_due"), F.lit(True).alias("m_listed"))
    out = issues.where("pull_request is null").join(m, F.col("milestone_number") == F.col("m_number"), "left")
    title = F.when(F.col("m_listed"), F.col("m_title")).otherwise(F.col("milestone"))
    due = F.when(F.col("m_listed"), F.col("m_due")).otherwise(F.col("milestone_due"))
    return out.withColumn("milestone", title).withColumn("milestone_due", due).drop("m_number", "m_title", "m_due", "m_listed")


def label_names(labels: Column) -> Column:
    """Distinct label names in any case, first spelling kept, in case-insensitive order."""
    known = F.filter(labels, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    first = F.filter(known, lambda x, i: ~F.exists(F.slice(known, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda s: s["v"])


def roadmap(issues: DataFrame, milestones: DataFrame, repository: str, as_of: Column) -> DataFrame:
    """The normalised backlog: milestones, then issues, with derived priorities; ordered by type and number.

    issues(number, title, body, state, state_reason, labels, milestone, milestone_number, milestone_due, created_at, updated_at, closed_at, html_url, pull_request),
    milestones(number, title, body, state, due, created_at, updated_at, closed_at, html_url).
    """
    none = lambda kind: F.lit(None).cast(kind)
    own = milestones.select(F.lit("milestone").alias("type"), "number", "title", "body", "state", none("string").alias("state_reason"), F.array().cast("array<string>").alias("labels"), F.col("title").alias("milestone"), none("int").alias("milestone_number"), F.col("due").alias("milestone_due"), "created_at", "updated_at", "closed_at", "html_url")
    rest = with_milestones(issues, milestones).select(F.lit("issue").alias("type"), "number", "title", "body", "state", "state_reason", label_names(F.col("labels")).alias("labels"), "milestone", "milestone_number", "milestone_due", "created_at", "updated_at", "closed_at", "html_url")
    both = own.unionByName(rest)
    out = both.withColumn("priority", priority.derived(F.col("labels"), F.col("milestone"), F.col("milestone_due"), F.col("created_at"), F.col("state"), as_of))
    out = out.withColumn("milestone", F.when(F.col("type") == "issue", F.col("milestone")))
    ident = text.stable_id("R", [F.lit(repository.lower()), F.col("type"), F.col("number")])
    return out.select(ident.alias("id"), "type", F.lit(repository).alias("repository"), "number", "title", "body", "state", "state_reason", "labels", "milestone", "milestone_number", "milestone_due", "created_at", "updated_at", "closed_at", "html_url", "priority").orderBy(F.col("type") != "milestone", "number")
