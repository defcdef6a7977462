"""Language identification by Bayesian evidence fusion.

Log-evidence adds up from four sources: the likelihood of the text under hashed byte trigrams, the declared markup language, the
language that the address suffix speaks for, and a prior of the host. The prior is smoothed hierarchically: a host's share of declared
languages over all its pages is shrunk to that of its registered domain, that to the address suffix's, that to the whole table's; all are grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.llm import common as c
from gapengine.llm.url_filter import host_of

#: Bound of the sample for the trigram model: documents of each language, those with the least hash of doc_id.
SAMPLE = 400
TABLE = 1 << 16
#: Trigrams overlap and follow from each other: a text speaks as loudly as this share of its trigrams would if they were independent.
VOICE = 0.25
#: A host of over so many rows (or 1 / HOSTS of all rows, if that is more) is hot: its rows are dealt over several keys.
HOT, HOSTS = 100_000, 1024
#: How sure a declaration and a suffix are, and the pseudo-counts of the hierarchy.
DECLARED, SUFFIX, KAPPA = 0.9, 0.8, 5.0
#: Address suffixes that stand for a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


def trigram_ids(data: np.ndarray) -> np.ndarray:
    """Hashed ids of all byte trigrams, A-Z as a-z."""
    x = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    return ((x[:-2] * 40503 + x[1:-1] * 2477 + x[2:] * 31) * np.uint32(2654435761) >> np.uint32(16)).astype(np.uint16) if len(x) > 2 else np.zeros(0, np.uint16)


class Profile:
    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs.astype(np.float32)

    @classmethod
    def fit(cls, rows: list[tuple[str, bytes]]) -> Profile:
        languages = sorted({x for x, _ in rows})
        counts = np.full((len(languages), TABLE), 0.5)
        for lang, text in rows:
            counts[languages.index(lang)] += np.bincount(trigram_ids(np.frombuffer(text, np.uint8)), minlength=TABLE)
        return cls(languages, np.log(counts / counts.sum(1, keepdims=True)) if languages else np.zeros((0, TABLE)))

    def likelihoods(self, texts: list[bytes | None]) -> np.ndarray:
        """Tempered log-likelihoods, a row for each text; texts under three bytes say nothing."""
        data = np.frombuffer(b"".join((t or b"") + b"  " for t in texts), np.uint8)
        n = np.array([len(t or b"") for t in texts])
        starts = np.concatenate([[0], np.cumsum(n + 2)[:-1]]).astype(np.int64)
        ids = np.concatenate([trigram_ids(data), [0, 0]]).astype(np.uint16)
        inside = np.ones(len(ids), bool)  # the two trigrams that begin in the padding
        ends = starts + n
        inside[ends] = inside[ends + 1] = False
        many = np.maximum(np.add.reduceat(inside.astype(np.int64), starts), 1)
        out = np.stack([np.add.reduceat(np.where(inside, row[ids], 0), starts, dtype=np.float64) for row in self.logs], 1) if len(self.languages) else np.zeros((len(texts), 0))
        return out / many[:, None] * (VOICE * many)[:, None] * (n > 2)[:, None]


def train(docs: DataFrame) -> Profile:
    """From at most SAMPLE documents of each language in documents(doc_id, text, lang), those with the least hashes of their ids. Only the picked texts come to the driver.

    Rows whose hash is so low that about three times SAMPLE of their language are lower are ranked, and no others, so what a task ranks is bounded.
    Only a row for each language is broadcast, far less than the profile's own 256 KB for each, which every worker is sent.
    """
    rows = docs.where("lang is not null and lang <> '' and text is not null and doc_id is not null").select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = rows.select("lang", "doc_id", c.uniform(F.col("doc_id")).alias("u"))
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"))
    low = own.join(F.broadcast(sizes), "lang").where(F.col("u") * F.col("n") < 3 * SAMPLE).select("lang", "doc_id", "u").distinct()
    picked = low.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("u", "doc_id"))).where(F.col("k") <= SAMPLE).select("lang", "doc_id")
    got = rows.join(F.broadcast(picked), ["lang", "doc_id"]).toLocalIterator()
    return Profile.fit(sorted((r.lang, r.text.encode()) for r in got))


def visible(html: Column) -> Column:
    """The text of a page: without scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")


def identified(rows: DataFrame, profile: Profile) -> DataFrame:
    """rows(origin, row_id, text, host, declared) with language and confidence; text is gone.

    Null texts and hosts and undeclared rows bring no evidence of that kind; ties go to the language that comes first in alphabetical order; without a trained language, language is null.
    Repeated rows all stay; an empty table gives no rows.
    """
    languages = profile.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = c.raw(b)
            for i, j in c.chunks(texts):
                out = profile.likelihoods(texts[i:j]).astype(np.float64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * len(languages), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in (0, 1, 3, 4)), flat], ["origin", "row_id", "host", "declared", "likelihood"])

    told = rows.select("origin", "row_id", "text", "host", "declared").mapInArrow(c.lean(run), "origin string, row_id long, host string, declared string, likelihood array<double>")
    if not languages:
        return told.select("origin", "row_id", "host", "declared", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"))
    host = F.coalesce("host", F.lit(""))
    told = c.written(told.withColumn("suffix", F.regexp_extract(host, r"([^.]*)$", 1)).withColumn("domain", F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)), "told")
    known = F.array(*map(F.lit, languages))
    # votes by (host, language), then levels of them as arrays in the languages' order
    votes = told.groupBy("host", "domain", "suffix", "declared").agg(F.count("*").alias("rows"), F.count(F.when(F.array_contains(known, F.col("declared")), 1)).alias("n"))
    hosts = c.checkpointed(votes.groupBy("host", "domain", "suffix").agg(F.sum("rows").alias("rows"), F.map_from_entries(F.collect_list(F.when(F.col("n") > 0, F.struct("declared", "n")))).alias("votes")))

    def above(df: DataFrame, *keys: str) -> DataFrame:
        each = df.select(*keys, F.explode_outer("votes").alias("declared", "n")).groupBy(*keys, "declared").agg(F.sum("n").alias("n"))
        return each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("n") > 0, F.struct("declared", "n")))).alias("votes"))

    def shrunk(parent: Column) -> Column:
        counts = F.transform(known, lambda x: F.coalesce(F.try_element_at("votes", x), F.lit(0)).cast("double"))
        own = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda x, p: (x + KAPPA * p) / (own + KAPPA))

    n = {r.declared: r.n for r in hosts.select(F.explode("votes").alias("declared", "n")).groupBy("declared").agg(F.sum("n").alias("n")).collect()}
    top = [(n.get(x, 0) + 1.0) / (sum(n.values()) + len(languages)) for x in languages]
    suffixes = above(hosts, "suffix").withColumn("prior_s", shrunk(F.array(*map(F.lit, top)))).drop("votes")
    domains = above(hosts, "domain", "suffix").join(suffixes, "suffix").withColumn("prior_d", shrunk(F.col("prior_s"))).drop("votes", "prior_s")
    priors = hosts.join(domains, ["domain", "suffix"]).select(F.col("host").alias("prior_host"), "rows", shrunk(F.col("prior_d")).alias("prior"))
    # the rows of a hot host, of which there are at most HOSTS, are dealt over salts; other hosts' priors aren't repeated
    total = hosts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    limit = max(HOT, -(-total // HOSTS))
    hot = hosts.where(F.col("rows") > limit).select(F.col("host").alias("hot_host"), F.ceil(F.col("rows") / limit).cast("int").alias("salts"))
    told = told.join(F.broadcast(hot), F.col("host").eqNullSafe(F.col("hot_host")), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("origin", "row_id"), F.col("salts")).cast("int"), F.lit(0))).drop("hot_host", "salts")
    salted = priors.withColumn("prior_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.when(F.col("rows") > limit, F.ceil(F.col("rows") / limit) - 1).otherwise(F.lit(0)).cast("int")))))
    joined = told.join(salted, told["host"].eqNullSafe(salted["prior_host"]) & (told["salt"] == salted["prior_salt"]))
    says = F.lit(None).cast("string")
    for suffix, lang in SUFFIXES.items():
        says = F.when(F.col("suffix") == suffix, F.lit(lang)).otherwise(says)
    m = max(2, len(languages))
    sure = lambda who, p, x: F.when(who.isNull() | ~F.array_contains(known, who), F.lit(0.0)).when(who == x, F.lit(float(np.log(p)))).otherwise(F.lit(float(np.log((1 - p) / (m - 1)))))
    logs = [F.col("likelihood")[k] + F.log(F.col("prior")[k]) + sure(F.col("declared"), DECLARED, x) + sure(F.col("says"), SUFFIX, x) for k, x in enumerate(languages)]
    out = joined.withColumn("says", says).withColumn("logs", F.array(*logs)).withColumn("top", F.array_max("logs"))
    best = F.element_at(known, F.array_position("logs", F.col("top")).cast("int"))
    return out.select("origin", "row_id", "host", "declared", best.alias("language"), (1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("confidence"))


def evidence(docs: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """The rows of identified(): documents(doc_id, text, source) with the source as host, pages(page_id, url, html) with the html lang attribute."""
    parts = []
    if docs is not None:
        parts.append(docs.select(F.lit("documents").alias("origin"), F.col("doc_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("declared")))
    if pages is not None:
        html = F.col("html").cast("string")
        lang = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang=["']?([A-Za-z]{2,3})""", 1))
        parts.append(pages.select(F.lit("pages").alias("origin"), F.col("page_id").cast("long").alias("row_id"), visible(html).alias("text"), host_of(F.col("url").cast("string")).alias("host"), F.when(lang != "", lang).alias("declared")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
