"""Need inference: sentiment, friction, aspects, domains, scores, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.functions import numbers, text
from gapengine.lexicon import DEFAULT, Lexicon


def count_in(tokens: Column, words) -> Column:
    known = F.array(*[F.lit(w) for w in sorted(words)]).cast("array<string>")
    return F.size(F.filter(tokens, lambda t: F.array_contains(known, t)))


def sentiment(df: DataFrame, lexicon: Lexicon = DEFAULT, text_col: str = "text", rating: str = "rating") -> DataFrame:
    """Adds tokens, n_positive, n_negative, sentiment and intensity. Words and rating blend .3 and .7; one of them alone decides; none gives 0."""
    df = df.withColumn("tokens", text.tokens(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumns({"n_positive": count_in(F.col("tokens"), lexicon.positive), "n_negative": count_in(F.col("tokens"), lexicon.negative), "n_intense": count_in(F.col("tokens"), lexicon.intense)})
    n = F.col("n_positive") + F.col("n_negative")
    lexical = F.when(n > 0, (F.col("n_positive") - F.col("n_negative")) / n)
    rated = F.when(F.col(rating).isNotNull(), numbers.clip((F.col(rating) - 3) / 2, -1, 1))
    value = F.when(lexical.isNotNull() & rated.isNotNull(), 0.7 * rated + 0.3 * lexical).otherwise(F.coalesce(rated, lexical, F.lit(0.0)))
    df = df.withColumn("sentiment", value)
    strength = F.least(F.lit(1.0), 0.65 * F.abs("sentiment") + 0.25 * F.least(F.lit(1.0), n / 3) + 0.1 * F.least(F.lit(1.0), F.col("n_intense") / 2))
    return df.withColumn("intensity", strength).drop("n_intense")


def aspect(df: DataFrame, allowed, id_col: str = "id", default: str = "general") -> DataFrame:
    """(id, aspect): the most frequent allowed token; of ties the one that comes first. Needs tokens; counted within the row."""
    known = F.array(*[F.lit(w) for w in sorted(allowed)]).cast("array<string>")
    hits = F.filter("tokens", lambda t: F.array_contains(known, t))
    ranked = F.transform(F.array_distinct(hits), lambda t: F.struct(F.size(F.filter(hits, lambda x: x == t)).alias("n"), (-F.array_position(hits, t)).alias("first"), t.alias("t")))
    return df.select(id_col, F.coalesce(F.array_max(ranked)["t"], F.lit(default)).alias("aspect"))


def has_friction(lexicon: Lexicon = DEFAULT, floor: float = 4.0) -> Column:
    """Unrated or rated below floor, or with a friction or negative word or a friction phrase. Needs tokens, text and rating."""
    words = F.array(*[F.lit(w) for w in sorted(lexicon.friction | lexicon.negative)]).cast("array<string>")
    return F.col("rating").isNull() | (F.col("rating") < floor) | F.arrays_overlap("tokens", words) | text.matches_any(F.col("text"), lexicon.phrases)


def friction_split(df: DataFrame, lexicon: Lexicon = DEFAULT, floor: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped rows."""
    marked = df.withColumn("has_friction", has_friction(lexicon, floor))
    return marked.where("has_friction").drop("has_friction"), marked.where("not has_friction").drop("has_friction")


def cluster_aspects(df: DataFrame, cluster: str, item: str = "id", top: int = 3, stop=(), min_length: int = 3) -> DataFrame:
    """(cluster, aspect, tf, df, score, rank): tf * (1 + ln((1 + n) / (1 + df))) over each cluster's tokens; ties by word. df counts items of the cluster."""
    words = df.select(cluster, item, F.explode("tokens").alias("aspect")).where(F.length("aspect") >= min_length)
    if stop:
        words = words.where(~F.col("aspect").isin(*sorted(stop)))
    per_item = words.groupBy(cluster, "aspect", item).agg(F.count("*").alias("k"))
    counts = per_item.groupBy(cluster, "aspect").agg(F.sum("k").alias("tf"), F.count("*").alias("df"))
    sizes = df.groupBy(cluster).agg(F.countDistinct(item).alias("n"))
    scored = counts.join(sizes, cluster).withColumn("score", F.round(F.col("tf") * (1 + F.log((1.0 + F.col("n")) / (1.0 + F.col("df")))), 6))
    rank = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("score"), "aspect"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(cluster, "aspect", "tf", "df", "score", "rank")


def domain_match(df: DataFrame, domains: DataFrame, cluster: str, item: str = "id") -> DataFrame:
    """(cluster, domain, score): the domain with the most keyword occurrences (of ties the greater name), if they are at least max(2, n div 8)."""
    words = df.select(cluster, F.explode("tokens").alias("word"))
    # counts by word shrink before they meet the (small) lexicon
    found = words.groupBy(cluster, "word").agg(F.count("*").alias("k")).join(domains, "word").groupBy(cluster, "domain").agg(F.sum("k").alias("score"))
    best = found.groupBy(cluster).agg(F.max(F.struct("score", "domain")).alias("x"))
    sizes = df.groupBy(cluster).agg(F.countDistinct(item).alias("n"))
    return best.join(sizes, cluster).where(F.col("x.score") >= F.greatest(F.lit(2), F.floor(F.col("n") / 8))).select(cluster, F.col("x.domain").alias("domain"), F.col("x.score").alias("score"))


def unnameable(clusters: DataFrame, matches: DataFrame, aspects: DataFrame, domains: DataFrame, cluster: str, weak=()) -> DataFrame:
    """Clusters without a domain and without a top aspect in the domains' vocabulary."""
    vocabulary = domains.select(F.col("word").alias("aspect")).where(~F.col("aspect").isin(*sorted(weak))) if weak else domains.select(F.col("word").alias("aspect"))
    named = aspects.join(vocabulary.distinct(), "aspect", "left_semi").select(cluster)
    return clusters.join(matches.select(cluster), cluster, "left_anti").join(named, cluster, "left_anti")


def grounded(members: DataFrame, matches: DataFrame, domains: DataFrame, cluster: str, item: str = "id") -> DataFrame:
    """Members that share a keyword with their cluster's domain; all members of clusters in which none does.

    Which domains a member shares a keyword with is found in its row, so tokens needn't travel to where its cluster is; the lexicon is one row, which is broadcast.
    """
    words = domains.groupBy("domain").agg(F.collect_set("word").alias("words"))
    lexicon = F.broadcast(words.agg(F.collect_list(F.struct("domain", "words")).alias("lexicon")))
    met = F.transform(F.filter("lexicon", lambda x: F.coalesce(F.arrays_overlap("tokens", x["words"]), F.lit(False))), lambda x: x["domain"])
    hit = members.crossJoin(lexicon).withColumn("met", met).drop("lexicon")
    flagged = hit.join(matches.select(cluster, "domain"), cluster, "left")
    flagged = flagged.withColumn("own", F.coalesce(F.array_contains("met", F.col("domain")), F.lit(False)).cast("int")).drop("met", "domain")
    some = flagged.groupBy(cluster).agg(F.max("own").alias("some"))
    return flagged.join(some, cluster).where((F.col("own") == 1) | (F.col("some") == 0)).drop("own", "some")


def capped(members: DataFrame, cluster: str, item: str = "id", most: int = 40) -> DataFrame:
    """The first members of each cluster by id, for a look at them; inference takes all. The window's group limit is applied before the exchange."""
    return members.withColumn("member_rank", F.row_number().over(W.partitionBy(cluster).orderBy(item))).where(F.col("member_rank") <= most).drop("member_rank")


def kano(df: DataFrame, cluster: str) -> DataFrame:
    """(cluster, negative_share, mean_intensity, kano_class)."""
    out = df.groupBy(cluster).agg(F.avg((F.col("sentiment") < 0).cast("double")).alias("negative_share"), F.avg("intensity").alias("mean_intensity"))
    name = F.when((F.col("negative_share") >= 0.6) | (F.col("mean_intensity") >= 0.65), "basic").when(F.col("negative_share") >= 0.25, "performance").otherwise("excitement")
    return out.withColumn("kano_class", name)


def scored(df: DataFrame, cluster: str, total: int | str) -> DataFrame:
    """(cluster, support, mean_sentiment, mean_intensity, importance, satisfaction, opportunity); total: signals of the whole corpus, or a column that has their number in each row of a cluster."""
    total = F.lit(total) if isinstance(total, int) else F.col(total)
    out = df.groupBy(cluster).agg(F.count("*").alias("support"), F.avg("sentiment").alias("mean_sentiment"), F.avg("intensity").alias("mean_intensity"), F.max(total).alias("_total"))
    total = F.col("_total")
    importance = F.least(F.lit(10.0), 3.5 + 4 * F.log1p(F.col("support").cast("double")) / F.log1p(total.cast("double")) + 2.5 * F.col("mean_intensity"))
    out = out.withColumn("importance", importance).withColumn("satisfaction", numbers.clip(5 * (F.col("mean_sentiment") + 1), 0, 10))
    return out.withColumn("opportunity", numbers.opportunity(F.col("importance"), F.col("satisfaction"))).drop("_total")


def temporal_scope(df: DataFrame, cluster: str, time: str = "timestamp") -> DataFrame:
    return df.groupBy(cluster).agg(F.min(time).alias("evidence_start"), F.max(time).alias("evidence_end"))


def stragglers(signals: DataFrame, assigned: DataFrame, needs: DataFrame, domains: DataFrame, item: str = "id", by: str | None = None) -> DataFrame:
    """(id, need_id): unassigned signals whose own best domain (two keyword hits at least) names exactly one need. needs(need_id, domain). by: a column of signals and needs that keeps runs apart."""
    free = signals.join(assigned.select(item), item, "left_anti")
    own = domain_match(free.withColumn("own", F.col(item)), domains, "own", item)
    keys = ["domain"] if by is None else ["domain", by]
    one = needs.groupBy(*keys).agg(F.count("*").alias("k"), F.min("need_id").alias("need_id")).where("k = 1")
    own = own.withColumnRenamed("own", item)
    own = own if by is None else own.join(signals.select(item, by), item)
    return own.join(one, keys).select(item, "need_id")


def consensus(samples: DataFrame, key: str, signature: str, requested: int | Column) -> DataFrame:
    """(key, signature, agreement, self_consistency): the most frequent normalised answer (ties alphabetical); null answers are invalid."""
    requested = F.lit(requested) if isinstance(requested, int) else requested
    valid = samples.where(F.col(signature).isNotNull()).groupBy(key, F.lower(text.canonical(F.col(signature))).alias("signature")).agg(F.count("*").alias("k"))
    # the least name of the greatest count: ordering by (count descending, name) through min
    best = valid.groupBy(key).agg(F.min(F.struct((-F.col("k")).alias("minus"), "signature")).alias("x"), F.sum("k").alias("valid"))
    agreement = -F.col("x.minus") / F.col("valid")
    return best.select(key, F.col("x.signature").alias("signature"), F.round(agreement, 6).alias("agreement"), F.round(agreement * F.col("valid") / requested, 6).alias("self_consistency"))


def valid_extraction(cited: Column, allowed: Column, kano_class: Column, *required: Column) -> Column:
    """Required fields are there, some ids are cited, all of them allowed, and the class is known."""
    full = F.lit(True)
    for c in required:
        full &= F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return full & F.coalesce(F.size(cited) > 0, F.lit(False)) & (F.size(F.array_except(cited, allowed)) == 0) & kano_class.isin("basic", "performance", "excitement")


def merged(needs: DataFrame, roots: DataFrame) -> DataFrame:
    """One row for each root of roots(id, root): the member with the highest opportunity (then least id) leads.

    needs(id, latent_need, opportunity, signal_ids, aspects, self_consistency, failures); needs without a root stand alone.
    """
    own = needs.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lead = F.struct((-F.col("opportunity")).alias("o"), "id", "latent_need", "aspects")
    out = own.groupBy("root").agg(
        F.min(lead).alias("lead"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("signal_ids")))).alias("signal_ids"),
        F.array_sort(F.collect_list(F.struct((-F.col("opportunity")).alias("o"), "id", "aspects"))).alias("all"), F.min("self_consistency").alias("self_consistency"), F.sum("failures").alias("failures"), F.array_sort(F.collect_set("id")).alias("ids"),
    )
    aspects = F.slice(F.array_distinct(F.flatten(F.transform("all", lambda x: x["aspects"]))), 1, 6)
    return out.select(F.col("lead.id").alias("id"), F.col("lead.latent_need").alias("latent_need"), "signal_ids", aspects.alias("aspects"), "self_consistency", "failures", F.when(F.size("ids") > 1, F.col("ids")).otherwise(F.array().cast("array<string>")).alias("merged_from"))


def invalid_merges(proposals: DataFrame, needs: DataFrame) -> DataFrame:
    """(group_id, need_id, problem) of proposals(group_id, need_id) that name unknown needs or one need in two groups."""
    unknown = proposals.join(needs.select(F.col("id").alias("need_id")), "need_id", "left_anti").select("group_id", "need_id", F.lit("unknown").alias("problem"))
    twice = proposals.groupBy("need_id").agg(F.countDistinct("group_id").alias("k")).where("k > 1").select("need_id")
    return unknown.unionByName(proposals.join(twice, "need_id", "left_semi").select("group_id", "need_id", F.lit("reused").alias("problem")))


def adaptive_minimum(configured: int, n: int) -> int:
    return max(2, min(configured, n // 8))
