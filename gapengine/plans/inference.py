"""Need inference for one table of signals, or for many resampled ones in the same plan.

Every stage is keyed by the run that a row belongs to: clusters, needs and merges of different runs never meet, and all runs share each pass, each shuffle and each table that is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.functions import text, udfs
from gapengine.functions.shared import Tables, spread
from gapengine.operators import clustering, needs

if TYPE_CHECKING:
    from gapengine.plans.analyze import Config

SEPARATOR = "\x1f"
#: More clusters than a run can have.
CLUSTERS = 1 << 20
#: Members that are brought into order together before they are shown to a model, page by page.
BIN = 4096
ANSWER = "cluster_no long, bin int, page int, sample int, latent_need string, jtbd_statement string, symptom string, kano_class string, cited array<string>"


def felt(signals: DataFrame, config: Config, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """signals(id, text, source, rating, timestamp) with tokens, sentiment, intensity, has_friction and, for rows with friction, vec. None of it depends on other rows, so resampled runs share it."""
    embed = embed or (lambda c: udfs.hash_embed(c, config.dimensions))
    told = needs.sentiment(spread(signals), config.lexicon).withColumn("has_friction", needs.has_friction(config.lexicon))
    return told.withColumn("vec", F.when(F.col("has_friction"), embed(F.when(F.col("has_friction"), F.col("text")))))


def infer(rows: DataFrame, config: Config, tables: Tables, embed: Callable[[Column], Column] | None = None, extract: Callable | None = None, merge: Callable | None = None) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Needs (run, id, …) and members (run, need_id, id, …) of rows(run, …), felt() signals whose ids are unique within a run; and each run's number of signals.

    Clusters are named by the lexicon's domains or aspects, or dropped; all their members count. extract, if given, is a model of the caller's: a dict (cluster_no, ids, texts, aspects) to a list of answers, dicts of latent_need,
    jtbd_statement, symptom, kano_class and cited (ids). It is asked once for each page of at most max_members members. Answers that cite ids of other pages or lack a field don't count; the title that most answers of all pages
    agree on frames the need, and how many do is its self-consistency; the need's signals are those that each page's first such answer cites; without any valid answer the lexicon frames it. merge, if given, takes a list of dicts (id, latent_need) of a run and returns groups of ids; groups with unknown or repeated ids are refused.
    Signals left over that name exactly one domain join the need of that domain, if just one has it.
    """
    spark, lex = rows.sparkSession, config.lexicon
    embed = embed or (lambda c: udfs.hash_embed(c, config.dimensions))
    totals = {r.run: r.n for r in rows.groupBy("run").agg(F.count("*").alias("n")).collect()}  # a row for each run
    per_run = F.broadcast(spark.createDataFrame([(run, n, needs.adaptive_minimum(config.min_cluster, n)) for run, n in totals.items()], "run long, total long, least long"))
    kept = rows.where("has_friction").withColumn("item", F.col("id")).withColumn("id", F.concat_ws(SEPARATOR, F.col("run").cast("string"), "id"))
    kept = tables.keep(kept, "kept")
    labels = clustering.clustered_by(kept, "id", "vec", "run", tables).select("id", (F.col("run") * CLUSTERS + F.col("cluster")).alias("cluster_no"))
    members = kept.drop("vec").join(tables.keep(labels, "clusters"), "id")
    sizes = members.groupBy("run", "cluster_no").agg(F.count("*").alias("n")).join(per_run, "run").where("n >= least").select("cluster_no")
    members = tables.keep(members.join(sizes, "cluster_no"), "members")
    domains = lex.domain_words(spark)
    matches = tables.keep(needs.domain_match(members, domains, "cluster_no"), "matches")
    aspects = tables.keep(needs.cluster_aspects(members, "cluster_no", stop=lex.stop), "aspects")
    drop = needs.unnameable(members.select("cluster_no").distinct(), matches, aspects, domains, "cluster_no", lex.weak)
    named = tables.keep(members.join(drop, "cluster_no", "left_anti"), "named")
    frames = _frames(named, matches, aspects, lex, extract, tables, config.max_members)
    ground = needs.grounded(named, matches, domains, "cluster_no")
    if extract is not None:  # what an answer cites takes the place of what shares the domain's words
        cited = frames.where("from_model").select("cluster_no", F.explode("cited").alias("item"))
        ground = ground.join(frames.where("from_model").select("cluster_no"), "cluster_no", "left_anti").unionByName(named.join(cited, ["cluster_no", "item"]).select(*ground.columns))
    ground = tables.keep(ground, "grounded")
    ids = ground.groupBy("run", "cluster_no").agg(F.array_sort(F.collect_list("item")).alias("signal_ids"), F.min_by("text", "id").alias("first_text"))  # ids of all members, which the need lists
    kano = needs.kano(ground, "cluster_no").select("cluster_no", F.col("kano_class").alias("found_class"))
    base = frames.join(ids, "cluster_no").join(kano, "cluster_no").withColumn("kano_class", F.coalesce("kano_class", "found_class")).withColumn("symptom", F.coalesce("symptom", "first_text"))
    base = tables.keep(base.withColumn("key", F.concat_ws(SEPARATOR, F.col("run").cast("string"), text.ids_id("N", F.col("signal_ids")))).drop("found_class", "first_text", "cited"), "base")
    own = base.select("run", "key", F.explode("signal_ids").alias("item"))
    late = needs.stragglers(kept.select("id", "run", "tokens"), own.select(F.concat_ws(SEPARATOR, F.col("run").cast("string"), "item").alias("id")), base.where("not from_model and domain is not null").select(F.col("key").alias("need_id"), "domain", "run"), domains, by="run")
    late = late.join(kept.select("id", "run", "item"), "id").select("run", F.col("need_id").alias("key"), "item")
    own = tables.keep(own.unionByName(late).distinct(), "attached")
    scored = needs.scored(own.join(kept.select("run", "item", "sentiment", "intensity"), ["run", "item"]).join(per_run, "run"), "key", "total").select("key", "opportunity")
    lists = own.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("signal_ids"))  # with those that joined: as many as the domain has, as the need itself lists them
    base = tables.keep(base.drop("signal_ids").join(scored, "key").join(lists, "key"), "scored")
    roots = _roots(base, config, embed, merge)
    merged = needs.merged(base.select(F.col("key").alias("id"), "latent_need", "opportunity", "signal_ids", "aspects", "self_consistency", "failures"), roots)
    lead = base.select(F.col("key").alias("id"), "run", "jtbd_statement", "symptom", "kano_class", "domain", "samples")
    joined = merged.join(lead, "id").withColumn("merged_from", F.transform("merged_from", lambda x: F.substring_index(x, SEPARATOR, -1))).drop("id")
    joined = tables.keep(joined.withColumn("id", text.ids_id("N", F.col("signal_ids"))), "joined")
    parts = joined.select("run", F.col("id").alias("need_id"), F.explode("signal_ids").alias("item")).join(kept.drop("id", "vec"), ["run", "item"]).withColumnRenamed("item", "id")
    parts = tables.keep(parts, "need_members")
    of = F.concat_ws(SEPARATOR, F.col("run").cast("string"), "need_id").alias("key")
    again = needs.scored(parts.select(of, "sentiment", "intensity", "run").join(per_run, "run"), "key", "total").join(needs.temporal_scope(parts.select(of, "timestamp"), "key"), "key")
    out = joined.withColumn("key", F.concat_ws(SEPARATOR, F.col("run").cast("string"), "id")).join(again, "key")
    rounded = [F.round(x, 6).alias(y) for x, y in (("importance", "importance"), ("satisfaction", "satisfaction"), ("opportunity", "opportunity_score"))]
    out = out.select("run", "id", "latent_need", "jtbd_statement", "symptom", "signal_ids", "aspects", "kano_class", "domain", *rounded, "support", "mean_intensity", "self_consistency", "samples", "failures", "merged_from", "evidence_start", "evidence_end")
    return tables.keep(out, "needs"), parts, totals


def paged(members: DataFrame, most: int, cluster: str = "cluster_no", item: str = "item") -> DataFrame:
    """members with bin and page: each cluster's members by id, most of them a page at most. A cluster of over BIN members is dealt over several bins by hash first, so no task has to sort more."""
    bins = members.groupBy(cluster).agg(F.ceil(F.count("*") / F.lit(BIN)).alias("_bins"))
    own = members.join(bins, cluster).withColumn("bin", F.pmod(F.xxhash64(item), F.col("_bins")).cast("int")).drop("_bins")
    at = F.row_number().over(W.partitionBy(cluster, "bin").orderBy(item)) - 1
    return own.withColumn("page", F.floor(at / F.lit(most)).cast("int"))


def _frames(named: DataFrame, matches: DataFrame, aspects: DataFrame, lex, extract: Callable | None, tables: Tables, most: int) -> DataFrame:
    """(cluster_no, domain, latent_need, jtbd_statement, symptom, kano_class, aspects, cited, self_consistency, samples, failures, from_model); symptom and class are null where no model gave them."""
    spark = named.sparkSession
    top = aspects.groupBy("cluster_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "aspect"))), lambda x: x["aspect"]).alias("aspects"))
    templates = spark.createDataFrame([(d, title, job) for d, (title, job) in lex.templates.items()], "domain string, title string, job string")
    plain = named.select("cluster_no").distinct().join(matches.select("cluster_no", "domain"), "cluster_no", "left").join(templates, "domain", "left").join(top, "cluster_no", "left")
    first = F.try_element_at("aspects", F.lit(1))
    title, job = F.coalesce("title", F.concat(F.lit("Recurring problem with "), first)), F.coalesce("job", F.concat(F.lit("When I deal with "), first, F.lit(", I want it to go well")))
    plain = plain.select("cluster_no", "domain", title.alias("latent_need"), job.alias("jtbd_statement"), F.coalesce("aspects", F.array().cast("array<string>")).alias("aspects"))
    none = F.lit(None)
    if extract is None:
        return plain.select("*", none.cast("string").alias("symptom"), none.cast("string").alias("kano_class"), none.cast("array<string>").alias("cited"), F.lit(1.0).alias("self_consistency"), F.lit(0).alias("samples"), F.lit(0).cast("long").alias("failures"), F.lit(False).alias("from_model"))
    at = ["cluster_no", "bin", "page"]
    asked = paged(named, most).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("item", "text"))).alias("m")).join(top, "cluster_no", "left")  # a page
    asked = tables.keep(asked.select(*at, F.col("m.item").alias("ids"), F.col("m.text").alias("texts"), "aspects"), "asked")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for c in f.to_dict("records"):
                told = extract({k: list(v) if isinstance(v, np.ndarray) else v for k, v in c.items() if k not in ("bin", "page")}) or []
                rows += [(*(c[x] for x in at), k, *(a.get(x) for x in ("latent_need", "jtbd_statement", "symptom", "kano_class")), [str(i) for i in a.get("cited") or []]) for k, a in enumerate(told)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWER.split(", ")])

    answers = tables.keep(asked.mapInPandas(run, ANSWER), "answers").join(asked.select(*at, "ids"), at)
    ok = F.coalesce(needs.valid_extraction(F.col("cited"), F.col("ids"), F.col("kano_class"), F.col("latent_need"), F.col("jtbd_statement"), F.col("symptom")), F.lit(False))
    answers = answers.withColumn("ok", ok).withColumn("key", F.lower(text.canonical(F.col("latent_need"))))
    counts = answers.groupBy("cluster_no").agg(F.count("*").cast("int").alias("samples"), F.count_if(~F.col("ok")).alias("failures"))
    valid = answers.where("ok")
    told = F.struct("bin", "page", "sample", "latent_need", "jtbd_statement", "symptom", "kano_class", "cited")
    chosen = valid.join(_agreed(valid, counts), ["cluster_no", "key"]).groupBy(*at).agg(F.min(told).alias("a"), F.max("self_consistency").alias("told"))
    chosen = chosen.groupBy("cluster_no").agg(F.min("a").alias("a"), F.max("told").alias("told"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("a.cited")))).alias("cited"))
    out = plain.withColumnsRenamed({"latent_need": "own_need", "jtbd_statement": "own_job"}).join(counts, "cluster_no", "left").join(chosen, "cluster_no", "left")
    return out.select(
        "cluster_no", "domain", F.coalesce("a.latent_need", "own_need").alias("latent_need"), F.coalesce("a.jtbd_statement", "own_job").alias("jtbd_statement"), "aspects", F.col("a.symptom").alias("symptom"), F.col("a.kano_class").alias("kano_class"),
        "cited", F.coalesce("told", F.lit(0.0)).alias("self_consistency"), F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), F.col("a").isNotNull().alias("from_model"),
    )


def _agreed(valid: DataFrame, counts: DataFrame) -> DataFrame:
    """(cluster_no, key, self_consistency) of the title that most valid answers give, out of all that were asked."""
    told = needs.consensus(valid, "cluster_no", "latent_need", 1).join(counts, "cluster_no")
    return told.select("cluster_no", F.col("signature").alias("key"), F.round(F.col("self_consistency") / F.col("samples"), 6).alias("self_consistency"))


def _roots(base: DataFrame, config: Config, embed: Callable[[Column], Column], merge: Callable | None) -> DataFrame:
    """(id, root): needs of one run that say the same: framings with a cosine of merge_at at least, and what the caller's model puts together. A run has at most as many needs as clusters, which k-means bounds."""

    def grouped(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id").reset_index(drop=True)
        x = np.array(f["v"].tolist(), float).reshape(len(f), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        links = [tuple(p) for p in np.argwhere(np.triu(x @ x.T >= config.merge_at - 1e-12, 1)).tolist()]
        if merge is not None:
            at, used = {i: k for k, i in enumerate(f["id"])}, set()
            told = [[str(i) for i in g] for g in merge([{"id": i, "latent_need": t} for i, t in zip(f["id"], f["latent_need"], strict=True)]) or []]
            flat = [i for g in told for i in g]
            bad = {i for i in flat if i not in at or flat.count(i) > 1}
            for g in told:
                if len(g) > 1 and not bad & set(g):
                    links += [(at[g[0]], at[i]) for i in g[1:]]
                used |= set(g)
        root = list(range(len(f)))

        def find(k: int) -> int:
            while root[k] != k:
                k = root[k]
            return k

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return pd.DataFrame({"id": f["id"], "root": [f["id"][find(k)] for k in range(len(f))]})

    return base.select("run", F.col("key").alias("id"), "latent_need", embed(F.concat_ws("\n", "latent_need", "jtbd_statement")).alias("v")).groupBy("run").applyInPandas(grouped, "id string, root string")


def stability(signals: DataFrame, config: Config, iterations: int = 40, fraction: float = 0.8, seed: int = 0, embed: Callable[[Column], Column] | None = None, tables: Tables | None = None, told: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """(title, survival, mean_jaccard, baseline_signals, shipped): how often each need comes back when inference runs on subsamples without replacement, all of them in one plan.

    Needs that only subsamples have are not shipped: their baseline has no signals. told: felt(signals); baseline: needs(latent_need, signal_ids), if they were made before.
    """
    if iterations < 1 or not 0 < fraction <= 1:
        raise ValueError("iterations must be positive and the fraction in (0, 1]")
    tables = tables or Tables(signals.sparkSession, "stability")
    told = tables.keep(felt(signals, config, embed), "felt") if told is None else told
    if baseline is None:
        baseline = infer(told.withColumn("run", F.lit(0).cast("long")), config, tables, embed)[0]
    drawn = clustering.replicates(told, iterations, fraction, seed=seed).withColumn("run", F.col("replicate").cast("long")).drop("replicate")
    runs, _, _ = infer(tables.keep(drawn, "drawn"), config, tables, embed)
    runs = runs.select(F.col("run").alias("replicate"), F.col("latent_need").alias("title"), "signal_ids")
    base = baseline.select(F.col("latent_need").alias("title"), "signal_ids")
    out = clustering.survival(runs, base, iterations).withColumn("shipped", F.lit(True))
    others = runs.join(base.select("title").distinct(), "title", "left_anti").groupBy("title").agg(F.round(F.count_distinct("replicate") / iterations, 4).alias("survival"))
    return tables.keep(out.unionByName(others.select("title", "survival", F.lit(0.0).alias("mean_jaccard"), F.lit(0).alias("baseline_signals"), F.lit(False).alias("shipped"))), "stability")
