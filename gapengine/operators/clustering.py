"""Clustering of vectors: greedy for few rows, k-means for many; resampled stability."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.functions.shared import Tables
from gapengine.operators import minibatch

THRESHOLD, FEW = 0.26, 100
#: Bits of a hash that name the bin of a resampled row.
BIN_BITS = 12


def greedy_labels(vectors: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """In order: each row joins the most similar centroid (the first of equals) from the threshold on, else it begins a cluster; a centroid is the normalised mean."""
    labels, sums, centroids = [], [], []
    for v in vectors:
        if centroids:
            s = np.array(centroids) @ v
            k = int(np.argmax(s))
            if s[k] >= threshold:
                labels.append(k)
                sums[k] = sums[k] + v
                n = np.linalg.norm(sums[k])
                centroids[k] = sums[k] / n if n else sums[k]
                continue
        labels.append(len(sums))
        sums.append(v.copy())
        centroids.append(v.copy())
    return np.array(labels, int)


def greedy(rows: DataFrame, id_col: str, vec: str, group: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(group, id, cluster) of groups of under FEW rows, which is checked; the method is sequential in id order by definition."""
    own = rows.select((F.col(group) if group else F.lit(0)).cast("long").alias("grp"), F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(vec).cast("array<double>").alias("v"))
    if own.groupBy("grp").count().where(F.col("count") >= FEW).limit(1).count():
        raise ValueError(f"greedy clustering takes fewer than {FEW} rows a group")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        x = np.array(pdf["v"].tolist(), float)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.DataFrame({"grp": pdf["grp"], "id": pdf["id"], "cluster": greedy_labels(np.divide(x, n, out=np.zeros_like(x), where=n > 0), threshold)})

    return own.groupBy("grp").applyInPandas(run, "grp long, id string, cluster int")


def k_for(n: int) -> int:
    return min(80, max(8, round(math.sqrt(n / 2))))


def k_means(rows: DataFrame, id_col: str, vec: str, n: int, seed: int = 42, tables: Tables | None = None) -> DataFrame:
    """(id, cluster) by mini-batch k-means of unit vectors, the best of several starts; k from the number of rows."""
    return minibatch.k_means(rows, id_col, vec, lambda _: min(k_for(n), n), seed, tables=tables).select("id", "cluster")


def clustered(rows: DataFrame, id_col: str, vec: str, tables: Tables | None = None) -> DataFrame:
    """(id, cluster): greedy under FEW rows, else k-means."""
    n = rows.count()
    if n < FEW:
        return greedy(rows, id_col, vec).select("id", "cluster")
    return k_means(rows, id_col, vec, n, tables=tables).select(F.col("id").cast("string").alias("id"), "cluster")


def clustered_by(rows: DataFrame, id_col: str, vec: str, group: str, tables: Tables | None = None) -> DataFrame:
    """(group, id, cluster): clustered() of each group by itself, all groups in the same passes. Groups are integers; of each, only a count comes to the driver."""
    sizes = {r.g: r.n for r in rows.groupBy(F.col(group).cast("long").alias("g")).agg(F.count("*").alias("n")).collect()}
    few, many = [g for g, n in sizes.items() if n < FEW], [g for g, n in sizes.items() if n >= FEW]
    out = rows.sparkSession.createDataFrame([], f"{group} long, id string, cluster int")
    if few:
        out = out.unionByName(greedy(rows.where(F.col(group).isin(few)), id_col, vec, group).select(F.col("grp").alias(group), "id", "cluster"))
    if many:
        found = minibatch.k_means(rows.where(F.col(group).isin(many)), id_col, vec, lambda n: min(k_for(n), n), group=F.col(group), tables=tables)
        out = out.unionByName(found.select(F.col("grp").alias(group), F.col("id").cast("string").alias("id"), "cluster"))
    return out


def replicates(rows: DataFrame, iterations: int = 40, fraction: float = 0.8, id_col: str = "id", seed: int = 0) -> DataFrame:
    """(replicate, …): subsamples without replacement of exactly max(1, floor(n * fraction)) rows each, by a hash of seed, replicate and id.

    The hashes' upper bits make BINS bins; whole bins are taken in order, and only the rows of the bin in which the size is reached are ranked. Rows of equal ids are told apart by nothing, so any of them may be taken.
    """
    n = rows.count()
    size = max(1, int(n * fraction)) if n else 0
    own = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("_h", F.xxhash64(F.lit(seed), F.col("replicate"), F.col(id_col)))
    own = own.withColumn("_bin", F.shiftright("_h", 64 - BIN_BITS))
    counts = own.groupBy("replicate", "_bin").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("replicate").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = counts.withColumn("_before", before).where((F.col("_before") < size) & (F.col("_before") + F.col("k") >= size)).select("replicate", F.col("_bin").alias("_cut"), (F.lit(size) - F.col("_before")).alias("_left"))
    dealt = own.join(F.broadcast(cuts), "replicate")  # a row for each replicate
    whole = dealt.where(F.col("_bin") < F.col("_cut"))
    last = dealt.where(F.col("_bin") == F.col("_cut")).withColumn("_rank", F.row_number().over(W.partitionBy("replicate").orderBy("_h", id_col))).where(F.col("_rank") <= F.col("_left")).drop("_rank")
    return whole.unionByName(last).drop("_h", "_bin", "_cut", "_left")


def survival(runs: DataFrame, baseline: DataFrame, iterations: int) -> DataFrame:
    """(title, survival, mean_jaccard, baseline_signals): how often a title comes back and how like its signals are when it does.

    runs(replicate, title, signal_ids), baseline(title, signal_ids); equal titles of one run are one, their ids united.
    """
    one = lambda df, *keys: df.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("signal_ids"))).alias("ids"))
    base = one(baseline, "title").withColumnRenamed("ids", "base")
    both = one(runs, "replicate", "title").join(base, "title")
    jaccard = F.size(F.array_intersect("ids", "base")) / F.size(F.array_union("ids", "base"))
    seen = both.groupBy("title").agg(F.count("*").alias("k"), F.avg(jaccard).alias("j"))
    return base.join(seen, "title", "left").select("title", F.round(F.coalesce("k", F.lit(0)) / F.lit(iterations), 4).alias("survival"), F.round(F.coalesce("j", F.lit(0.0)), 4).alias("mean_jaccard"), F.size("base").alias("baseline_signals"))


def bootstrap(signals: DataFrame, infer: Callable[[DataFrame], DataFrame], baseline: DataFrame, iterations: int = 40, fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """survival() of infer(signals of all replicates, with a replicate column) -> (replicate, title, signal_ids): one plan for all replicates."""
    return survival(infer(replicates(signals, iterations, fraction, seed=seed)), baseline, iterations)
