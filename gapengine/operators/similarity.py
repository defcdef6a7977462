"""Vector similarity: pools of best matches, redundant pairs, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapengine.functions import numbers
from gapengine.functions.shared import Tables, shared_dir
from gapengine.operators import pivots


def _sides(rows: DataFrame, id_col: str, vec: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))


def top_k(queries: DataFrame, items: DataFrame, k: int, query_id: str, item_id: str, query_vec: str, item_vec: str, tables: Tables | None = None) -> DataFrame:
    """(query_id, item_id, similarity, rank): the k most similar items of each query; ties go to the lower item id. Blocks of items that can't hold one of them are skipped."""
    return pivots.nearest(_sides(queries, query_id, query_vec), _sides(items, item_id, item_vec), k, tables or Tables(queries.sparkSession, "nearest"))


def redundant_pairs(rows: DataFrame, threshold: float, id_col: str, vec: str, tables: Tables | None = None) -> DataFrame:
    """(a, b, similarity) with a < b and a cosine of at least threshold, which is over 0. Pairs of blocks that are too far apart are skipped."""
    if threshold <= 1e-12:
        raise ValueError("a threshold of 0 or less makes all pairs")
    return pivots.similar_pairs(_sides(rows, id_col, vec), threshold, tables or Tables(rows.sparkSession, "pairs"))


def redundant_groups(rows: DataFrame, threshold: float, id_col: str, vec: str, tables: Tables | None = None) -> DataFrame:
    """(id, root): what components(redundant_pairs()) gives, without the pairs of equal vectors: they are linked through the first of them by id, so a large group of copies makes as many rows. Of other similar pairs, a task returns no more than link what it compares."""
    own = _sides(rows, id_col, vec).where(F.exists("v", lambda x: x != 0))
    firsts = own.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    members = own.select("id", "v").join(firsts, "v").select("id", "first", "n")
    if threshold <= 1e-12:
        raise ValueError("a threshold of 0 or less makes all pairs")
    links = pivots.similar_pairs(firsts.select(F.col("first").alias("id"), "v"), threshold, tables or Tables(rows.sparkSession, "pairs"), spanning=True)
    roots = components(links)
    out = members.join(roots.withColumnRenamed("id", "first"), "first", "left")
    return out.where("root is not null or n > 1").select("id", F.coalesce("root", "first").alias("root"))


def candidate_similarity(needs: DataFrame, items: DataFrame, need_cols: dict[str, str], item_vec: str, pairs: DataFrame) -> DataFrame:
    """pairs(need_id, item_id) with one cosine for each of need_cols (name: vector column)."""
    own = pairs.join(needs.select(F.col("id").alias("need_id"), *need_cols.values()), "need_id").join(items.select(F.col("id").alias("item_id"), F.col(item_vec).alias("item_vec")), "item_id")
    return own.select("need_id", "item_id", *[numbers.cosine(F.col(c), F.col("item_vec")).alias(name) for name, c in need_cols.items()])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the least id that each can reach. Labels take the least neighbour's and then their label's label; each round is cut off by a checkpoint."""
    shared_dir(edges.sparkSession)
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root")).checkpoint()
    while True:
        near = e.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root")).checkpoint()
        far = hooked.select(F.col("id").alias("root"), F.col("root").alias("far"))
        after = hooked.join(far, "root", "left").select("id", "old", F.least("root", "far").alias("root")).checkpoint()
        labels = after.select("id", "root")
        if after.where("root <> old").isEmpty():
            return labels


def cohesion(members: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, n, cohesion): the mean cosine of all pairs of a group's vectors, from sums alone: (|sum|^2 - n) / (n (n - 1)); 0.5 for fewer than two. Zero vectors count as similar to nothing."""
    unit = members.select(group, numbers.normalized(F.col(vec)).alias("u")).withColumn("own", numbers.dot(F.col("u"), F.col("u")))
    parts = unit.select(group, "own", F.posexplode("u").alias("dim", "x"))
    sums = parts.groupBy(group, "dim").agg(F.sum("x").alias("s")).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    sizes = unit.groupBy(group).agg(F.count("*").alias("n"), F.sum("own").alias("own"))
    value = F.when(F.col("n") >= 2, (F.col("square") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(0.5))
    return sizes.join(sums, group).select(group, "n", value.alias("cohesion"))
