"""Distributed connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapengine.llm.common import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every vertex of the undirected edges; root is the smallest vertex that can be reached.

    Edges with a null end are ignored; loops make a vertex of its own; repeated edges do no harm; no edges give no rows.
    Each round takes the least label of all neighbours, then the label of the label, so long chains
    shrink by powers; state is cut off by reliable checkpoints. Nothing but one count comes to the driver.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = checkpointed(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hooked = checkpointed(hooked)
        jump = hooked.select(F.col("v").alias("root"), F.col("root").alias("far"))
        after = checkpointed(hooked.join(jump, "root", "left").select("v", "old", F.least("root", "far").alias("root")))
        if after.where("root <> old").isEmpty():
            return after.select("v", "root")
        labels = after.select("v", "root")
