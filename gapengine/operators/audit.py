"""Audits: counts that must reconcile, sources against normalised tables, two runs against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapengine.functions.text import valid_id


def ingest_audit(items: DataFrame) -> DataFrame:
    """(type, state, tier, n, bad_ids, no_priority, low) of the backlog."""
    p = F.col("priority")
    return items.groupBy("type", "state", p["tier"].alias("tier")).agg(F.count("*").alias("n"), F.count_if(~valid_id(F.col("id"))).alias("bad_ids"), F.count_if(p.isNull() | p["tier"].isNull()).alias("no_priority"), F.count_if(p["is_low_priority"]).alias("low"))


def counts_reconcile(total: Column, matching: Column, blank: Column, invalid: Column, duplicates: Column, emitted: Column) -> Column:
    """The residual is 0 and nothing is negative."""
    return (matching == blank + invalid + duplicates + emitted) & (matching <= total) & (F.least(blank, invalid, duplicates, emitted) >= 0)


#: Bits of a key's hash that name a leaf of the hash tree and its parent.
LEAF, PARENT = 16, 8


def digest_tree(df: DataFrame, keys: list[str]) -> DataFrame:
    """(level, bucket, n, d0 to d3): the hash tree of a table's rows by ranges of their keys' hashes, at levels 0 (all), PARENT and LEAF.

    A digest is a sum of the rows' 128-bit hashes in four parts, so it doesn't depend on the order of rows, counts repeated ones, and a parent's is the sum of its children's. One pass, aggregated
    where the rows are; 2^LEAF + 2^PARENT + 1 rows at most. Write it beside the table and the next run needs no look at the old rows.
    """
    cols = [F.col(c) for c in sorted(df.columns)]
    told = [*cols, *[c.isNull() for c in cols]]  # a hash passes over nulls
    h1, h2 = F.xxhash64(F.lit(1), *told), F.xxhash64(F.lit(2), *told)
    low = F.lit(0xFFFFFFFF).cast("long")
    parts = {"d0": h1.bitwiseAND(low), "d1": F.shiftrightunsigned(h1, 32), "d2": h2.bitwiseAND(low), "d3": F.shiftrightunsigned(h2, 32)}
    leaves = df.select(bucket_of(keys).alias("bucket"), *[v.alias(k) for k, v in parts.items()]).groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in parts])
    path = F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("bucket")), F.struct(F.lit(PARENT).alias("level"), F.shiftright("bucket", LEAF - PARENT).alias("bucket")), F.struct(F.lit(LEAF).alias("level"), F.col("bucket")))
    spread = leaves.select(F.explode(path).alias("at"), "n", *parts)
    return spread.groupBy(F.col("at.level").alias("level"), F.col("at.bucket").alias("bucket")).agg(F.sum("n").alias("n"), *[F.sum(F.col(k).cast("decimal(38,0)")).alias(k) for k in parts])


def bucket_of(keys: list[str]) -> Column:
    cols = [F.col(k) for k in keys]
    return F.shiftrightunsigned(F.xxhash64(*cols, *[c.isNull() for c in cols]), 64 - LEAF).cast("int")


def differing_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bucket): leaves of two hash trees that differ; only children of parents that differ are compared, and of equal trees none."""
    values = ["n", "d0", "d1", "d2", "d3"]

    def differ(level: int, above: DataFrame | None, step: int) -> DataFrame:
        a, b = (t.where(F.col("level") == level).select("bucket", F.struct(*values).alias(name)) for t, name in ((before, "a"), (after, "b")))
        if above is not None:
            up = F.broadcast(above.select(F.col("bucket").alias("parent")))  # 2^PARENT at most
            a, b = (t.join(up, F.shiftright("bucket", step) == F.col("parent"), "left_semi") for t in (a, b))
        return a.join(b, "bucket", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")

    top = differ(0, None, 0)
    parents = differ(PARENT, top, PARENT)
    return differ(LEAF, parents, LEAF - PARENT)


def narrowed(before: DataFrame, after: DataFrame, keys: list[str], tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of both whose ranges of keys differ; all others are alike and aren't exchanged. tree: digest_tree(before), if it was kept."""
    leaves = F.broadcast(differing_ranges(digest_tree(before, keys) if tree is None else tree, digest_tree(after, keys)))  # 2^LEAF at most
    return tuple(df.withColumn("bucket", bucket_of(keys)).join(leaves, "bucket", "left_semi").select(*df.columns) for df in (before, after))


def reconciled(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, status, differing): rows of either side alone and rows whose fields differ (nulls are equal); rows that agree are left out. Only ranges of keys whose digests differ are joined."""
    left, right = narrowed(left.select(*keys, *fields), right.select(*keys, *fields), keys)
    a = left.select(*keys, F.struct(*fields).alias("_a"))
    b = right.select(*keys, F.struct(*fields).alias("_b"))
    both = a.join(b, keys, "full_outer")
    differing = F.array_compact(F.array(*[F.when(~F.col("_a")[f].eqNullSafe(F.col("_b")[f]), F.lit(f)) for f in fields]))
    status = F.when(F.col("_a").isNull(), "right only").when(F.col("_b").isNull(), "left only").when(F.size("differing") > 0, "differs")
    return both.withColumn("differing", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), differing).otherwise(F.array().cast("array<string>"))).withColumn("status", status).where("status is not null").select(*keys, "status", F.array_join("differing", ",").alias("differing"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two runs has, with side. Only ranges of rows whose digests differ are compared."""
    after = after.select(*before.columns)
    before, after = narrowed(before, after, before.columns)
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def content_hash(df: DataFrame) -> str:
    """A digest of a table's rows in any order: the sum and the exclusive or of the rows' 64-bit hashes, and their number. One partial aggregation."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])))
    r = df.select(h.alias("h")).agg(F.bit_xor("h").alias("x"), F.sum((F.col("h") % 1_000_000_007).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return f"{r.n}:{(r.x or 0) & (2**64 - 1):016x}:{r.s or 0}"
