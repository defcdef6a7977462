"""Mixing sources to target weights: each document is repeated by a hash-seeded Poisson count, then all are shuffled.

DataFrame functions only. The mean of a source is its target share of all rows over its own rows; the count inverts the Poisson
distribution at a uniform hash of the document, so it is the same in every run and on every layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapengine.llm import common as c

#: Without explicit weights, a source weighs (its rows) ** ALPHA: large ones are toned down, small ones repeated.
ALPHA = 0.5
SEED = "mix-1"
#: Sources up to this number are broadcast with their distributions; more of them are joined by a shuffle.
SMALL = 2000
#: Terms of a distribution beyond mean + TAIL * sqrt(mean) + TAIL are below the resolution of the hash.
TAIL = 12
#: A larger mean is split into equal ones of at most this, drawn each at a hash of its own and added up, so a distribution has a bounded number of terms.
MOST = 400.0
#: Copies that one row makes at a time.
COPIES = 4096


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, n, rate, draws, cdf): rows, mean repetitions, the independent draws they are split into and the cumulative Poisson probabilities of one draw of each source. Null is a source like others; sources that weights doesn't name weigh 0."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        weighed = counts.withColumn("weight", F.coalesce(table[F.col("source")], F.lit(0.0)) if table is not None else F.lit(0.0))
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    rate = F.coalesce(F.col("all_n") * F.col("weight") / F.when(F.col("all_weight") > 0, F.col("all_weight")) / F.col("n"), F.lit(0.0))
    out = weighed.crossJoin(F.broadcast(total)).select("source", "n", rate.alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST).cast("int")))
    out = out.withColumn("mean", F.col("rate") / F.col("draws"))
    last = F.ceil(F.col("mean") + TAIL * F.sqrt("mean") + TAIL).cast("int")
    first = F.struct(F.exp(-F.col("mean")).alias("term"), F.exp(-F.col("mean")).alias("total"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def grow(acc, j):
        term = acc["term"] * F.col("mean") / j
        total = acc["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return out.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), first, grow, lambda acc: acc["cdf"])).drop("mean")


def _names(docs: DataFrame):
    """Names of helper columns that docs doesn't have."""
    prefix = "mix"
    while any(x.lower().startswith(f"{prefix}_") for x in docs.columns):
        prefix += "_"
    return lambda name: f"{prefix}_{name}"


def repeated(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """docs with n_copies and copy_no: each row as often as its Poisson count says (rows with 0 are gone), not shuffled yet.

    The count depends on the seed, doc_id and source alone; repeated rows have equal counts. Null ids and sources count like any other value; texts are never read.
    docs may have columns of any name but n_copies, copy_no and mix_key, which is an error.
    """
    if taken := {"n_copies", "copy_no", "mix_key"} & {x.lower() for x in docs.columns}:
        raise ValueError(f"columns that the result adds are there already: {', '.join(sorted(taken))}")
    mine = _names(docs)
    table = c.checkpointed(rates(docs, weights, alpha))
    known = table.select(F.col("source").alias(mine("source")), F.col("draws").alias(mine("draws")), F.col("cdf").alias(mine("cdf")))
    small = known.limit(SMALL + 1).count() <= SMALL
    if small:  # at most SMALL sources, at most MOST + TAIL * (sqrt(MOST) + 1) terms each
        joined = docs.join(F.broadcast(known), docs["source"].eqNullSafe(F.col(mine("source"))))
    else:  # the hot source's rows are dealt over salts
        salts = 64
        salted = known.withColumn(mine("salt"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        docs = docs.withColumn(mine("own_salt"), F.pmod(F.hash("doc_id"), F.lit(salts)))
        joined = docs.join(salted, docs["source"].eqNullSafe(F.col(mine("source"))) & (F.col(mine("own_salt")) == F.col(mine("salt")))).drop(mine("salt"), mine("own_salt"))
    # the first draw's hash is of document and source alone, each further one's also of its number
    draws, u, others, cdf, part = (mine(x) for x in ("draws", "u", "more", "cdf", "part"))
    more = F.when(F.col(draws) > 1, F.transform(F.sequence(F.lit(2), F.col(draws)), lambda j: c.uniform(seed, F.col("doc_id"), F.col("source"), j))).otherwise(F.array().cast("array<double>"))
    counted = joined.withColumn(u, c.uniform(seed, F.col("doc_id"), F.col("source"))).withColumn(others, more)
    below = lambda x: F.size(F.filter(F.col(cdf), lambda y: x >= y))
    counted = counted.withColumn("n_copies", below(F.col(u)) + F.aggregate(others, F.lit(0), lambda n, x: n + below(x))).drop(u, others, draws, cdf, mine("source"))
    dealt = counted.where("n_copies > 0").withColumn(part, F.explode(F.expr(f"sequence(1, n_copies, {COPIES})")))
    return dealt.withColumn("copy_no", F.explode(F.expr(f"sequence(`{part}`, least(n_copies, `{part}` + {COPIES - 1}))"))).drop(part)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """repeated(), globally shuffled: mix_key, a hash of document and copy, decides the partition and the order in it.

    An empty table gives no rows. Columns of docs are kept; mix_key, n_copies and copy_no are added.
    """
    spark = docs.sparkSession
    out = repeated(docs, weights, alpha, seed).withColumn("mix_key", F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy_no").cast("string")).cast("binary")))
    return out.repartition(c.partitions(spark), "mix_key").sortWithinPartitions("mix_key")
