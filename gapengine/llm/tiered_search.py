"""Ranked lexical search over a tiered index.

The impact of a posting (term, document) is a number that only the document and its count of the term decide; a document's score is the sum of weight times impact over an item's terms.
The index keeps postings by tiers: the first holds each term's highest impacts, every next one GROW times as many of lower ones, and for each term and tier the index knows the residual
bound, the highest impact that is left below. Postings lie in the order of their documents, in a folder for each tier.

A search reads the first tier for all items. What a document has there is a lower bound of its score, with the residuals of its other terms an upper one. An item is proven when the sum of
the residuals of all its terms is under its tenth lower bound: no document that it hasn't met can be among the ten. An item without that proof falls through, but only for
terms that it needs: those whose residuals together stay under the tenth lower bound aren't read deeper. Documents that may still be among the ten are then scored exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.llm import common as c

TOP = 10
#: The first tier holds at least so many postings of each term, and each tier that many times as many as those above.
FIRST, GROW = 1024, 16
#: Impacts are up to 1,000,000 and fall into levels; a tier is made of whole levels.
FULL, LEVELS = 1_000_000, 256
#: Items are searched in blocks of about so many (item, term) rows, which are broadcast: some 20 MB. As many terms, or rows to be scored exactly, are broadcast at most.
BLOCK = 200_000
SLICE = 1 << 20
#: Rows that a task sends at once.
EMIT = 1 << 16
#: Bytes that stand in terms, A-Z made lower; all others end a term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RAW = "row long, id long, n long, term string, tf long"


def counted(text: bytes | None) -> Counter:
    """The terms of a text and their counts. A long text is cut at ends of terms, so the terms of a slice are in memory at a time."""
    found: Counter = Counter()
    plain, at = (text or b"").translate(TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def counts(rows: DataFrame) -> DataFrame:
    """rows(id, text) as (row, id, n, term, tf): one row for each term of each text, and one without term for the text itself. row is a number of the text's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, terms, tfs = TaskContext.get().partitionId() << 40, [], [], []

        def full() -> pa.RecordBatch:
            row, own, n, k = map(np.array, zip(*held, strict=True))
            missing = np.equal(own, None)
            own = pa.array(np.repeat(np.where(missing, 0, own).astype(np.int64), k), pa.int64(), mask=np.repeat(missing, k))
            out = [pa.array(np.repeat(row, k)), own, pa.array(np.repeat(n, k)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())]
            held.clear(), terms.clear(), tfs.clear()
            return pa.RecordBatch.from_arrays(out, ["row", "id", "n", "term", "tf"])

        for b in batches:
            for own, text in zip(b.column(0).to_pylist(), c.raw(b), strict=True):
                found = counted(text)
                held.append((number, own, sum(found.values()), len(found) + 1))
                terms += [None, *found.keys()]
                tfs += [None, *found.values()]
                number += 1
                if len(terms) >= EMIT:
                    yield full()
        if held:
            yield full()

    return rows.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(c.lean(run), RAW)


def impact(n: Column, tf: Column, documents: int, length: int, longest: int) -> Column:
    """(1000000000 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L. Only where 64 bits are too few for 90 n N, decimals are used."""
    wide = 90 * longest * documents >= 1 << 63
    scaled = F.lit(90).cast("decimal(20,0)") * n.cast("decimal(19,0)") if wide else F.lit(90) * n
    m = div(scaled * F.lit(documents), F.lit(length)) + 10
    return div(F.lit(1_000_000_000).cast("long") * tf, F.lit(1000) * tf + F.lit(8) * m)


def div(a: Column, b: Column) -> Column:
    """Integer division, exact in 64 bits and in decimals."""
    return F.call_function("div", a, b).cast("long")


class Index:
    """A tiered index in the shared folder. terms(term, weight, rest): rest[k] is the highest impact below tier k; levels, postings(id, row, term_no, impact, tier)."""

    def __init__(self, docs: DataFrame, wanted: DataFrame | None = None, first: int = FIRST, grow: int = GROW):
        """Index of docs(id, text): of all terms, or of those of wanted(term), if that is given; numbers and lengths of documents and terms always count all."""
        spark = self.spark = docs.sparkSession
        self.tmp = tmp = c.Scratch(spark)
        found = counts(docs)
        if wanted is not None:
            mine = tmp.written(wanted.select("term").distinct().withColumn("asked", F.lit(True)), "asked")
            few = mine.limit(BLOCK + 1).count() <= BLOCK
            found = found.join(F.broadcast(mine) if few else mine, "term", "left").where("asked or term is null").drop("asked")
        raw = tmp.written(found.select("row", "id", "n", "term", "tf"), "counts")
        total = raw.where("term is null and n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length"), F.max("n").alias("longest")).first()
        self.documents, length, longest = total.documents, total.length or 1, total.longest or 0
        level = lambda g: div(g * LEVELS, F.lit(FULL + 1)).cast("int")
        rows = raw.where("term is not null").withColumn("impact", impact(F.col("n"), F.col("tf"), self.documents, length, longest)).withColumn("level", level(F.col("impact")))
        steps = rows.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("impact").alias("top"))
        above = F.coalesce(F.sum("n").over(W.partitionBy("term").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        tier = F.when(above < first, 0).otherwise(F.floor(F.log(above / first) / F.log(F.lit(float(grow))) + 1e-9) + 1).cast("int")
        steps = tmp.written(steps.withColumn("tier", tier), "levels")
        self.depth = (steps.agg(F.max("tier").alias("t")).first().t or 0) + 1
        rest = F.array(*[F.coalesce(F.max(F.when(F.col("tier") > k, F.col("top"))), F.lit(0)) for k in range(self.depth)])
        weight = F.floor(1000 * F.log((F.lit(2.0) * self.documents + 2) / (2 * F.sum("n") + 1))).cast("long")
        self.terms = tmp.written(steps.groupBy("term").agg(weight.alias("weight"), rest.alias("rest")).withColumn("term_no", F.monotonically_increasing_id()), "terms")
        numbers = self.terms.select("term", "term_no")
        tiers = tmp.written(steps.join(numbers, "term").select("term", "level", "tier", "term_no"), "tiers")
        small = tiers.limit(BLOCK + 1).count() <= BLOCK
        rows = rows.select("row", "id", "term", "impact", "level").join(F.broadcast(tiers) if small else tiers, ["term", "level"]).select("id", "row", "term_no", "impact", "tier")
        self.postings = tmp.written(rows.sortWithinPartitions("tier", "row"), "postings", "tier")
        tmp.drop("asked", "counts", "levels", "tiers")

    def release(self) -> None:
        self.tmp.drop("terms", "postings")


def searched(index: Index, plan: DataFrame, tmp: c.Scratch, top: int) -> tuple[DataFrame, DataFrame]:
    """(item, row) that may be among an item's best, and (item, read): the tiers that it took, for a block of items: plan(item, term_no, weight, rest), which is broadcast."""
    rests = lambda d: F.element_at("rest", d + 1)
    plan = plan.withColumn("depth", F.lit(0))
    floor = plan.select("item").distinct().withColumn("floor", F.lit(0).cast("long"))
    done, read, k = [], [], 0
    while True:
        plan = tmp.written(plan.withColumn("left", F.col("weight") * rests(F.col("depth"))), "plan")
        deepest = plan.agg(F.max("depth").alias("d")).first().d
        if deepest is None:
            break
        state = tmp.written(plan.groupBy("item").agg(F.sum("left").alias("unseen")).join(floor, "item"), "state")
        near = index.postings.where(F.col("tier") <= deepest).join(F.broadcast(plan), "term_no").where("tier <= depth")
        low = near.groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("low"), F.sum(F.col("weight") * F.col("impact") - F.col("left")).alias("more"))
        met = low.join(F.broadcast(state), "item").withColumn("high", F.col("more") + F.col("unseen")).where("high >= floor")
        met = tmp.written(met.select("item", "row", "low", "high"), "met")
        best = met.withColumn("k", F.row_number().over(W.partitionBy("item").orderBy(F.desc("low"), "row"))).where(F.col("k") <= top)
        bar = best.groupBy("item").agg(F.when(F.count("*") == top, F.min("low")).otherwise(0).alias("bar"))
        state = tmp.written(state.join(bar, "item", "left").select("item", "unseen", F.greatest(F.coalesce("bar", F.lit(0)), "floor").alias("floor")), "judged")
        proven = F.broadcast(state.where("unseen < floor or unseen = 0"))
        done.append(tmp.written(met.join(proven, "item").where("high >= floor").select("item", "row"), "near"))
        read.append(tmp.written(proven.select("item", F.lit(k + 1).alias("read")), "read"))
        going = plan.join(F.broadcast(state.where("not (unseen < floor or unseen = 0)")), "item")
        stays = F.sum("left").over(W.partitionBy("item").orderBy("left", "term_no").rowsBetween(W.unboundedPreceding, 0)) < F.col("floor")
        deeper = F.least(F.col("depth") + (1 if k < index.depth else index.depth), F.lit(index.depth - 1))  # terms may take turns; after some rounds all that count go to the bottom
        floor = going.select("item", "floor").distinct()
        plan = going.withColumn("stays", stays).withColumn("depth", F.when(F.col("stays") | (F.col("left") == 0), F.col("depth")).otherwise(deeper)).select("item", "term_no", "weight", "rest", "depth")
        k += 1
    out, levels = done[0] if done else None, read[0] if read else None
    for a, b in zip(done[1:], read[1:], strict=True):
        out, levels = out.unionByName(a), levels.unionByName(b)
    return out, levels


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, first: int = FIRST, grow: int = GROW, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score, tiers): the top documents of docs(doc_id, text) with a score above 0 for each of items(item_id, text); tiers: how many rounds of tiers the item took.

    Null and empty texts have no terms: such documents aren't found, such items get no rows. Rows of items with the same item_id (or none) are one item with the terms of all; each row of docs is
    a document of its own, so repeated rows rank beside each other, and of equal scores the smaller doc_id comes first, a null one last. Other columns are ignored. Empty tables give no rows.
    """
    spark, tmp = docs.sparkSession, c.Scratch(docs.sparkSession)
    asked = counts(items.select(F.col("item_id").alias("id"), "text")).where("term is not null").select("id", "term").distinct()
    asked = tmp.written(asked, "items")
    named = tmp.written(asked.select("id").distinct().withColumn("item", F.monotonically_increasing_id()), "named")
    index = Index(docs.select(F.col("doc_id").alias("id"), "text"), asked, first, grow)
    plan = asked.join(named, asked.id.eqNullSafe(named.id)).select("item", "term").join(index.terms, "term").where("weight > 0").select("item", "term_no", "weight", "rest")
    n = (plan := tmp.written(plan, "asked")).count()
    blocks = -(-n // block)
    near, tiers = None, None
    for b in range(blocks):
        own = plan.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        some, read = searched(index, own, tmp, top)
        if some is not None:
            near, tiers = (some, read) if near is None else (near.unionByName(some), tiers.unionByName(read))
    shape = "item_id long, rank int, doc_id long, score long, tiers int"
    if near is None:
        out = spark.createDataFrame([], shape)
    else:
        near = tmp.written(near, "all_near")
        few = near.limit(BLOCK + 1).count() <= BLOCK
        held = index.postings.join(F.broadcast(near) if few else near, "row")
        weights = plan.select("item", "term_no", "weight")
        scores = held.join(F.broadcast(weights) if n <= block else weights, ["item", "term_no"]).groupBy("item", "row", "id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score")).where("score > 0")
        order = W.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
        best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out = best.join(tiers, "item").join(named.withColumnRenamed("id", "item_id"), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score", F.col("read").alias("tiers"))
    out = c.written(out, "ranked")
    index.release()
    tmp.drop(*tmp.paths)
    return out
