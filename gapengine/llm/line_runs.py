"""Line dedup across documents by levelled sorted runs of line hashes.

DataFrame functions only. A run is a table with one row for each line hash of a batch of documents: in how many documents it stood, and the largest doc_id that holds it. Runs are
bucketed and sorted by hash, so that a batch, once it is shuffled and sorted in the same way, is merge-joined with each of them without moving them. A batch is merge-anti-joined with the runs:
hashes that a run has settled (found often enough, last in a document that isn't older) bring nothing new; the others make the batch's own run on level 0. As soon as a level
has FANOUT runs they are merged into one of the next level, so a batch meets few runs, however many came before. Rows of all runs add up, in any order of batches.

Lines that repeat very often (there can only be so many of them) are matched by a broadcast where they stand; all others are matched by a join on the hash, where no hash has many rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapengine.llm import common as c
from gapengine.llm.url_filter import LOWER, UPPER

#: White space that is stripped at a line's ends.
BLANK = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 20, 3
FANOUT, BATCHES = 2, 4
#: A hash with more than this part of a batch's lines is hot: at most as many hashes in each batch are.
HOT_PART = 2048
NO_ID = -(1 << 63)


def keys(text: Column) -> Column:
    """The lines of a text, stripped, A-Z in lower case; null and empty texts have one empty line. Lines of ASCII take the faster way."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: lowered(F.btrim(x, F.lit(BLANK))))


def lowered(x: Column) -> Column:
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def named(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): rows of docs; doc_id null is less than all others; rows with the same id and text are the same."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), text.alias("text"))


def lines(rows: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, mark, at, h1, h2, first) of each line with a key of at least least_chars code points; first: no earlier line of its document has the key. Hashes have 128 bits."""
    hashed = F.transform(keys(F.col("text")), lambda x, i: F.when(F.char_length(x) >= least_chars, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), i.alias("at"))))
    ordered = rows.select("doc", "mark", F.array_sort(F.array_compact(hashed)).alias("own"))
    before = F.slice(F.concat(F.array(F.lit(None).cast("struct<h1:bigint,h2:bigint,at:int>")), F.col("own")), F.lit(1), F.size("own"))
    marked = F.zip_with("own", before, lambda x, y: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["at"].alias("at"), (y.isNull() | (x["h1"] != y["h1"]) | (x["h2"] != y["h2"])).alias("first")))
    return ordered.select("doc", "mark", F.inline(marked)).select("doc", "mark", "at", "h1", "h2", "first")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs merged into one: a merge join of what is bucketed and sorted by the joined columns, so nothing is shuffled."""
    a, b = a.select("h1", "h2", F.col("n").alias("n_a"), F.col("last").alias("last_a")), b.select("h1", "h2", F.col("n").alias("n_b"), F.col("last").alias("last_b"))
    sums = (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"), F.greatest("last_a", "last_b").alias("last")
    return a.join(b.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", *sums)


class Runs:
    """The levelled runs of all batches so far. Tables are kept in the shared folder under names of their own in the session's catalog."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, least_docs: int = LEAST_DOCS):
        self.spark, self.fanout, self.least = spark, fanout, least_docs
        self.buckets, self.levels, self.seen = c.partitions(spark), [], set()

    def _kept(self, df: DataFrame) -> str:
        """df(h1, h2, n, last) as a run: bucketed and sorted by hash."""
        name = f"line_run_{uuid.uuid4().hex}"
        df.select("h1", "h2", "n", "last").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd").option("path", f"{c.shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _dropped(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            c.removed(self.spark, f"{c.shared_dir(self.spark)}/{name}")

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: str, found: DataFrame) -> None:
        """Takes up the lines of one batch, of documents that no other batch has. A batch that was taken up before, by name, changes nothing, so a job that failed may be run again."""
        if batch in self.seen:
            return
        own = found.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        for run in self.tables():
            known = run.where(F.col("n") >= self.least).select("h1", "h2", F.col("last").alias("known_last"))
            own = own.join(known.hint("merge"), (own.h1 == known.h1) & (own.h2 == known.h2) & (own.last <= known.known_last), "left_anti")
        name = self._kept(own)
        self.levels = self.levels or [[]]
        self.levels[0].append(name)
        self.seen.add(batch)
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._kept(self.merged(level))
                self.levels += [[]] if k + 1 == len(self.levels) else []
                self.levels[k + 1].append(merged)
                self.levels[k] = []
                self._dropped(level)

    def merged(self, names: list[str] | None = None) -> DataFrame:
        """(h1, h2, n, last) of the runs of these names, or of all."""
        runs = self.tables() if names is None else [self.spark.table(x) for x in names]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long, last long")
        return reduce(both, runs)

    def repeated(self) -> DataFrame:
        """(h1, h2, last) of the hashes that stand in at least least_docs documents."""
        return self.merged().where(F.col("n") >= self.least).select("h1", "h2", "last")

    def release(self) -> None:
        self._dropped([name for level in self.levels for name in level])
        self.levels = []


def hot(found: DataFrame, part: int = HOT_PART) -> DataFrame:
    """(h1, h2): the hashes with over a part-th of all lines; fewer than part, by counting."""
    return found.groupBy("h1", "h2").agg(F.count("*").alias("lines")).crossJoin(found.agg(F.count("*").alias("total"))).where(F.col("lines") * part > F.col("total")).select("h1", "h2")


def losses(found: DataFrame, repeated: DataFrame, often: DataFrame) -> DataFrame:
    """(doc, mark, at): the lines that go, of lines found, given repeated(h1, h2, last) and the hot hashes, which are few."""
    heavy = F.broadcast(often.withColumn("is_hot", F.lit(True)))
    dealt = found.select("doc", "mark", "at", "h1", "h2").join(heavy, ["h1", "h2"], "left")
    known = F.broadcast(repeated.join(F.broadcast(often), ["h1", "h2"]))
    of_hot = dealt.where("is_hot").join(known, ["h1", "h2"])
    others = dealt.where("is_hot is null").join(repeated, ["h1", "h2"])
    return of_hot.unionByName(others).where("doc <> last").select("doc", "mark", "at")


def deduplicated(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with the columns n_lines, n_dropped and kept: every line whose key stands in least_docs documents or more goes, but in the largest doc_id that holds it.

    Null and empty texts have one empty line and keep it. A null doc_id is less than all others. Each row is a document; rows of the same id each count as one, and those of the largest id keep
    their lines. Columns of docs named n_lines, n_dropped or kept are an error. An empty table gives no rows. Documents come in batches by id, the largest ids first,
    as then the document that keeps a line is known when its key is first met.
    """
    spark, tmp = docs.sparkSession, c.Scratch(docs.sparkSession)
    if clash := {"n_lines", "n_dropped", "kept"} & {x.lower() for x in docs.columns}:
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    # doubles: the span of 64-bit ids has 65 bits, and batches may be of any size
    ends = named(docs).where(F.col("doc") > NO_ID).agg(F.min("doc").alias("a"), F.max("doc").alias("b")).first()
    low, span = (float(ends.a), float(ends.b) - float(ends.a) + 1.0) if ends.a is not None else (0.0, 1.0)
    batch = F.least(F.greatest(F.floor((F.col("doc").cast("double") - low) / span * batches), F.lit(0)), F.lit(batches - 1)).cast("int")
    found = tmp.written(lines(named(docs), least_chars).withColumn("batch", batch), "lines", "batch")
    runs = Runs(spark, fanout, least_docs)
    often = None
    for b in reversed(range(batches)):
        own = found.where(F.col("batch") == b)
        runs.add(str(b), own)
        often = hot(own) if often is None else often.unionByName(hot(own))
    often = tmp.written(often.distinct(), "hot")
    repeated = tmp.written(runs.repeated(), "repeated")
    runs.release()
    lost = tmp.written(losses(found, repeated, often).groupBy("doc", "mark").agg(F.collect_set("at").alias("lost")), "lost")  # of one document each
    tmp.drop("lines", "hot", "repeated")
    rows = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__text": F.coalesce(F.col("text").cast("string"), F.lit(""))}).withColumn("__mark", F.xxhash64("__text"))
    mine = lost.select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), F.col("lost").alias("__lost"))
    rows = rows.join(mine.hint("merge"), ["__doc", "__mark"], "left").withColumn("__lines", F.split("__text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    kept = F.when(F.col("__lost").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n"))
    made = {"n_lines": F.size("__lines").cast("long"), "n_dropped": F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).cast("long"), "kept": kept}
    return rows.select(*docs.columns, *[v.alias(k) for k, v in made.items()])
