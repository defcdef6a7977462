"""Blind labelling: packets, merging of two reviewers, validation of what returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bits of a hash that name the bin in which a pair is numbered; turns of a permutation; steps that an index may need to come back below the number of pairs.
BIN_BITS, TURNS, WALKS = 12, 4, 48
WITHHELD = ("verdict", "score", "rank", "confidence")


def numbered(pairs: DataFrame, id_col: str = "pair_id") -> tuple[DataFrame, int]:
    """pairs with index, from 0 without gaps, by a hash of the id, and their number. Pairs are ranked within bins of the hash, and the bins' sizes, of which there is a bounded number, make the ranks go on."""
    own = pairs.withColumn("_h", F.xxhash64(F.col(id_col).cast("string"))).withColumn("_bin", F.shiftright("_h", 64 - BIN_BITS))
    sizes = own.groupBy("_bin").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first().n
    before = sizes.select("_bin", F.coalesce(F.sum("_n").over(W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = own.withColumn("_k", F.row_number().over(W.partitionBy("_bin").orderBy("_h", id_col)) - 1)
    return ranked.join(F.broadcast(before), "_bin").withColumn("index", F.col("_k") + F.col("_before")).drop("_h", "_bin", "_k", "_before"), total


def permuted(index: Column, n: int, key: Column) -> Column:
    """A place from 0 to n - 1 for each index from 0 to n - 1, another permutation for each key, computed row by row: nothing is sorted.

    An index is a cell of a table of about sqrt(n) rows and columns. In turns the row is moved by a hash of the column and the column by a hash of the row, which can be undone, so no two cells meet.
    The table has a few cells more than n; an index that lands on one of those is moved again until it doesn't.
    """
    rows = max(1, math.isqrt(max(0, n - 1)) + 1)
    columns = max(1, -(-n // rows))
    noise = lambda turn, x: F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(str(turn)), x.cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")

    def moved(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, F.lit(columns)).cast("long").alias("r"), (x % F.lit(columns)).cast("long").alias("c"))

        def turn(cell: Column, k: Column) -> Column:
            r = (cell["r"] + noise("r", F.concat_ws(".", k.cast("string"), cell["c"].cast("string")))) % F.lit(rows)
            c = (cell["c"] + noise("c", F.concat_ws(".", k.cast("string"), r.cast("string")))) % F.lit(columns)
            return F.struct(r.cast("long").alias("r"), c.cast("long").alias("c"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), start, turn, lambda cell: cell["r"] * F.lit(columns) + cell["c"])

    out = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), moved(index.cast("long")), lambda x, _: F.when(x < n, x).otherwise(moved(x)))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("an index didn't come back")).cast("long"))


def packets(pairs: DataFrame, columns: list[str], reviewers: list[str], seed: int = 0, id_col: str = "pair_id", forbidden=WITHHELD) -> DataFrame:
    """(reviewer, position, columns): for each reviewer all pairs in an order of their own, with the allowed columns. Columns that would give the answer away are an error, and so are fewer than two distinct reviewers."""
    leaks = sorted({c.lower() for c in columns} & {c.lower() for c in forbidden})
    if leaks:
        raise ValueError(f"a blind packet can't hold {', '.join(leaks)}")
    names = [r.strip() for r in reviewers]
    if len(names) < 2 or len(set(names)) < len(names) or "" in names:
        raise ValueError("two distinct reviewers at least are needed")
    own, n = numbered(pairs, id_col)
    told = own.select("index", *columns).withColumn("reviewer", F.explode(F.array(*map(F.lit, sorted(names)))))  # a row for each reviewer
    return told.withColumn("position", permuted(F.col("index"), n, F.concat_ws(":", F.lit(str(seed)), F.col("reviewer")))).select("reviewer", "position", *columns)


def packet(pairs: DataFrame, columns: list[str], reviewer: str, seed: int = 0, id_col: str = "pair_id", forbidden=WITHHELD) -> DataFrame:
    """One reviewer's pairs in order."""
    return packets(pairs, columns, [reviewer, f"not {reviewer}"], seed, id_col, forbidden).where(F.col("reviewer") == reviewer).orderBy("position").select(*columns)


def merged(first: DataFrame, second: DataFrame, key: str = "pair_id") -> DataFrame:
    """(pair_id, verdict_1, verdict_2, agreed, verdict, notes, adjudicated) of pairs that both have answered; agreed ones take the first reviewer's verdict and aren't adjudicated yet."""
    a = first.where("verdict is not null").select(key, F.col("verdict").alias("verdict_1"), F.col("notes").alias("notes_1"))
    b = second.where("verdict is not null").select(key, F.col("verdict").alias("verdict_2"), F.col("notes").alias("notes_2"))
    out = a.join(b, key).withColumn("agreed", F.col("verdict_1") == F.col("verdict_2"))
    return out.select(key, "verdict_1", "verdict_2", "agreed", F.when(F.col("agreed"), F.col("verdict_1")).alias("verdict"), F.concat_ws(" | ", "notes_1", "notes_2").alias("notes"), F.lit(False).alias("adjudicated"))


def agreement(both: DataFrame) -> DataFrame:
    return both.agg(F.count("*").alias("answered"), F.count_if("agreed").alias("agreed"), F.round(F.avg(F.col("agreed").cast("double")), 6).alias("agreement"))


def confusion(both: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent disagreements."""
    return both.where("not agreed").groupBy("verdict_1", "verdict_2").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "verdict_1", "verdict_2").limit(top)


def validated(returned: DataFrame, packet_rows: DataFrame, gaps: DataFrame, key: str = "pair_id") -> DataFrame:
    """(pair_id, status): matched, unadjudicated, unmatched (no gap has the pair), alien (not in the packet), missing (in the packet, not returned).

    returned(pair_id, adjudicated), packet_rows(pair_id), gaps(pair_id).
    """
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    own = returned.groupBy(key).agg(F.bool_and(F.coalesce("adjudicated", F.lit(False))).alias("adjudicated"))
    out = own.withColumn("returned", F.lit(True)).join(mark(packet_rows, "sent"), key, "full_outer").join(mark(gaps, "gap"), key, "left")
    status = F.when(F.col("returned").isNull(), "missing").when(F.col("sent").isNull(), "alien").when(F.col("gap").isNull(), "unmatched").when(~F.col("adjudicated"), "unadjudicated").otherwise("matched")
    return out.select(key, status.alias("status"))


def drift(worklist: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, stale, drifted): worklist rows that are gone, and fields that have changed since."""
    a = worklist.select(key, F.struct(*fields).alias("_a"))
    b = current.select(key, F.struct(*fields).alias("_b"))
    out = a.join(b, key, "left")
    drifted: Column = F.array_compact(F.array(*[F.when(F.col("_b").isNotNull() & ~F.col("_a")[f].eqNullSafe(F.col("_b")[f]), F.lit(f)) for f in fields]))
    return out.select(key, F.col("_b").isNull().alias("stale"), F.array_join(drifted, ",").alias("drifted"))
