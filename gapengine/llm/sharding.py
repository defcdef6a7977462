"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly, equal texts stay together.

Texts fall into cells by a hash of the text, heavy cells into sub-cells by another one, and a text whose copies alone make up a good part of a shard is a unit of its own, so
copies always share a unit. The units' three-dimensional sizes, a bounded number, are packed by the driver, largest first, each into the shard where the dot product of its size
with the residual capacity is highest among those that it fits. A unit that fits into no shard whole is cut: one of several texts by a hash of the text, so copies still stay
together, and only a single heavy text by a hash of doc_id. Its parts are packed in its place. Rows then look up their unit and part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.llm import common as c

#: Cells, sub-cells of a heavy one, and the share of a shard from which on a cell is heavy.
CELLS, SUBCELLS, SHARE = 8192, 64, 1 / 16
#: A unit of over this share of a shard that fits nowhere whole is cut; smaller ones go where most bytes are left.
CUT = 1 / 64
#: Rows of a part, which one task ranks; never more than MOST parts.
ROWS, MOST = 100_000, 1 << 18


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, cell, sub_key, text_key, part_key) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    data = F.encode(text, "UTF-8")
    tokens = F.length(F.regexp_replace(F.regexp_replace(F.translate(text, "\t\n\x0b\x0c\r", "     "), "[^ ]+", "x"), " ", ""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), tokens.cast("long").alias("tokens"), F.crc32(data).alias("text_crc32"), F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int").alias("cell"), F.xxhash64(F.lit(3), text).alias("sub_key"), F.xxhash64(F.lit(7), text).alias("text_key"), F.xxhash64(F.lit(7), F.col("doc_id")).alias("part_key"))


def packed(sizes: np.ndarray, shards: int, parts: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The shard of each size vector (rows: units; columns: bytes, tokens, rows), and of the parts of those that had to be cut (-1 in the first).

    Dimensions are scaled to a capacity of one shard's fair share. Units go by falling largest component; each goes where the dot product with the residual capacity is highest among the
    shards that it fits in whole. One that fits nowhere is cut if it is over CUT of a shard and has parts: its parts go by the same rule. What fits nowhere and isn't cut goes where the first dimension leaves most.
    """
    total = np.maximum(sizes.sum(0), 1e-9)
    rest = np.ones((shards, sizes.shape[1]))
    out, cut = np.zeros(len(sizes), np.int64), {}

    def place(v: np.ndarray, must: bool) -> int:
        fits = (rest >= v - 1e-12).all(1)
        if not fits.any() and not must:
            return -1
        k = int(np.argmax(np.where(fits, rest @ v, -np.inf) if fits.any() else rest[:, 0]))
        rest[k] -= v
        return k

    scaled = sizes / total * shards
    for k in np.lexsort((np.arange(len(sizes)), -scaled.max(1))).tolist():
        pieces = (parts or {}).get(k)
        out[k] = place(scaled[k], pieces is None or scaled[k].max() <= CUT)
        if out[k] < 0:
            v = pieces / total * shards
            cut[k] = np.zeros(len(v), np.int64)
            for i in np.lexsort((np.arange(len(v)), -v.max(1))).tolist():
                cut[k][i] = place(v[i], True)
    return out, cut


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens): every row in a shard.

    size: UTF-8 bytes of the text (null: none) plus 1; the law is bytes: sizes are near equal. slot counts a shard's rows from 0
    without gaps. Equal texts share a shard unless they alone fit into none. Null texts and ids are rows like others; repeated
    rows all stay, with slots of their own; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = c.written(measured(docs), "sizes")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    vector = lambda r: (r.size, r.tokens, r.n)
    cells = rows.groupBy("cell").agg(*sums).collect()  # at most CELLS rows
    if not cells:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, tokens long")
    fair = np.maximum(np.array([vector(r) for r in cells], float).sum(0) / shards, 1e-9)
    share = lambda r: float((np.array(vector(r)) / fair).max())
    heavy = spark.createDataFrame([(r.cell, SUBCELLS) for r in cells if share(r) > SHARE] or [(-1, 1)], "cell int, subcells int")  # at most 3 * shards / SHARE rows
    # a text of over CUT of a shard is in a cell of over CUT, so few cells are looked through; at most 3 * shards / CUT texts are found
    suspects = spark.createDataFrame([(r.cell,) for r in cells if share(r) > CUT] or [(-1,)], "cell int")
    sizes = rows.join(F.broadcast(suspects), "cell").groupBy("sub_key", "text_key").agg(*sums)
    large = [i * CUT for i in fair.tolist()]
    loud = sizes.where((F.col("size") > large[0]) | (F.col("tokens") > large[1]) | (F.col("n") > large[2])).select("sub_key", "text_key").orderBy("sub_key", "text_key").collect()
    texts = spark.createDataFrame([(r.sub_key, r.text_key, k) for k, r in enumerate(loud, 1)] or [(0, 0, 0)], "sub_key long, text_key long, text int")
    marked = rows.join(F.broadcast(heavy), "cell", "left").withColumn("sub", F.coalesce(F.expr("cast(pmod(sub_key, subcells) as int)"), F.lit(0))).drop("subcells")
    marked = marked.join(F.broadcast(texts), ["sub_key", "text_key"], "left").withColumn("text", F.coalesce("text", F.lit(0)))
    unit = ["cell", "sub", "text"]
    units = marked.groupBy(*unit).agg(*sums).orderBy(*unit).collect()  # at most CELLS + 3 * shards / SHARE * SUBCELLS + 3 * shards / CUT rows
    most = max(ROWS, -(-sum(r.n for r in units) // MOST))
    n_parts = [min(r.n, int(np.ceil(share(r) / CUT))) if share(r) > CUT else 1 for r in units]
    n_slices = [-(-r.n // (n * most)) for r, n in zip(units, n_parts, strict=True)]  # of a part, so that no task has more than most rows to number, or hardly more
    several = spark.createDataFrame([(*(r[x] for x in unit), n, m) for r, n, m in zip(units, n_parts, n_slices, strict=True) if n > 1 or m > 1] or [(-1, 0, 0, 1, 1)], "cell int, sub int, text int, parts int, slices int")
    marked = marked.join(F.broadcast(several), unit, "left").withColumn("part", F.coalesce(F.expr("cast(pmod(if(text > 0, part_key, text_key), parts) as int)"), F.lit(0)))
    marked = marked.withColumn("slice", F.coalesce(F.expr("cast(pmod(xxhash64(part_key), slices) as int)"), F.lit(0))).drop("parts", "slices", "sub_key", "text_key", "part_key")
    found = marked.groupBy(*unit, "part", "slice").agg(*sums).orderBy(*unit, "part", "slice").collect()  # the units, their parts and at most MOST more slices
    index = {tuple(r[x] for x in unit): k for k, r in enumerate(units)}
    pieces: dict[int, dict[int, np.ndarray]] = {}
    for r in found:
        own = pieces.setdefault(index[r.cell, r.sub, r.text], {})
        own[r.part] = own.get(r.part, 0) + np.array(vector(r), float)
    where, cut = packed(np.array([vector(r) for r in units], float), shards, {k: np.array([x[p] for p in sorted(x)]) for k, x in pieces.items() if len(x) > 1})
    order = {k: {p: i for i, p in enumerate(sorted(x))} for k, x in pieces.items() if k in cut}
    first, at = [0] * shards, []
    for r in found:
        k = index[r.cell, r.sub, r.text]
        s = int(where[k]) if where[k] >= 0 else int(cut[k][order[k][r.part]])
        at.append((r.cell, r.sub, r.text, r.part, r.slice, s, first[s]))
        first[s] += r.n
    plan = spark.createDataFrame(at, "cell int, sub int, text int, part int, slice int, shard int, first long")
    plan = F.broadcast(plan) if len(at) <= 1 << 17 else plan
    own = F.row_number().over(W.partitionBy(*unit, "part", "slice").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = marked.withColumn("own", own).join(plan, [*unit, "part", "slice"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
