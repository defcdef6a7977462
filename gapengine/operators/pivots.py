"""Exact cosine joins that skip what can't match: vectors are dealt into blocks around pivots, and the triangle inequality of angles bounds a block or a pair of blocks.

The angle between two vectors is a metric. If all members of block a are between lo and hi from a pivot and those of block b between lo' and hi', no pair of them can be nearer than the gap
between the two intervals. A pair of blocks whose gap is over the angle of the threshold is skipped, and so is a block for a query whose k-th best match so far is nearer than the block can be.
Pivots only decide how much is skipped, never what is found, so they come from a bounded sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.functions.shared import Tables

#: Rows of a block: a task multiplies two blocks, so what it holds is bounded. Tables of up to so many rows are one block.
BLOCK = 4096
#: Pivots at most, rows of the sample that they are picked from for each of them, rings around a pivot, and pivots whose intervals bound a block.
PIVOTS, SAMPLE, RINGS, BOUNDS = 128, 16, 128, 8
#: Blocks of a pile at most, and values (rows by dimensions) that one may have: 32 MB. The nearest items of a query are looked for in a pile of blocks at a time.
PILE, PILE_VALUES = 16, 1 << 22
#: Angles are rounded: what is nearer than this to a bound isn't skipped.
SLACK = 1e-6


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors as rows of length one; zero vectors stay zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        raise ValueError("a vector is null")
    flat = np.asarray(column.flatten(), np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def picked(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots: of a sample the row that is farthest from those picked before, again and again; no point is picked twice."""
    own = sample[np.linalg.norm(sample, axis=1) > 0]
    if not len(own):
        return own
    out, near = [0], np.full(len(own), np.inf)
    while len(out) < most:
        near = np.minimum(near, angles(own, own[out[-1:]])[:, 0])
        far = int(near.argmax())
        if near[far] <= SLACK:
            break
        out.append(far)
    return own[out]


@dataclass
class Layout:
    """How a table's vectors are dealt: pivots, and for each (cell, ring) the first of its blocks and their number. cells: least and greatest angle to each bounding pivot, by cell."""

    pivots: np.ndarray
    blocks: dict[tuple[int, int], tuple[int, int]]

    @property
    def bounds(self) -> int:
        return min(BOUNDS, len(self.pivots))


def located(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows(id, v) with the cell of the nearest pivot, the ring that they are in, and their angles to the bounding pivots. Zero vectors, which have no angle, are in cell -1."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        q = min(BOUNDS, len(p))
        for b in batches:
            x = unit(b.column(1))
            a = angles(x, p) if len(x) else np.zeros((0, len(p)))
            zero = ~x.any(axis=1)
            cell = np.where(zero, -1, a.argmin(axis=1) if len(x) else 0)
            ring = np.where(zero, 0, np.minimum((a.min(axis=1) / math.pi * RINGS), RINGS - 1) if len(x) else 0).astype(np.int32)
            near = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * q, pa.int32()), pa.array(a[:, :q].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(ring), near], ["id", "v", "cell", "ring", "near"])

    return rows.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, v array<double>, cell int, ring int, near array<double>")


def laid_out(rows: DataFrame, n: int, tables: Tables, block: int = BLOCK) -> tuple[DataFrame, DataFrame, Layout]:
    """rows(id, v), n of them, as (id, v, cell, near, block), written, with each block's bounds (block, cell, n, lo, hi) and the layout. Zero vectors are left out.

    The driver gets the sample (at most PIVOTS * SAMPLE vectors) and a count for each cell and ring. A ring with many rows, as of equal vectors, is cut by hashes of ids.
    """
    most = max(1, min(PIVOTS, -(-n // block)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(most * SAMPLE).select(F.col("v").cast("array<double>").alias("v")).toArrow()
    pivots = picked(unit(sample.column(0)), most)
    if not len(pivots):  # zero vectors all through
        pivots = np.ones((1, max(1, len(sample.column(0)[0]) if sample.num_rows else 1)))
    told = tables.keep(located(rows, pivots).where("cell >= 0"), "located")
    sizes = sorted((r.cell, r.ring, r.n) for r in told.groupBy("cell", "ring").agg(F.count("*").alias("n")).collect())
    where, number, held, last = {}, -1, block, None
    for cell, ring, k in sizes:
        parts = -(-k // block)
        if cell != last or parts > 1 or held + k > block:
            number, held = number + 1, 0
        where[cell, ring] = (number, parts)
        held, last = held + k, cell
        if parts > 1:
            number, held = number + parts - 1, block
    layout = Layout(pivots, where)
    names = rows.sparkSession.createDataFrame([(c, r, b, p) for (c, r), (b, p) in where.items()], "cell int, ring int, first int, parts int")
    dealt = told.join(F.broadcast(names), ["cell", "ring"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # a row for each cell and ring
    dealt = tables.keep(dealt.select("id", "v", "cell", "near", "block"), "dealt")
    ends = [f(F.get("near", F.lit(i))) for i in range(layout.bounds) for f in (F.min, F.max)]
    bounds = dealt.groupBy("block", "cell").agg(F.count("*").alias("n"), F.array(*ends[::2]).alias("lo"), F.array(*ends[1::2]).alias("hi"))
    return dealt, tables.keep(bounds, "bounds"), layout


def sized(rows: DataFrame, block: int) -> tuple[int, int, int]:
    """Rows, how many of them make a block (fewer than block, if the vectors are so long that it would take over 32 MB), and how many blocks make a pile."""
    r = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    d = max(1, r.d or 1)
    block = max(1, min(block, PILE_VALUES // d))
    return r.n, block, max(1, min(PILE, PILE_VALUES // (block * d)))


def gap(lo_a, hi_a, lo_b, hi_b):
    """The least angle that members of two intervals can have, by the pivot that tells most. Columns of arrays."""
    return F.array_max(F.zip_with(F.zip_with(lo_a, hi_b, lambda x, y: x - y), F.zip_with(lo_b, hi_a, lambda x, y: x - y), lambda x, y: F.greatest(x, y)))


def block_pairs(bounds: DataFrame, most: float) -> DataFrame:
    """(a, b) with a <= b: the pairs of blocks whose members may be within an angle of most. Cells are compared first (the driver gets bounds of at most PIVOTS of them), then the blocks of the cells that are left."""
    q = len(bounds.select("lo").first().lo)
    ends = [f(F.get(c, F.lit(i))) for i in range(q) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    cells = bounds.groupBy("cell").agg(F.array(*ends[::2]).alias("lo"), F.array(*ends[1::2]).alias("hi")).collect()
    lo, hi, no = np.array([r.lo for r in cells]), np.array([r.hi for r in cells]), [r.cell for r in cells]
    apart = np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None]).max(axis=2)
    near = [(no[i], no[j]) for i, j in zip(*np.nonzero(apart <= most + SLACK), strict=True)]
    cell_pairs = F.broadcast(bounds.sparkSession.createDataFrame(near, "cell int, other int"))  # at most PIVOTS squared
    one = bounds.select(F.col("block").alias("a"), "cell", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    two = bounds.select(F.col("block").alias("b"), F.col("cell").alias("other"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    both = one.join(cell_pairs, "cell").join(two, "other").where("a <= b")
    return both.where(gap(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")) <= most + SLACK).select("a", "b")


def similar_pairs(rows: DataFrame, threshold: float, tables: Tables, block: int | None = None, counter: dict | None = None, spanning: bool = False) -> DataFrame:
    """(a, b, similarity) with a < b and a cosine of at least threshold, which is over 0, of rows(id, v). spanning: in place of a task's pairs, links of rows to the least id that the pairs link them to. counter gets the pairs of blocks that there are and those that were compared, and how many rows were sent for that."""
    n, block, _ = sized(rows, block or BLOCK)
    kind = rows.schema["id"].dataType.simpleString()
    if n <= block:
        return within_one(rows, n, threshold, kind, spanning)
    dealt, bounds, _ = laid_out(rows, n, tables, block)
    pairs = tables.keep(block_pairs(bounds, math.acos(min(1.0, threshold))) if not bounds.isEmpty() else bounds.select(F.col("block").alias("a"), F.col("block").alias("b")), "pairs")
    if counter is not None:
        k = bounds.count()
        sent = pairs.select(F.explode(F.when(F.col("a") < F.col("b"), F.array("a", "b")).otherwise(F.array("a"))).alias("block")).join(bounds, "block")
        counter |= {"pairs": k * (k + 1) // 2, "compared": pairs.count(), "rows": n, "sent": sent.agg(F.sum("n").alias("n")).first().n}
    left = dealt.select(F.col("block").alias("a"), "id", "v").join(pairs, "a")
    # a block meets itself without being sent twice
    right = dealt.select(F.col("block").alias("b"), "id", "v").join(pairs.where("a < b"), "b").select("a", "b", F.col("id").alias("i"), F.col("v").alias("w")).select("a", "b", F.col("i").alias("id"), F.col("w").alias("v"))

    def compare(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        return matches(x, x if key[0].as_py() == key[1].as_py() else y, threshold, spanning)

    out = left.select("a", "b", "id", "v").groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(compare, f"p {kind}, q {kind}, similarity double")
    return out.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def linked(p: np.ndarray, q: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """A label for each row of p and then, unless they are the same, of q: equal for rows that similar pairs link, directly or through others."""
    shift = 0 if same else len(p)
    label = np.arange(shift + len(q))
    for at in range(0, len(p), 1024):
        near = p[at : at + 1024] @ q.T >= threshold - 1e-12
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            others, own = label[shift + np.flatnonzero(near[i])], label[at + i]
            if (others != own).any():
                into = np.arange(len(label))
                into[others] = own
                label = into[label]
    return label


def stars(x: pa.Table, y: pa.Table, threshold: float) -> pa.Table:
    """(p, q, similarity): each row that similar pairs of two blocks link to others, with the least id that it is linked to; similarity is null. Fewer than there are rows, where the pairs may be as many as their product."""
    ids = (x if x is y else pa.concat_tables([x.select(["id"]), y.select(["id"])])).column("id").combine_chunks()
    label = linked(unit(x.column("v")), unit(y.column("v")), threshold, x is y) if x.num_rows and y.num_rows else np.zeros(0, np.int64)
    order = np.asarray(pa.compute.sort_indices(ids), np.int64)[: len(label)]
    found, first, of = np.unique(label[order], return_index=True, return_inverse=True)
    least = order[first][of]
    own = least != order
    return pa.table([ids.take(pa.array(least[own])), ids.take(pa.array(order[own])), pa.nulls(int(own.sum()), pa.float64())], ["p", "q", "similarity"])


def matches(x: pa.Table, y: pa.Table, threshold: float, spanning: bool = False) -> pa.Table:
    """(p, q, similarity) of the pairs of two blocks; of a block with itself, each pair once. spanning: see stars()."""
    if spanning:
        return stars(x, y, threshold)
    same = x is y
    left, right, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if x.num_rows and y.num_rows:
        p, q = unit(x.column("v")), unit(y.column("v"))
        for at in range(0, len(p), 1024):
            s = p[at : at + 1024] @ q.T
            i, j = np.nonzero(s >= threshold - 1e-12)
            if same:
                i, j = i[i + at < j], j[i + at < j]
            left.append(i + at), right.append(j), values.append(s[i, j])
    take = lambda t, parts: t.column("id").combine_chunks().take(pa.array(np.concatenate(parts)))
    return pa.table([take(x, left), take(y, right), pa.array(np.concatenate(values))], ["p", "q", "similarity"])


def held_block(rows: DataFrame) -> pa.Table:
    """A table of at most BLOCK rows on the driver."""
    return rows.select("id", F.col("v").cast("array<double>").alias("v")).toArrow().combine_chunks()


def within_one(rows: DataFrame, n: int, threshold: float, kind: str, spanning: bool = False) -> DataFrame:
    """Similar pairs of at most one block's rows: every task compares its rows with the block, which is broadcast."""
    held = rows.sparkSession.sparkContext.broadcast(held_block(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from matches(pa.Table.from_batches([b]), held.value, threshold, spanning).combine_chunks().to_batches()

    out = rows.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"p {kind}, q {kind}, similarity double")
    out = out.where("p <> q") if spanning else out.where("p < q")  # a star has a pair one way only
    return out.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def best(q: pa.Table, i: pa.Table, k: int) -> pa.Table:
    """(query_id, item_id, similarity, rank): each query's k most similar of a block's items, which are in order of their ids; equal similarities in that order."""
    m = min(k, i.num_rows) if q.num_rows else 0
    rows, found, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if m:
        x, y = unit(q.column("v")), unit(i.column("v"))
        for at in range(0, len(x), 1024):
            s = np.round(x[at : at + 1024] @ y.T, 12) + 0.0
            if m < s.shape[1]:  # all that equal the m-th are looked at, so ties go by id
                bar = np.partition(s, -m, axis=1)[:, -m]
                s = np.where(s >= bar[:, None], s, -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")[:, :m]
            rows.append(np.repeat(np.arange(at, at + len(s)), m)), found.append(order.ravel()), values.append(np.take_along_axis(s, order, 1).ravel())
    ids = lambda t, parts: t.column("id").combine_chunks().take(pa.array(np.concatenate(parts)))
    rank = np.tile(np.arange(1, m + 1, dtype=np.int32), sum(map(len, rows)) // m) if m else np.zeros(0, np.int32)
    return pa.table([ids(q, rows), ids(i, found), pa.array(np.concatenate(values)), pa.array(rank)], ["query_id", "item_id", "similarity", "rank"])


def nearest(queries: DataFrame, items: DataFrame, k: int, tables: Tables, block: int | None = None, counter: dict | None = None) -> DataFrame:
    """(query_id, item_id, similarity, rank): the k most similar of items(id, v) for each of queries(id, v); equal similarities by item id.

    Items of one block are broadcast. Others are dealt into blocks; a query meets the blocks around it first and then those that can still hold one of its k best. counter gets the pairs of
    queries and blocks that there are and those that were compared, and how often a query was sent to a pile after its first ones. Zero vectors are similar to nothing: as queries they get the first items by id, as items they have a similarity of 0.
    """
    n, block, pile = sized(items, block or BLOCK)
    kinds = [x.schema["id"].dataType.simpleString() for x in (queries, items)]
    own = queries.select("id", F.col("v").cast("array<double>").alias("v"))
    if n <= block:
        table = held_block(items)
        held = items.sparkSession.sparkContext.broadcast(table.sort_by("id") if table.num_rows else table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from best(pa.Table.from_batches([b]), held.value, k).combine_chunks().to_batches()

        return own.mapInArrow(run, f"query_id {kinds[0]}, item_id {kinds[1]}, similarity double, rank int")
    dealt, bounds, layout = laid_out(items, n, tables, block)
    asked = tables.keep(located(own, layout.pivots), "queries")
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    found = items.sparkSession.createDataFrame([], f"query_id {kinds[0]}, item_id {kinds[1]}, similarity double")
    if not bounds.isEmpty():
        homes = F.broadcast(items.sparkSession.createDataFrame(home_blocks(bounds, layout, k), "cell int, ring int, block int"))  # some blocks for each cell and ring
        first = tables.keep(met(asked, in_piles(asked.join(homes, ["cell", "ring"]).select("id", "block"), pile), dealt, k, kinds, block, pile), "first")
        top = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        bar = top.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("similarity")).otherwise(-1.0).alias("bar"))
        open_blocks = wanted(asked.where("cell >= 0").join(bar.withColumnRenamed("query_id", "id"), "id", "left"), bounds)
        rest = tables.keep(in_piles(open_blocks.join(homes, ["cell", "ring", "block"], "left_anti").select("id", "block"), pile), "wanted")
        if counter is not None:
            counter |= {"pairs": asked.count() * bounds.count(), "compared": (rest.agg(F.sum(F.size("blocks")).alias("n")).first().n or 0) + asked.join(homes, ["cell", "ring"]).count(), "sent": rest.count()}
        found = first.unionByName(met(asked, rest, dealt, k, kinds, block, pile))
    least = items.select(F.col("id").alias("item_id"), (F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))) == 0).alias("is_zero"))
    nothing = F.lit(0.0).alias("similarity")
    for q, i in ((asked, least.where("is_zero")), (asked.where("cell < 0"), least)):
        found = found.unionByName(q.select(F.col("id").alias("query_id")).crossJoin(F.broadcast(i.select("item_id").orderBy("item_id").limit(k))).select("query_id", "item_id", nothing))  # k rows
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def home_blocks(bounds: DataFrame, layout: Layout, k: int) -> list[tuple[int, int, int]]:
    """(cell, ring, block): where a query begins: the block of its cell whose rings are nearest, and as many blocks of the nearest cells as make k items."""
    rows: dict[int, int] = {}
    sizes = {(r.cell): r.n for r in bounds.groupBy("cell").agg((F.sum("n") / F.count("*")).alias("n")).collect()}
    for (cell, _), (first, parts) in layout.blocks.items():
        for b in range(first, first + parts):
            rows[b] = cell
    by_cell: dict[int, list[tuple[int, int]]] = {}
    for (cell, ring), (first, _) in sorted(layout.blocks.items()):
        by_cell.setdefault(cell, []).append((ring, first))
    apart = angles(layout.pivots, layout.pivots)
    out = []
    for cell in range(len(layout.pivots)):
        others = [c for c in np.argsort(apart[cell], kind="stable").tolist() if c in by_cell]
        for ring in range(RINGS):
            chosen, n = [], 0.0
            for c in others:
                for _, b in sorted(by_cell[c], key=lambda x: abs(x[0] - ring)) if c == cell else by_cell[c]:
                    if n < k and b not in chosen:
                        chosen.append(b)
                        n += 0.5 * sizes[c]
            out += [(cell, ring, b) for b in chosen]
    return out


def wanted(asked: DataFrame, bounds: DataFrame) -> DataFrame:
    """(id, cell, ring, block): the blocks that may hold something at least as near as bar. asked(id, cell, ring, near, bar)."""
    q = len(bounds.select("lo").first().lo)
    ends = [f(F.get(c, F.lit(i))) for i in range(q) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    cells = bounds.groupBy("cell").agg(F.array(*ends[::2]).alias("lo"), F.array(*ends[1::2]).alias("hi")).collect()  # at most PIVOTS
    held = asked.sparkSession.sparkContext.broadcast((np.array([r.cell for r in cells], np.int32), np.array([r.lo for r in cells]), np.array([r.hi for r in cells])))
    kind = asked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, lo, hi = held.value
        for b in batches:
            near = np.asarray(b.column(3).flatten(), np.float64).reshape(b.num_rows, -1)
            reach = np.arccos(np.clip(np.asarray(b.column(4).fill_null(-1.0), np.float64), -1.0, 1.0)) + SLACK
            apart = np.maximum(lo[None] - near[:, None], near[:, None] - hi[None]).max(axis=2)
            i, j = np.nonzero(apart <= reach[:, None])
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(pa.array(i)) for x in range(4)), pa.array(reach[i]), pa.array(no[j])], ["id", "cell", "ring", "near", "reach", "other"])

    open_cells = asked.select("id", "cell", "ring", "near", "bar").mapInArrow(run, f"id {kind}, cell int, ring int, near array<double>, reach double, other int")
    two = bounds.select("block", F.col("cell").alias("other"), "lo", "hi")
    return open_cells.join(two, "other").where(gap(F.col("near"), F.col("near"), F.col("lo"), F.col("hi")) <= F.col("reach")).select("id", "cell", "ring", "block")


def in_piles(pairs: DataFrame, pile: int) -> DataFrame:
    """(id, pile, blocks) of pairs(id, block), which a query has once each: the blocks that it meets in a pile."""
    return pairs.groupBy("id", F.floor(F.col("block") / pile).cast("int").alias("pile")).agg(F.collect_list("block").alias("blocks"))


def met(queries: DataFrame, pairs: DataFrame, dealt: DataFrame, k: int, kinds: list[str], block: int, pile: int) -> DataFrame:
    """(query_id, item_id, similarity): of queries(id, v), the k best in all the blocks of a pile that they meet, by pairs(id, pile, blocks). A query is sent once to a pile, and gives k rows for it, however many
    blocks it meets there; a pile is sent once for so many queries as it may have rows."""
    sizes = pairs.groupBy("pile").agg(F.ceil(F.count("*") / (pile * block)).cast("int").alias("parts"))
    left = pairs.join(sizes, "pile").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(queries.select("id", "v"), "id").select("pile", "part", "id", "v", "blocks")
    right = dealt.select(F.floor(F.col("block") / pile).cast("int").alias("pile"), "block", "id", "v").join(sizes, "pile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select("pile", "part", F.col("block").alias("b"), F.col("id").alias("i"), F.col("v").alias("w")).select("pile", "part", F.col("i").alias("id"), F.col("w").alias("v"), F.col("b").alias("block"))

    def compare(q: pa.Table, i: pa.Table) -> pa.Table:
        return piled(q, i, k)

    return left.groupBy("pile", "part").cogroup(right.groupBy("pile", "part")).applyInArrow(compare, f"query_id {kinds[0]}, item_id {kinds[1]}, similarity double")


def piled(q: pa.Table, i: pa.Table, k: int) -> pa.Table:
    """(query_id, item_id, similarity): the k best of each query(id, v, blocks) among items(id, v, block) of its blocks; equal similarities by id."""
    i = i.sort_by("id") if i.num_rows else i
    value, place = np.full((q.num_rows, k), -np.inf), np.full((q.num_rows, k), i.num_rows)
    if q.num_rows and i.num_rows:
        x, y = unit(q.column("v")), unit(i.column("v"))
        block = i.column("block").to_numpy()
        lists = q.column("blocks").combine_chunks()
        wants, of = lists.flatten().to_numpy(), np.repeat(np.arange(q.num_rows), lists.value_lengths().to_numpy())
        for b in np.unique(block):
            mine, asks = np.flatnonzero(block == b), of[wants == b]
            own = y[mine].T
            for at in range(0, len(asks), 1024):
                some = asks[at : at + 1024]
                s = x[some] @ own
                low = value[some, -1]  # what a new one has to reach
                new = np.flatnonzero(np.isneginf(low))
                if len(new) and k <= len(mine):
                    low[new] = np.partition(s[new], -k, axis=1)[:, -k]
                r, c = np.nonzero(s >= low[:, None] - 1e-11)
                r, v, p = np.append(r, np.repeat(np.arange(len(some)), k)), np.append(np.round(s[r, c], 12) + 0.0, value[some]), np.append(mine[c], place[some])
                order = np.lexsort((p, -v, r))
                r = r[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                first = order[rank < k]  # k of each: those held before count
                value[some], place[some] = v[first].reshape(-1, k), p[first].reshape(-1, k)
    rows, at = np.nonzero(value > -np.inf)
    ids = lambda t, which: t.column("id").combine_chunks().take(pa.array(which))
    return pa.table([ids(q, rows), ids(i, place[rows, at]), pa.array(value[rows, at])], ["query_id", "item_id", "similarity"])
