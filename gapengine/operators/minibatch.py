"""Mini-batch k-means with several starts, for one table or for many groups of rows at once.

All starts of all groups move together: a step reads one bucket of the table, assigns its rows to the nearest centre of each start of their group, and adds up sums and counts; the driver
holds nothing but centres. Seeds are drawn in rounds, each row with a chance in proportion to its squared distance from those drawn before (k-means||), weighed by the rows that are
nearest to them and thinned to k. The start with the least inertia over all rows wins, in each group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.functions.shared import Tables
from gapengine.operators.pivots import unit

#: Starts, rows of a batch, steps at most, rounds in which seeds are drawn, and whole passes at the end.
STARTS, BATCH, STEPS, ROUNDS, LAST = 5, 16_384, 30, 2, 2
#: Rows of a group that one task is dealt, values of centres that one round of groups may have (64 MB), and rows that are compared with centres at a time.
ROWS, VALUES, SLICE = 100_000, 1 << 23, 2048


@dataclass
class Centres:
    """By (group, start): centres as rows, and the rows that each has taken in so far."""

    at: dict[tuple[int, int], np.ndarray]
    n: dict[tuple[int, int], np.ndarray]

    def of(self, group: int) -> list[tuple[int, np.ndarray]]:
        return [(s, c) for (g, s), c in self.at.items() if g == group]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x from rows of c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0.0)


def _groups(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, positions, vectors) of a batch (grp, key, v), a slice of rows at a time."""
    whole = b.column(0).to_numpy(zero_copy_only=False)
    for first in range(0, b.num_rows, SLICE):
        grp, x = whole[first : first + SLICE], unit(b.column(2).slice(first, SLICE))
        for g in np.unique(grp).tolist():
            at = np.flatnonzero(grp == g)
            yield int(g), first + at, x[at]


def sums(rows: DataFrame, centres: Centres) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]]:
    """(group, start) to the counts, sums and inertia of what is nearest to each centre."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[int, int, int], int] = {}
        total: dict[tuple[int, int, int], np.ndarray] = {}
        cost: dict[tuple[int, int, int], float] = {}
        for b in batches:
            for g, _, x in _groups(b):
                for s, c in held.value.of(g):
                    d = squared(x, c)
                    near = d.argmin(1)
                    least = d[np.arange(len(x)), near]
                    for k in np.unique(near).tolist():
                        own, key = near == k, (g, s, k)
                        n[key] = n.get(key, 0) + int(own.sum())
                        total[key] = total.get(key, 0.0) + x[own].sum(0)
                        cost[key] = cost.get(key, 0.0) + float(least[own].sum())
        keys = sorted(n)
        if keys:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in range(3)), pa.array([n[k] for k in keys], pa.int64()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64())), pa.array([cost[k] for k in keys], pa.float64())], ["grp", "start", "k", "n", "total", "cost"])

    found = rows.select("grp", "key", "v").mapInArrow(run, "grp long, start long, k long, n long, total array<double>, cost double").toArrow()  # a row for each centre and task
    out: dict[tuple[int, int], list] = {}
    for g, s, k, n, total, cost in zip(*(found.column(i).to_pylist() for i in range(6)), strict=True):
        c = centres.at[g, s]
        own = out.setdefault((g, s), [np.zeros(len(c)), np.zeros(c.shape), 0.0])
        own[0][k] += n
        own[1][k] += total
        own[2] += cost
    return {k: tuple(v) for k, v in out.items()}


def seeded(rows: DataFrame, k: dict[int, int], starts: int, seed: int) -> Centres:
    """k centres for each start of each group, by k-means||."""
    first = [F.min_by("v", F.xxhash64(F.lit(seed), F.lit(s), "key")).alias(f"v{s}") for s in range(starts)]
    drawn = {(r.grp, s): unit(pa.array([r[f"v{s}"]], pa.list_(pa.float64()))) for r in rows.groupBy("grp").agg(*first).collect() for s in range(starts)}
    for turn in range(ROUNDS):
        held = rows.sparkSession.sparkContext.broadcast((Centres(drawn, {}), k))

        def run(batches: Iterator[pa.RecordBatch], turn=turn, held=held) -> Iterator[pa.RecordBatch]:
            centres, most = held.value
            best: dict[tuple[int, int], list[tuple[float, list[float]]]] = {}
            for b in batches:
                keys = b.column(1).to_numpy(zero_copy_only=False)
                for g, at, x in _groups(b):
                    for s, c in centres.of(g):
                        d = squared(x, c).min(1)
                        u = np.array([np.random.default_rng([seed & 0xFFFFFFFF, turn, s, int(h) & 0xFFFFFFFF, int(h) >> 32 & 0xFFFFFFFF]).random() for h in keys[at]]) if len(at) else np.zeros(0)
                        with np.errstate(divide="ignore"):
                            wait = np.where(d > 1e-12, -np.log(u) / d, np.inf)  # the first of exponential clocks that run as fast as the distances are large
                        own = best.setdefault((g, s), [])
                        own += [(float(wait[i]), x[i].tolist()) for i in np.argsort(wait, kind="stable")[: most[g]].tolist() if np.isfinite(wait[i])]
                        own.sort(key=lambda t: t[0])
                        del own[most[g] :]
            for (g, s), own in best.items():
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.int64()), pa.array([s] * len(own), pa.int64()), pa.array([w for w, _ in own]), pa.array([v for _, v in own], pa.list_(pa.float64()))], ["grp", "start", "wait", "v"])

        table = rows.sparkSession.createDataFrame(sorted(k.items()), "grp long, most int")
        found = rows.select("grp", "key", "v").mapInArrow(run, "grp long, start long, wait double, v array<double>")
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("grp", "start").orderBy("wait"))).join(F.broadcast(table), "grp").where("rank <= most")
        for r in ranked.select("grp", "start", "v").collect():  # k rows for each start
            drawn[r.grp, r.start] = np.concatenate([drawn[r.grp, r.start], [r.v]])
    weights = sums(rows, Centres(drawn, {}))
    at = {}
    for (g, s), c in drawn.items():
        r = np.random.default_rng([seed & 0xFFFFFFFF, g & 0xFFFFFFFF, s])
        at[g, s] = thinned(c, weights[g, s][0], k[g], r)
    return Centres(at, {key: np.zeros(len(c)) for key, c in at.items()})


def thinned(points: np.ndarray, weights: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    """k of some weighted points by k-means++, then moved a few times to the weighted means of what is nearest."""
    if len(points) <= k:
        return points
    chosen = [int(r.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < k:
        d = weights * squared(points, points[chosen]).min(1)
        if d.sum() <= 0:
            break
        chosen.append(int(r.choice(len(points), p=d / d.sum())))
    c = points[chosen].copy()
    for _ in range(10):
        near = squared(points, c).argmin(1)
        for j in range(len(c)):
            w = weights * (near == j)
            if w.sum() > 0:
                c[j] = (w[:, None] * points).sum(0) / w.sum()
    return c


def k_means(rows: DataFrame, id_col: str, vec: str, k_of, seed: int = 42, group: Column | None = None, starts: int = STARTS, batch: int = BATCH, tables: Tables | None = None, trace: dict | None = None) -> DataFrame:
    """(grp, id, cluster) of unit vectors; grp is null without a group, a column of integers. k_of: rows of a group to its number of clusters.

    Groups' rows are dealt over tasks by hashes of ids. Fewer distinct rows than clusters give fewer clusters. trace gets the inertia of each (group, start).
    """
    spark = rows.sparkSession
    tables = tables or Tables(spark, "kmeans")
    own = rows.select((F.lit(0) if group is None else group).cast("long").alias("grp"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.col(vec).cast("array<double>").alias("v"))
    sizes = {r.grp: r.n for r in own.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # a row for each group
    if not sizes:
        return spark.createDataFrame([], f"grp long, id {own.schema['id'].dataType.simpleString()}, cluster int")
    buckets = max(1, max(sizes.values()) // batch)
    parts = max(1, -(-max(sizes.values()) // ROWS), -(-spark.sparkContext.defaultParallelism // len(sizes)))
    told = own.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    told = told.repartition(max(1, min(len(sizes) * parts, 4 * spark.sparkContext.defaultParallelism)), "grp", "part").drop("part")
    table = tables.keep(told, "rows", *(["bucket"] if buckets > 1 else []))
    dims = table.agg(F.max(F.size("v")).alias("d")).first().d or 1
    at_once = max(1, VALUES // (starts * dims * max(map(k_of, sizes.values()))))
    order = sorted(sizes)
    out = None
    for i in range(0, len(order), at_once):
        some = order[i : i + at_once]
        part = table if len(some) == len(order) else table.where(F.col("grp").isin(some))
        centres = seeded(part, {g: min(k_of(sizes[g]), sizes[g]) for g in some}, starts, seed)
        moved(part, centres, buckets)
        cost = {}
        for turn in range(LAST + 1):
            for key, (n, total, inertia) in sums(part, centres).items():
                cost[key] = inertia
                if turn < LAST:
                    centres.at[key] = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres.at[key])
        best = {g: centres.at[g, min(range(starts), key=lambda s: (cost[g, s], s))] for g in some}
        if trace is not None:
            trace |= cost
        found = labelled(part, best)
        out = found if out is None else out.unionByName(found)
    return out if group is not None else out.withColumn("grp", F.lit(None).cast("long"))


def moved(rows: DataFrame, centres: Centres, buckets: int) -> None:
    """Mini-batch steps; with one bucket each step is a whole pass and centres become means. Ends when no start's centres move any more."""
    open_keys = set(centres.at)
    for step in range(STEPS):
        part = rows if buckets == 1 else rows.where(F.col("bucket") == step % buckets)
        still = Centres({k: centres.at[k] for k in open_keys}, {})
        for key, (n, total, _) in sums(part, still).items():
            old, seen = centres.at[key], centres.n[key]
            if buckets == 1:
                new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old)
            else:
                seen += n
                new = old + (total - n[:, None] * old) / np.maximum(seen, 1)[:, None]
            centres.at[key] = new
            if np.abs(new - old).max() < 1e-4:
                open_keys.discard(key)
        if not open_keys:
            return


def labelled(rows: DataFrame, best: dict[int, np.ndarray]) -> DataFrame:
    """(grp, id, cluster): the nearest centre of each row's group."""
    held = rows.sparkSession.sparkContext.broadcast(best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.int32)
            for g, at, x in _groups(b):
                out[at] = squared(x, held.value[g]).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(out)], ["grp", "id", "cluster"])

    return rows.select("grp", "key", "v", "id").mapInArrow(run, f"grp long, id {rows.schema['id'].dataType.simpleString()}, cluster int")
