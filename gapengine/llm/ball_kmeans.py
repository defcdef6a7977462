"""Ball k-means: exact k-means of integer vectors in which a member is only compared with the centroids that its ball can reach.

A cluster is a ball: its centroid and its radius, the distance of the member that lies farthest out. A centroid j whose distance from centroid i is over twice
the radius can't be nearer to any member of i, so only the others are i's neighbours. Sorted by distance they cut the ball into a stable core, whose members are
nearer to i than half the way to the first neighbour and stay, and annuli: a member between half the way to neighbour s and to neighbour s + 1 is compared exactly
with the first s neighbours. All tests are on integers (4 d(x, i)^2 < d(i, j)^2), so the result is that of comparing everything with everything.

Each round is one pass over a table in the shared folder that holds vectors and clusters: a task reads its rows, writes them with their new cluster, and adds up what it saw in
one row for each cluster. The driver gets sums of k clusters and never a vector beyond the k that the centroids start from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapengine.llm import common as c

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
ROWS = 8192
STATE = "vec_id long, v binary, cluster int, distance long"
SUMS = "cluster int, n long, sums array<long>, inertia decimal(38,0), radius2 long, compared long"


class Balls:
    """The centroids of a round, with each one's neighbours by distance, as far as its ball reaches."""

    def __init__(self, centroids: np.ndarray, reach: list[int | None]):
        """reach: for each cluster an upper bound of its members' distance from the centroid; None where nothing is known of them."""
        self.centroids = centroids.astype(np.int64)
        k = len(centroids)
        self.near, self.far2 = [], []
        for i in range(k):
            d2 = squared(self.centroids, self.centroids[i])
            order = np.lexsort((np.arange(k), d2))
            order = order[order != i]
            if reach[i] is not None:
                order = order[: np.searchsorted(d2[order], 4 * min(reach[i] ** 2, 1 << 60), side="right")]
            self.near.append(order)
            self.far2.append(d2[order])

    def assigned(self, vectors: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid (of equally near ones the first) and squared distance of vectors, given the cluster that they are in (-1: none yet); and the number of distances that were needed."""
        new, best, compared = cluster.copy(), np.empty(len(vectors), np.int64), 0
        fresh = np.flatnonzero(cluster < 0)
        for j in range(len(self.centroids) if len(fresh) else 0):
            d2 = squared(vectors[fresh], self.centroids[j])
            nearer = fresh if j == 0 else fresh[d2 < best[fresh]]
            best[nearer] = d2 if j == 0 else d2[d2 < best[fresh]]
            new[nearer] = j
            compared += len(fresh)
        for i in np.unique(cluster[cluster >= 0]).tolist():
            at = np.flatnonzero(cluster == i)
            own = squared(vectors[at], self.centroids[i])
            best[at] = own
            ring = np.searchsorted(self.far2[i], 4 * own, side="right")  # 0: the stable core
            compared += len(at)
            for s in range(int(ring.max()) if len(ring) else 0):
                out = at[ring > s]
                j = int(self.near[i][s])
                d2 = squared(vectors[out], self.centroids[j])
                nearer = (d2 < best[out]) | ((d2 == best[out]) & (j < new[out]))
                best[out[nearer]], new[out[nearer]] = d2[nearer], j
                compared += len(out)
        return new, best, compared


def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = vectors.astype(np.int64) - centre
    return np.einsum("ij,ij->i", apart, apart)


def kept(df: DataFrame, dims: int = DIMS, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors of exactly dims components, none null or non-finite. Other rows have no cluster."""
    x = F.col(column)
    whole = (F.size(x) == dims) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return df.where(F.coalesce(x.isNotNull() & whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: e.cast("double")).alias("v"))


def limit(dims: int) -> int:
    """Up to this size of components, four times a squared distance is exact in 64 bits: 2^26 for 64 dimensions."""
    return min(isqrt((1 << 60) // dims) // 2, (1 << 31) - 1)


def whole(flat: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of doubles as integers floor(scale * x)."""
    out = np.floor(flat.to_numpy(zero_copy_only=False).reshape(-1, dims) * float(scale))
    if len(out) and np.abs(out).max() > limit(dims):
        raise ValueError(f"a component of {np.abs(out).max():.4g} after scaling; up to {limit(dims)} are exact")
    return out.astype(np.int32)


def clustered(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED, trace: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector of df(vec_id, embedding).

    Null embeddings, other lengths and vectors with a null or non-finite component have no row. Repeated rows are vectors of their own; rows without vec_id too, but they come last
    when centroids are picked; of equal hashes, the least vector does. With fewer vectors than k there are as many clusters as vectors; no vectors give no rows. Equal distances go to
    the smaller number. Other columns are ignored. Sums are 64-bit: exact for up to 2^37 vectors. A component over limit(dims) after scaling is an error, not a wrong result.
    trace, if given, gets a dict for each pass: distances computed, and what comparing all with all would have needed.
    """
    spark, tmp = df.sparkSession, c.Scratch(df.sparkSession)
    vectors = kept(df, dims)
    first = vectors.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    empty = spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if not first:
        return empty
    centroids = np.stack([whole(pa.array(r.v, pa.float64()), dims, scale)[0] for r in first]).astype(np.int64)

    def passed(state: DataFrame, balls: Balls, name: str) -> tuple[DataFrame, list]:
        """One round: the rows with their new clusters, written, and the sums of each new cluster."""
        held = spark.sparkContext.broadcast(balls)  # k centroids and their neighbours, whatever the number of vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = held.value
            k = len(of.centroids)
            n, sums, inertia, radius, compared = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k, np.zeros(k, np.int64), 0
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    v = part.column(1)
                    if pa.types.is_binary(v.type) or pa.types.is_large_binary(v.type):
                        x = np.frombuffer(b"".join(v.to_pylist()), np.int32).reshape(-1, dims)
                        old = part.column(2).to_numpy(zero_copy_only=False)
                    else:
                        x = whole(v.flatten(), dims, scale)
                        old = np.full(len(x), -1, np.int32)
                    new, d2, more = of.assigned(x, old)
                    compared += more
                    for i in np.unique(new).tolist():
                        own = new == i
                        n[i] += own.sum()
                        sums[i] += x[own].sum(0, dtype=np.int64)
                        inertia[i] += sum(map(int, d2[own])) if d2[own].max() > 1 << 40 else int(d2[own].sum())
                        radius[i] = max(radius[i], d2[own].max())
                    out = [part.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(new, pa.int32()), pa.array(d2), *(pa.nulls(len(x), t) for t in (pa.int64(), pa.list_(pa.int64()), pa.decimal128(38, 0), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays(out, names)
            seen = [i for i in range(k) if n[i]]
            if seen:
                found = [pa.nulls(len(seen), pa.int64()), pa.nulls(len(seen), pa.binary()), pa.array(seen, pa.int32()), pa.nulls(len(seen), pa.int64()), pa.array(n[seen]), pa.array(sums[seen].tolist(), pa.list_(pa.int64()))]
                found += [pa.array([inertia[i] for i in seen], pa.decimal128(38, 0)), pa.array(radius[seen]), pa.array([compared if i == seen[0] else 0 for i in seen], pa.int64())]
                yield pa.RecordBatch.from_arrays(found, names)

        names = ["vec_id", "v", "cluster", "distance", "n", "sums", "inertia", "radius2", "compared"]
        rows = state.mapInArrow(c.lean(run), f"{STATE}, n long, sums array<long>, inertia decimal(38,0), radius2 long, compared long")
        done = tmp.written(rows.withColumn("part", F.when(F.col("n").isNull(), "vectors").otherwise("sums")), name, "part")
        whole_sums = done.where("part = 'sums'")
        each = whole_sums.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
        each = each.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("sums"))  # as many as there are dimensions
        return done.where("part = 'vectors'").select("vec_id", "v", "cluster", "distance"), (
            whole_sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.max("radius2").alias("radius2"), F.sum("compared").alias("compared")).join(each, "cluster").collect()
        )

    reach: list[int | None] = [None] * len(centroids)
    state = vectors
    for r in range(rounds + 1):
        state, sums = passed(state, Balls(centroids, reach), f"round{r}")
        if r:
            tmp.drop(f"round{r - 1}")
        if trace is not None:
            trace.append({"compared": sum(x.compared for x in sums), "all": sum(x.n for x in sums) * len(centroids)})
        if r == rounds:
            break
        moved = centroids.copy()
        for x in sums:
            moved[x.cluster] = [s // x.n for s in x.sums]
        apart = [int(squared(moved[i : i + 1], centroids[i])[0]) for i in range(len(centroids))]
        radius = {x.cluster: x.radius2 for x in sums}
        reach = [isqrt(radius.get(i, 0)) + 1 + isqrt(apart[i]) + 1 for i in range(len(centroids))]
        centroids = moved
    total = sum(int(x.inertia) for x in sums)
    told = [(x.cluster, int(x.inertia), hashlib.sha256(",".join(map(str, centroids[x.cluster].tolist())).encode()).hexdigest()) for x in sums]
    names = spark.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")  # k rows
