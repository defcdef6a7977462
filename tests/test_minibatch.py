"""Mini-batch k-means: its inertia against whole runs, groups against single runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gapengine.functions.shared import Tables
from gapengine.operators import clustering, minibatch


def blobs(seed, n, k=9, dims=12, spread=0.25):
    r = np.random.default_rng(seed)
    return r.normal(0, 1, (k, dims))[np.arange(n) % k] + r.normal(0, spread, (n, dims))


def frame(spark, x, groups=None):
    return spark.createDataFrame([(0 if groups is None else int(groups[i]), i, v.tolist()) for i, v in enumerate(x)], "g long, id long, v array<double>")


def inertia(u, labels):
    return sum(((u[labels == c] - u[labels == c].mean(0)) ** 2).sum() for c in set(labels.tolist()))


def whole_runs(u, k, seed, starts=5):
    """The least inertia of plain k-means from k-means++ seeds."""
    best = np.inf
    for s in range(starts):
        c = minibatch.thinned(u, np.ones(len(u)), k, np.random.default_rng([seed, s]))
        for _ in range(60):
            near = minibatch.squared(u, c).argmin(1)
            c = np.array([u[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        best = min(best, minibatch.squared(u, c).min(1).sum())
    return best


def test_inertia_is_that_of_whole_runs(spark):
    x = blobs(1, 1500)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = whole_runs(u, 9, 1)
    for batch in (300, 16_384):
        trace = {}
        got = {r.id: r.cluster for r in minibatch.k_means(frame(spark, x), "id", "v", lambda n: 9, batch=batch, tables=Tables(spark), trace=trace).collect()}
        labels = np.array([got[i] for i in range(len(u))])
        assert inertia(u, labels) <= 1.02 * want and len(trace) == 5 and min(trace.values()) <= 1.02 * want


def test_groups_are_clustered_by_themselves(spark):
    x = np.concatenate([blobs(2, 240, 4), blobs(3, 360, 6), blobs(4, 40, 3)])
    groups = np.repeat([7, 3, 11], [240, 360, 40])
    got = clustering.clustered_by(frame(spark, x, groups), "id", "v", "g", Tables(spark)).collect()
    assert sorted(int(r.id) for r in got) == list(range(640))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for g, n in ((7, 240), (3, 360)):
        own = [r for r in got if r.g == g]
        at = np.array([int(r.id) for r in own])
        assert len(own) == n and inertia(u[at], np.array([r.cluster for r in own])) <= 1.05 * whole_runs(u[at], clustering.k_for(n), g)
    alone = {r.id: r.cluster for r in clustering.clustered(frame(spark, x[600:]), "id", "v").collect()}  # under 100 rows: greedy, in id order
    assert {str(int(r.id) - 600): r.cluster for r in got if r.g == 11} == alone


def test_few_distinct_rows_and_none(spark):
    same = frame(spark, np.ones((30, 4)))
    assert {r.cluster for r in minibatch.k_means(same, "id", "v", lambda n: 8, tables=Tables(spark)).collect()} == {0}
    assert minibatch.k_means(same.limit(0), "id", "v", lambda n: 8).isEmpty() and clustering.clustered_by(same.limit(0), "id", "v", "g").isEmpty()


def test_rows_are_compared_a_slice_at_a_time():
    """However many rows a batch has, so many vectors are copied at once (before: all of a group); positions are those in the batch."""
    n = 2 * minibatch.SLICE + 5
    vectors = pa.array([[float(i), 1.0] for i in range(n)], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n) % 2), pa.array(np.arange(n)), vectors], ["grp", "key", "v"])
    parts = list(minibatch._groups(batch))
    assert max(len(x) for *_, x in parts) == minibatch.SLICE // 2
    assert sorted(np.concatenate([at for _, at, _ in parts]).tolist()) == list(range(n))
    assert all((at % 2 == g).all() and np.allclose(x[:, 0] / x[:, 1], at) for g, at, x in parts)
