"""Exact cosine joins by pivots: against one matrix, and how little is compared and sent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from gapengine.functions.shared import Tables
from gapengine.operators import pivots, similarity


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], "id long, v array<double>")


def cosines(x, y):
    n = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    return np.round(n(x) @ n(y).T, 12) + 0.0


def clusters(seed, n, spread=0.1, dims=16, k=12):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (k, dims))
    return centres[np.arange(n) % k] + r.normal(0, spread, (n, dims))


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_pairs_equal_one_matrix_and_skip_blocks(spark, threshold):
    x = np.concatenate([clusters(1, 500), np.zeros((2, 16)), np.repeat(clusters(2, 1), 90, 0)])  # a group of copies that is larger than a block
    counter = {}
    got = {(r.a, r.b): round(r.similarity, 9) for r in pivots.similar_pairs(table(spark, x), threshold, Tables(spark), 40, counter).collect()}
    s = cosines(x, x)
    want = {(i, j): round(s[i, j], 9) for i, j in zip(*np.nonzero(np.triu(s >= threshold - 1e-12, 1)), strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)
    assert counter["compared"] < (0.35 if threshold > 0.5 else 1) * counter["pairs"]


def test_separate_clusters_send_hardly_more_than_their_rows(spark):
    counter = {}
    pivots.similar_pairs(table(spark, clusters(3, 960, 0.02)), 0.95, Tables(spark), 80, counter).count()
    assert counter["sent"] < 2 * counter["rows"] and counter["compared"] < 0.25 * counter["pairs"]


@pytest.mark.parametrize("block", [32, 4096])
def test_nearest_equal_one_matrix(spark, block):
    items = np.concatenate([clusters(4, 400), np.zeros((7, 16)), np.repeat(clusters(5, 1), 60, 0), -clusters(4, 12)])
    queries = np.concatenate([clusters(4, 90), np.zeros((2, 16)), clusters(6, 20, 0.5), np.repeat(clusters(4, 1), 70, 0)])
    counter = {}
    got = sorted((r.query_id, r["rank"], r.item_id, round(r.similarity, 9)) for r in pivots.nearest(table(spark, queries), table(spark, items), 6, Tables(spark), block, counter).collect())
    s = cosines(queries, items)
    want = [(q, k + 1, int(i), round(s[q, i], 9)) for q in range(len(queries)) for k, i in enumerate(np.lexsort((np.arange(len(items)), -s[q]))[:6])]
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want, strict=True))
    assert block > 400 or counter["compared"] < 0.6 * counter["pairs"]


def test_few_items_none_and_only_zeros(spark):
    x = clusters(7, 5)
    for block in (2, 4096):
        assert len(pivots.nearest(table(spark, x), table(spark, x), 9, Tables(spark), block).collect()) == 25
        assert pivots.nearest(table(spark, x[:0]), table(spark, x), 3, Tables(spark), block).isEmpty()
        assert pivots.nearest(table(spark, x), table(spark, x[:0]), 3, Tables(spark), block).isEmpty()
        zeros = table(spark, np.zeros((6, 4)))
        assert [r.item_id for r in pivots.nearest(zeros, zeros, 2, Tables(spark), block).orderBy("query_id", "rank").collect()] == [0, 1] * 6
        assert pivots.similar_pairs(zeros, 0.5, Tables(spark), block).isEmpty()


def test_groups_of_copies_are_linked_by_their_first(spark):
    x = np.concatenate([clusters(8, 60, 0.01), np.repeat(clusters(9, 1), 50, 0), np.zeros((3, 16)), np.random.default_rng(9).normal(0, 1, (10, 16))])
    rows = table(spark, x)
    assert sorted(map(tuple, similarity.redundant_groups(rows, 0.95, "id", "v").collect())) == sorted(map(tuple, similarity.components(similarity.redundant_pairs(rows, 0.95, "id", "v")).collect()))
    with pytest.raises(ValueError):
        similarity.redundant_pairs(rows, 0.0, "id", "v")


def test_a_query_is_sent_to_piles_of_blocks(spark):
    """Vectors that lie all over the place: a query meets nearly every block, but it is sent once for sixteen of them."""
    x = np.random.default_rng(10).normal(0, 1, (640, 16))
    counter = {}
    got = sorted((r.query_id, r["rank"], r.item_id) for r in pivots.nearest(table(spark, x), table(spark, x), 5, Tables(spark), 16, counter).collect())
    s = cosines(x, x)
    assert got == [(q, k + 1, int(i)) for q in range(len(x)) for k, i in enumerate(np.lexsort((np.arange(len(x)), -s[q]))[:5])]
    assert counter["compared"] > 20 * len(x) and counter["sent"] * 5 < counter["compared"]


def test_stars_link_what_all_pairs_link():
    """Fewer links than rows (before: a row for each of the similar pairs), and the same components."""
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (12, 8))[np.arange(300) % 12] + r.normal(0, 0.4, (300, 8))
    for a, b in ((x, x), (x[:140], x[140:])):
        p, q = (pa.table({"id": np.arange(len(y)) + k, "v": pa.array(y.tolist(), pa.list_(pa.float64()))}) for y, k in ((a, 0), (b, 0 if b is x else 140)))
        q = p if b is x else q
        roots, sizes = [], []
        for spanning in (False, True):
            root, pairs = list(range(300)), pivots.matches(p, q, 0.9, spanning)
            for i, j in zip(pairs["p"].to_pylist(), pairs["q"].to_pylist(), strict=True):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if y == hi else y for y in root]
            roots.append(root), sizes.append(pairs.num_rows)
        assert roots[0] == roots[1] and sizes[1] == 300 - len(set(roots[0])) < sizes[0]
