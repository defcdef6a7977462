"""Comparing runs by hash trees."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gapengine.operators import audit


def rows(spark, data):
    return spark.createDataFrame(data, "k long, a string, b double")


def test_only_ranges_that_differ_are_compared(spark):
    r = random.Random(1)
    old = [(k, f"v{k % 7}" if k % 5 else None, float(k) if k % 3 else None) for k in range(3000)]
    new = [x for x in old if x[0] % 1000 != 7] + [(5000, "new", 1.0)]
    new = [(k, "other", b) if k in (11, 2222) else (k, a, b) for k, a, b in new]
    r.shuffle(new)
    a, b = audit.narrowed(rows(spark, old), rows(spark, new), ["k"])
    assert 5 <= a.count() <= 20 and 3 <= b.count() <= 20
    got = sorted(map(tuple, audit.reconciled(rows(spark, old), rows(spark, new), ["k"], ["a", "b"]).collect()))
    assert got == [(7, "left only", ""), (11, "differs", "a"), (1007, "left only", ""), (2007, "left only", ""), (2222, "differs", "a"), (5000, "right only", "")]
    tree = audit.digest_tree(rows(spark, old), ["k"])
    assert audit.differing_ranges(tree, audit.digest_tree(rows(spark, old).orderBy(F.desc("k")), ["k"])).isEmpty()
    told = {r.level: r for r in tree.groupBy("level").agg(F.sum("n").alias("n"), F.sum("d0").alias("d")).collect()}
    assert {x.n for x in told.values()} == {3000} and len({x.d for x in told.values()}) == 1 and set(told) == {0, audit.PARENT, audit.LEAF}


def test_repeated_rows_and_swapped_nulls_count(spark):
    one = [(1, "x", None), (1, "x", None), (2, None, 2.0)]
    two = [(1, "x", None), (2, None, 2.0), (2, None, 2.0)]
    got = sorted((r.side, r.k) for r in audit.changed(rows(spark, one), rows(spark, two)).collect())
    assert got == [("after", 2), ("before", 1)]
    a = spark.createDataFrame([(1, None, "y")], "k long, a string, b string")
    b = spark.createDataFrame([(1, "y", None)], "k long, a string, b string")
    assert audit.changed(a, b).count() == 2 and audit.changed(a, a).isEmpty()
    assert audit.changed(a.limit(0), b).count() == 1
