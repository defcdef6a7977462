"""Calibrators of all folds at once against one fit after another; thresholds by counts against rows."""

from __future__ import annotations

import random
from itertools import product

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gapengine.operators import calibration, verdict


def rows_of(spark, seed, n):
    r = random.Random(seed)
    rows = [(k, s := r.random(), float(r.random() < 0.2 + 0.6 * s)) for k in range(n)]
    return spark.createDataFrame(rows, "id long, score double, y double")


@pytest.mark.parametrize("seed", [1, 2])
def test_cross_fit_equals_single_fits(spark, seed):
    rows = rows_of(spark, seed, 200)
    got = calibration.cross_fitted(rows, "id").cache()
    for fold in range(5):
        train = got.where(F.col("fold") != fold).select(array_to_vector(F.array("score")).alias("features"), F.col("y").alias("label"))
        m = LogisticRegression(regParam=0.0, maxIter=300, tol=1e-12, standardization=False).fit(train)
        for r in got.where(F.col("fold") == fold).collect():
            want = 1 / (1 + 2.718281828459045 ** -(float(m.coefficients[0]) * r.score + float(m.intercept)))
            assert abs(r.p - want) < 1e-6


def test_separated_classes_end(spark):
    rows = spark.createDataFrame([(k, k / 10, float(k >= 5)) for k in range(10)], "id long, score double, y double")
    c = calibration.fit(rows, "platt")
    p = [r.p for r in c.apply(rows).orderBy("id").collect()]
    assert p == sorted(p) and p[4] < 0.05 < 0.95 < p[5]


def test_thresholds_by_counts_equal_rows(spark):
    r = random.Random(4)
    lows, highs = [0.3, 0.4, 0.5], [0.45, 0.6]
    values = [0.3, 0.4, 0.45, 0.5, 0.6, 0.375, 0.525] + [r.random() for _ in range(60)]
    kinds = ["IGNORED", "UNDER-PRIORITIZED", "MISUNDERSTOOD", "COVERED"]
    rows = [(k, s, r.random() < 0.4, r.random() < 0.2, r.choice(kinds)) for k, s in enumerate(values)]

    def told(s, low, mis, a, b):
        return "MISUNDERSTOOD" if mis else "IGNORED" if s < a else "UNDER-PRIORITIZED" if low else "COVERED" if s >= b or s >= (a + b) / 2 else "IGNORED"

    want = {(a, b): round(sum(told(s, low, mis, a, b) == e for _, s, low, mis, e in rows) / len(rows), 6) for a, b in product(lows, highs) if a < b}
    got = verdict.tuned(spark.createDataFrame(rows, "position long, similarity double, low_priority boolean, is_misunderstood boolean, expected string"), lows, highs).collect()
    assert {(x.low, x.high): x.accuracy for x in got} == want
