"""Calibration of scores against labels, and its metrics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapengine.functions import numbers
from gapengine.functions.shared import Tables


def brier(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(p) - F.col(y), 2.0)).alias("brier"), F.count("*").alias("n"))


def reliability(rows: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """(bin, n, mean_p, mean_y) of the bins that hold rows; p = 1 is in the last."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def expected_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


@dataclass
class Calibrator:
    """kind: platt, isotonic, identity or constant. apply() is a column where it can be, a model otherwise."""

    kind: str
    coefficient: float = 1.0
    intercept: float = 0.0
    model: object = None

    def apply(self, df: DataFrame, score: str = "score", out: str = "p") -> DataFrame:
        if self.kind == "identity":
            return df.withColumn(out, numbers.clip(F.col(score)))
        if self.kind == "constant":
            return df.withColumn(out, F.lit(self.intercept))
        if self.kind == "platt":
            return df.withColumn(out, numbers.sigmoid(F.lit(self.coefficient) * F.col(score) + F.lit(self.intercept)))
        return self.model.setFeaturesCol("_features").setPredictionCol(out).transform(df.withColumn("_features", F.col(score))).drop("_features").withColumn(out, numbers.clip(F.col(out)))


def fit(rows: DataFrame, method: str = "auto", score: str = "score", y: str = "y") -> Calibrator:
    """auto: isotonic from 1,000 rows and three distinct scores on, else Platt. One class only gives a constant."""
    told = rows.agg(F.count("*").alias("n"), F.countDistinct(score).alias("distinct"), F.avg(F.col(y).cast("double")).alias("mean")).first()
    if method == "identity" or not told.n:
        return Calibrator("identity")
    if told.mean in (0.0, 1.0):
        return Calibrator("constant", intercept=float(told.mean))
    if method == "auto":
        method = "isotonic" if told.n >= 1000 and told.distinct >= 3 else "platt"
    if method == "isotonic":
        data = rows.select(F.col(score).alias("features"), F.col(y).cast("double").alias("label"))
        return Calibrator("isotonic", model=IsotonicRegression().fit(data))
    return platt(rows.withColumn("fold", F.lit(0)), 1, score, y)[-1]


#: Newton steps at most, and the step below which they end.
STEPS, STILL = 60, 1e-10


def platt(rows: DataFrame, k: int, score: str = "score", y: str = "y") -> list[Calibrator]:
    """Logistic calibrators of all k folds, each fitted on the rows of the others, and last one of all rows.

    A Newton step of all of them is one aggregation: each fold's rows give sums of gradients and curvatures under every model, and a model adds up those of the folds that aren't its own.
    Steps that don't raise the likelihood are halved; classes that a score separates have no best slope, so it stops growing after STEPS.
    """
    own = rows.select("fold", F.col(score).cast("double").alias("_s"), F.col(y).cast("double").alias("_y"))
    models = list(range(k)) + [None]

    def sums(at: list[tuple[float, float]]) -> list[np.ndarray]:
        parts = []
        for m, (a, b) in enumerate(at):
            z = F.lit(a) * F.col("_s") + F.lit(b)
            p = numbers.sigmoid(z)
            w, d = p * (1 - p), F.col("_y") - p
            loss = -(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - F.col("_y") * z)
            parts += [F.sum(x).alias(f"m{m}_{i}") for i, x in enumerate((d * F.col("_s"), d, w * F.col("_s") * F.col("_s"), w * F.col("_s"), w, loss))]
        found = own.groupBy("fold").agg(*parts).collect()  # a row for each fold
        return [sum((np.array([r[f"m{m}_{i}"] for i in range(6)]) for r in found if r.fold != f), np.zeros(6)) for m, f in enumerate(models)]

    at, step = [(0.0, 0.0)] * len(models), [(0.0, 0.0)] * len(models)
    told = sums(at)
    for _ in range(STEPS):
        for m, t in enumerate(told):
            curve = np.array([[t[2], t[3]], [t[3], t[4]]])
            step[m] = tuple(np.linalg.solve(curve, t[:2])) if abs(np.linalg.det(curve)) > 1e-14 else (0.0, 0.0)
        if max(abs(x) for s in step for x in s) < STILL:
            break
        ahead = [(a + da, b + db) for (a, b), (da, db) in zip(at, step, strict=True)]
        after = sums(ahead)
        for m in range(len(models)):
            if after[m][5] >= told[m][5] - 1e-12 * abs(told[m][5]):
                at[m], told[m] = ahead[m], after[m]
        lower = [m for m in range(len(models)) if at[m] != ahead[m]]
        for half in range(1, 12):
            if not lower:
                break
            ahead = [(a + da / 2**half, b + db / 2**half) if m in lower else (a, b) for m, ((a, b), (da, db)) in enumerate(zip(at, step, strict=True))]
            after = sums(ahead)
            for m in list(lower):
                if after[m][5] >= told[m][5]:
                    at[m], told[m] = ahead[m], after[m]
                    lower.remove(m)
    return [Calibrator("platt", a, b) for a, b in at]


def folds(rows: DataFrame, id_col: str, y: str = "y", most: int = 5, seed: str = "folds") -> tuple[DataFrame, int]:
    """Rows with a fold, dealt in turn within each class by a hash of the id; as many folds as the smaller class has rows, most at most (0: fewer than two).

    The hashes' upper bits make bins; rows are ranked within a (class, bin), and a running sum of the bins' sizes, one row each, makes the ranks go on from bin to bin.
    """
    told = rows.withColumn("_h", F.xxhash64(F.lit(seed), id_col)).withColumn("_bin", F.shiftright("_h", 56))
    sizes = told.groupBy(F.col(y).alias("_y"), "_bin").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_y").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = [r[1] for r in sizes.groupBy("_y").agg(F.sum("_n")).collect()]
    k = min(most, min(classes)) if len(classes) == 2 else 0
    offsets = sizes.withColumn("_before", before).select("_y", F.col("_bin").alias("_b"), "_before")
    order = W.partitionBy(y, "_bin").orderBy("_h", id_col)
    dealt = told.withColumn("_k", F.row_number().over(order) - 1).join(F.broadcast(offsets), F.col(y).eqNullSafe(F.col("_y")) & (F.col("_bin") == F.col("_b")))
    return dealt.withColumn("fold", ((F.col("_k") + F.col("_before")) % max(1, k)).cast("int")).drop("_h", "_bin", "_y", "_b", "_k", "_before"), k if k >= 2 else 0


def cross_fitted(rows: DataFrame, id_col: str, method: str = "platt", score: str = "score", y: str = "y", most: int = 5, tables: Tables | None = None) -> DataFrame:
    """Each row with p from a calibrator that was fitted on the other folds; without two folds, from one fitted on all. Platt's models are fitted together, one pass over the rows for each step of all."""
    dealt, k = folds(rows, id_col, y, most)
    if not k:
        return fit(rows, method, score, y).apply(rows, score).withColumn("fold", F.lit(None).cast("int"))
    dealt = (tables or Tables(rows.sparkSession, "folds")).keep(dealt)
    if method == "platt":
        models = platt(dealt, k, score, y)[:k]
        pick = lambda of: F.element_at(F.array(*[F.lit(float(of(m))) for m in models]), F.col("fold") + 1)
        return dealt.withColumn("p", numbers.sigmoid(pick(lambda m: m.coefficient) * F.col(score) + pick(lambda m: m.intercept)))
    out = None
    for i in range(k):
        part = fit(dealt.where(F.col("fold") != i), method, score, y).apply(dealt.where(F.col("fold") == i), score)
        out = part if out is None else out.unionByName(part)
    return out


def joined_labels(gaps: DataFrame, labels: DataFrame) -> DataFrame:
    """(gap_id, y): by gap id, else by need and item; of several labels the last by position; adjudicated = false is skipped, null accepted."""
    own = labels.where(F.coalesce("adjudicated", F.lit(True)))
    last = lambda *keys: own.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.max_by("outcome", "position").alias("y"))
    direct = last("gap_id").withColumnRenamed("y", "y1")
    pair = last("need_id", "roadmap_id").withColumnRenamed("y", "y2")
    out = gaps.join(direct, "gap_id", "left").join(pair, ["need_id", "roadmap_id"], "left")
    return out.select("gap_id", F.coalesce("y1", "y2").alias("y")).where("y is not null")
