"""Logistic regression by Newton's method on sufficient statistics.

Each step is one aggregate over the training rows: the weighted cross-products
of the features (k x k numbers), the gradient (k) and the loss, all native sums
with map-side partial aggregation.  The driver solves a k x k system.  Newton
converges in some six to ten steps whatever the number of rows, where a
quasi-Newton method runs a job for every one of its many iterations.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 50
TOLERANCE = 1e-10


def margin(cols: list[Column], coefficients, intercept: float) -> Column:
    """intercept + the sum of coefficient times column."""
    total = F.lit(0.0)
    for x, b in zip(cols, coefficients, strict=True):
        total = total + x * F.lit(float(b))
    return total + F.lit(float(intercept))


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def step_statistics(rows: DataFrame, cols: list[str], coefficients, label: str = "label", weight: str | None = None) -> DataFrame:
    """One row with the sums of a Newton step at ``coefficients`` (one per column, then the intercept).

    ``h_i_j`` (i <= j): sum of w p (1-p) x_i x_j; ``g_i``: sum of w (p - y) x_i; ``loss``: sum of w times the
    logistic loss; ``w``: sum of weights; ``pos``: weight of label 1.  The intercept's x is 1.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    xs = [F.col(c).cast("double") for c in cols]
    z = margin(xs, coefficients[:-1], coefficients[-1])
    known = rows.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], F.lit(1.0).alias(f"x{len(cols)}"),
                        F.col(label).cast("double").alias("y"), w.alias("w"), z.alias("z"))
    known = known.withColumn("p", logistic(F.col("z")))
    curved = known.withColumn("r", F.col("w") * (F.col("p") - F.col("y"))).withColumn("c", F.col("w") * F.col("p") * (1 - F.col("p")))
    n = len(cols) + 1
    sums = [F.sum(F.col("c") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h_{i}_{j}") for i in range(n) for j in range(i, n)]
    sums += [F.sum(F.col("r") * F.col(f"x{i}")).alias(f"g_{i}") for i in range(n)]
    # log(1 + e^z) - y z, without overflow
    loss = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z")
    return curved.agg(*sums, F.sum(F.col("w") * loss).alias("loss"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("pos"))


def fit(rows: DataFrame, cols: list[str], label: str = "label", weight: str | None = None, reg: float = 0.0) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) that minimise the weighted mean loss + reg / 2 · |coefficients|².

    A step that does not lower the objective is halved.  With one class only the coefficients are 0 and the
    intercept is infinite; a NaN or null among the features is an error.
    """
    n = len(cols) + 1
    penalty = np.full(n, reg)
    penalty[-1] = 0.0

    def at(beta):
        r = step_statistics(rows, cols, beta, label, weight).first()
        if not r["w"]:
            raise ValueError("no rows to fit")
        h = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                h[i, j] = h[j, i] = math.nan if r[f"h_{i}_{j}"] is None else r[f"h_{i}_{j}"]
        g = np.array([math.nan if r[f"g_{i}"] is None else r[f"g_{i}"] for i in range(n)])
        if not np.isfinite(h).all() or not np.isfinite(g).all():
            raise ValueError("features hold missing values")
        value = r["loss"] / r["w"] + (penalty * beta ** 2).sum() / 2
        return value, g / r["w"] + penalty * beta, h / r["w"] + np.diag(penalty), r["pos"] / r["w"]

    beta = np.zeros(n)
    value, g, h, positive = at(beta)
    if positive in (0.0, 1.0):
        return np.zeros(n - 1), math.inf if positive else -math.inf
    beta[-1] = math.log(positive / (1 - positive))
    value, g, h, _ = at(beta)
    for _ in range(STEPS):
        move = np.linalg.lstsq(h, g, rcond=None)[0]  # dependent features: the shortest step
        if np.abs(move).max() <= TOLERANCE * max(1.0, np.abs(beta).max()) or g @ move <= TOLERANCE ** 2:
            break
        scale = 1.0
        new = at(beta - move)
        while new[0] > value + 1e-14 and scale > 1e-6:
            scale /= 2
            new = at(beta - scale * move)
        if new[0] > value + 1e-14:
            break
        beta = beta - scale * move
        value, g, h, _ = new
    return beta[:-1], float(beta[-1])


class NewtonLogisticRegression(Estimator):
    """A pipeline stage that fits by :func:`fit` and yields Spark's own logistic regression model."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", weightCol: str | None = None, regParam: float = 0.0):
        super().__init__()
        self.features, self.label, self.weight, self.reg = featuresCol, labelCol, weightCol, regParam

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        size = len(dataset.select(self.features).first()[0])
        values = vector_to_array(F.col(self.features))
        cols = [f"_x{i}" for i in range(size)]
        rows = dataset.select(*[values[i].alias(c) for i, c in enumerate(cols)], F.col(self.label).alias("_y"),
                              (F.col(self.weight) if self.weight else F.lit(1.0)).alias("_w"))
        coefficients, intercept = fit(rows, cols, "_y", "_w", self.reg)
        sc = dataset.sparkSession.sparkContext
        java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
            self.uid, _py2java(sc, Vectors.dense(coefficients)), float(intercept))
        model = LogisticRegressionModel(java)
        return model._set(featuresCol=self.features, labelCol=self.label)
