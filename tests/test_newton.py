"""Newton's logistic regression and compiled models against numpy and Spark ML."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cauce.operators import churn as C
from cauce.operators import newton as N

COLS = ["a", "b", "c"]


def data(n=600, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 2, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.0, -0.3, 2.0] + 0.4)))).astype(float)
    return x, y, rng.choice([0.5, 1.0, 3.0], n)


def frame(spark, x, y, w):
    return spark.createDataFrame([(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, w)], "a double, b double, c double, label double, peso double")


def numpy_newton(x, y, w, reg):
    x1 = np.column_stack([x, np.ones(len(x))])
    pen = np.array([reg] * x.shape[1] + [0.0])
    beta = np.zeros(x1.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x1 @ beta))
        g = x1.T @ (w * (p - y)) / w.sum() + pen * beta
        h = (x1 * (w * p * (1 - p))[:, None]).T @ x1 / w.sum() + np.diag(pen)
        beta -= np.linalg.solve(h, g)
    return beta


@pytest.mark.parametrize("reg", [0.0, 0.01])
def test_coefficients_equal_numpy(spark, reg):
    x, y, w = data()
    coefficients, intercept = N.fit(frame(spark, x, y, w), COLS, "label", "peso", reg)
    np.testing.assert_allclose([*coefficients, intercept], numpy_newton(x, y, w, reg), rtol=1e-6, atol=1e-8)


def test_stage_equals_the_library_and_is_saved(spark, tmp_path):
    x, y, w = data()
    df = frame(spark, x, y, w)
    mine = Pipeline(stages=[C.assemble(COLS), N.NewtonLogisticRegression(weightCol="peso", regParam=0.02)]).fit(df)
    library = LogisticRegression(weightCol="peso", regParam=0.02, standardization=False, maxIter=500, tol=1e-12)
    theirs = Pipeline(stages=[C.assemble(COLS), library]).fit(df).stages[-1]
    np.testing.assert_allclose(mine.stages[-1].coefficients.toArray(), theirs.coefficients.toArray(), rtol=1e-5)
    mine.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert back.stages[-1].intercept == mine.stages[-1].intercept
    assert back.transform(df).filter("prediction = label").count() > 400


def test_one_class_missing_values_and_dependent_features(spark):
    x, y, w = data(80)
    coefficients, intercept = N.fit(frame(spark, x, y * 0 + 1, w), COLS)
    assert not coefficients.any() and intercept == math.inf
    with pytest.raises(ValueError, match="missing"):
        N.fit(frame(spark, np.where(x == x[3], np.nan, x), y, w), COLS)
    with pytest.raises(ValueError, match="no rows"):
        N.fit(frame(spark, x, y, w).limit(0), COLS)
    twice, _ = N.fit(frame(spark, np.column_stack([x[:, :2], x[:, 0]]), y, w), COLS)
    assert twice[0] == pytest.approx(twice[2])  # the weight is shared


def test_compiled_models_equal_transform(spark):
    x, y, w = data(500, 9)
    df = frame(spark, x, y, w)
    gaps = df.withColumn("a", F.when(F.rand(3) < 0.1, F.lit(None)).otherwise(F.col("a")))
    stages = [N.NewtonLogisticRegression(weightCol="peso", regParam=0.01), DecisionTreeClassifier(maxDepth=5, weightCol="peso")]
    for stage in stages:
        model = Pipeline(stages=[C.assemble(COLS), stage]).fit(df)
        compiled = C.compiled_probability(model, COLS)
        for rows in (df, gaps):
            both = model.transform(rows).select(vector_to_array("probability")[1].alias("p"), compiled.alias("q")).collect()
            np.testing.assert_allclose([r.q for r in both], [r.p for r in both], rtol=1e-12)
    forest = Pipeline(stages=[C.assemble(COLS), RandomForestClassifier(numTrees=3, maxDepth=3, seed=1)]).fit(df)
    assert C.compiled_probability(forest, COLS) is None
