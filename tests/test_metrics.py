"""AUC, ROC and class metrics against brute force."""

import itertools
import random

from cauce.operators import metrics as M


def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = 0.0
    for p, n in itertools.product(pos, neg):
        tot += 1.0 if p > n else 0.5 if p == n else 0.0
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_matches_pairwise(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), rnd.choice([0.1, 0.2, 0.2, 0.5, 0.9, rnd.random()])) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = M.auc_gini(df, decimals=12).first()
    assert abs(got.roc_auc - round(_brute_auc(rows), 12)) < 1e-9
    assert abs(got.gini - (2 * got.roc_auc - 1)) < 1e-9


def test_class_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, pred int")
    m = M.class_metrics(df).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)
    assert m.accuracy == round(2 / 3, 4)


def test_roc_points_end_at_one(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    pts = {r.umbral: (r.fpr, r.tpr) for r in M.roc_points(df).collect()}
    assert pts[0.1] == (1.0, 1.0) and pts[0.9] == (0.0, 0.5)
    assert pts[None] == (0.0, 0.0)  # the curve's origin


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2)], "label int, score double")
    assert tuple(M.auc_gini(df).first()) == (None, None)
    assert {(r.fpr, r.tpr) for r in M.roc_points(df).collect()} == {(0.0, 0.0), (None, 0.5), (None, 1.0)}


def test_threshold_table_equals_single_metrics(spark):
    rows = [(i * 7 % 3 == 0, (i * 37 % 11) / 10) for i in range(200)]
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "label int, score double")
    got = {r.modelo: r for r in M.threshold_table(df, {"a": 0.3, "b": 0.7}).collect()}
    auc = M.auc_gini(df).first()
    for name, t in (("a", 0.3), ("b", 0.7)):
        want = M.class_metrics(df.withColumn("pred", (df.score >= t).cast("int"))).first()
        assert tuple(got[name])[2:6] == tuple(want) and (got[name].roc_auc, got[name].gini) == tuple(auc)


def test_correlation_of_one_column(spark):
    assert [tuple(r) for r in M.correlation(spark.createDataFrame([(1.0,), (2.0,)], "x double"), ["x"]).collect()] == [("x", "x", 1.0)]


def test_row_numbers_with_hot_and_null_leading_values(spark):
    from cauce.operators import ordering as O
    rows = [(None, i) for i in range(500)] + [(1.0, i) for i in range(400)] + [(float("nan"), 1), (2.0, None), (-0.5, 3)]
    df = spark.createDataFrame(rows, "k double, i int")
    got = [(r["id"], r["k"], r["i"]) for r in O.row_numbers(df, ["k", "i"], n_buckets=16).orderBy("id").collect()]
    want = [(r["k"], r["i"]) for r in df.orderBy("k", "i").collect()]
    assert [str(x[1:]) for x in got] == [str(x) for x in want] and [x[0] for x in got] == list(range(1, len(rows) + 1))
    sizes = [r["count"] for r in O.with_buckets(df, ["k", "i"], 16).groupBy("_bkt").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < len(rows) / 8  # neither the nulls nor the hot value share one bucket
