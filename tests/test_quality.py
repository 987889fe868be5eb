"""Exact quantiles, modes and profiling against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cauce.operators import quality as Q


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False), st.floats(allow_nan=False),
                          st.sampled_from([float("inf"), -float("inf"), 5e-324, -5e-324, 2.5e-323, -0.0, 1.7e308, -1.7e308])),
                min_size=1, max_size=300))
def test_exact_quantiles_match_numpy(spark, vals):
    old = Q.HISTOGRAM_BINS
    Q.HISTOGRAM_BINS = 20  # force several selection passes
    try:
        df = spark.createDataFrame([(v,) for v in vals], "x double")
        got = Q.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0])
    finally:
        Q.HISTOGRAM_BINS = old
    s = sorted(vals)
    for p, v in got.items():
        h = (len(s) - 1) * p
        a, b = int(np.floor(h)), int(np.ceil(h))
        want = s[a] if s[a] == s[b] else s[a] * (1 - (h - a)) + s[b] * (h - a)
        assert v == want or (np.isnan(v) and np.isnan(want))


def test_selection_sends_only_bins_to_the_driver(spark):
    """A third of the rows are one value, some are infinite: counts arrive, never the column."""
    rows = [(7.0,)] * 3000 + [(float("inf"),)] * 500 + [(float(i) / 7,) for i in range(5500)]
    df = spark.createDataFrame(rows, "x double")
    s = sorted(r[0] for r in rows)
    got = Q.order_statistics(Q.to_long(df, {"x": "x"}), {"x": [0, 1234, 4000, 8499, 8500, 8999]})
    assert {r: got[("x", r)] for r in (0, 1234, 4000, 8499, 8500, 8999)} == {r: s[r] for r in (0, 1234, 4000, 8499, 8500, 8999)}


def test_integer_medians_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (None, 3.0), (3, None), (4, 5.0)], "i int, x double")
    out = Q.impute_all(df)
    assert dict(out.dtypes)["i"] == "double"
    assert sorted(r.i for r in out.collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]
    assert sorted(r.x for r in out.collect()) == [1.0, 3.0, 3.0, 3.0, 5.0]
    assert {r.columna: r.nulos for r in Q.null_counts(df).collect()} == {"i": 1, "x": 2}


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (2,), (None,), (None,), (None,)], "x int")
    assert Q.mode_table(df).collect()[0].moda == "1"


def test_impute_and_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (5.0, "b")], "x double, y string")
    out = Q.impute_all(df).collect()
    assert [r.x for r in out] == [1.0, 3.0, 3.0, 5.0]
    assert [r.y for r in out] == ["a", "b", "b", "b"]
    nulls = {r.columna: r.nulos for r in Q.null_counts(df).collect()}
    assert nulls == {"x": 1, "y": 1}
    assert Q.completeness(df).first()[0] == 75.0
    d = {r.columna: r for r in Q.describe(df).collect()}
    assert d["x"]["count"] == 3 and d["x"]["mediana"] == 3.0 and d["x"]["std"] == 2.0


def test_describe_approx_close_to_exact(spark):
    import random
    rnd = random.Random(11)
    df = spark.createDataFrame([(rnd.gauss(50, 10),) for _ in range(5000)], "x double")
    exact = {r.columna: r for r in Q.describe(df).collect()}["x"]
    approx = {r.columna: r for r in Q.describe(df, method="approx").collect()}["x"]
    for k in ("p25", "p50", "p75"):
        assert abs(exact[k] - approx[k]) < 0.5  # within the sketch's rank error
    assert exact["mean"] == approx["mean"] and exact["std"] == approx["std"]


def test_nan_is_missing_in_every_statistic(spark):
    from cauce.operators import metrics as M
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 4.0, 0), (nan, 9.0, 1), (4.0, nan, 1), (nan, 8.0, None)], "x double, y double, k int")
    row = {r.columna: r for r in Q.describe(df, ["x"]).collect()}["x"]
    assert (row["count"], row["max"], row["mean"], row["p50"]) == (3.0, 4.0, round(7 / 3, 3), 2.0)
    assert {r.columna: r.moda for r in Q.mode_table(df).collect()}["x"] == "1.0"
    assert Q.quality_report(df, "k").first().total_nulos == 4
    assert {(r.col_a, r.col_b): r["corr"] for r in M.correlation(df, ["x", "y"]).collect()}["x", "y"] == 1.0
    assert sum(r.n for r in M.histogram(df, ["x"], 3).collect()) == 3
    box = {(r.columna, r.clase): r for r in M.boxplot(df, ["x", "y"], "k").collect()}
    assert box["x", "1"].mediana == 4.0 and box["y", "1"].mediana == 9.0 and sum(r.atipicos for r in box.values()) == 0
