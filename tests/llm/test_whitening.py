import numpy as np
import pytest

from cauce.llm import whitening as W


def brute(rows):
    """Longs, deviations, whitened rows and shares, from the covariance of the kept rows in plain numpy."""
    x = np.floor(np.array(rows, float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1], vector[:, ::-1]
    return x, ((n * x - s) ** 2).sum(axis=1), c @ vector / np.sqrt(np.maximum(value, 1e-300)), value / value.sum(), value


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, "x") for i, v in rows], "vec_id bigint, embedding array<float>, whitened double, component string")


def table(df):
    return {(r.vec_id, r.component): r for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 6])
def test_equals_eigenvectors(spark, parts):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(400, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32) @ rng.normal(size=(12, 12)).astype(np.float32)
    bad = [(1000, None), (1001, [float("nan")] + [0.0] * 11), (1002, [None] + [0.0] * 11), (1003, [float("inf")] + [0.0] * 11),
           (1004, [1e30] + [0.0] * 11), (1005, [1.0]), (1006, [])]
    got = table(W.whiten(frame(spark, [(i, v.tolist()) for i, v in enumerate(data.astype(np.float32))] + bad).repartition(parts)))
    assert {k[0] for k in got} == set(range(400)) and {k[1] for k in got} == set(range(1, 9))
    _, deviation, white, share, _ = brute(data.astype(np.float32))
    for comp in range(8):
        mine = np.array([got[i, comp + 1].whitened for i in range(400)])
        sign = np.sign(mine @ white[:, comp])
        np.testing.assert_allclose(mine, sign * white[:, comp], rtol=1e-9, atol=1e-9)
        assert got[0, comp + 1].explained == pytest.approx(share[comp], rel=1e-10)
    assert [got[i, 1].deviation for i in range(400)] == deviation.tolist()
    assert {r.n for r in got.values()} == {400}
    assert {r.identity_error for r in got.values()} == {got[0, 1].identity_error} and got[0, 1].identity_error < 1e-12


def test_columns_that_depend_on_each_other(spark):
    """Repeated, constant and nearly repeated dimensions: the covariance's condition number is beyond doubles."""
    rng = np.random.default_rng(5)
    base = np.floor(rng.normal(size=(300, 3)) * 1024 * 50)
    x = np.column_stack([base, base[:, 0], np.full(300, 7.0), base[:, 1] + (np.arange(300) % 2)]) / 1024
    got = table(W.whiten(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")))
    assert max(k[1] for k in got) == 4  # three directions and the small difference
    white = np.array([[got[i, c].whitened for c in range(1, 5)] for i in range(300)])
    assert np.abs(white.T @ white / 300 - np.eye(4)).max() < 1e-7
    assert got[0, 1].identity_error < 1e-7
    assert sum(got[0, c].explained for c in range(1, 5)) == pytest.approx(1)


def test_shifted_factor_of_a_matrix_that_plain_cholesky_refuses():
    rng = np.random.default_rng(1)
    u, v = np.linalg.qr(rng.normal(size=(2000, 8)))[0], np.linalg.qr(rng.normal(size=(8, 8)))[0]
    sigma = 10.0 ** -np.arange(0, 16, 2)
    c = (u * sigma) @ v.T
    g, r, d = c.T @ c, np.eye(8), 8
    with pytest.raises(np.linalg.LinAlgError):
        np.linalg.cholesky(g - 1e-17 * np.eye(8))
    q = c
    for turn in range(W.PASSES):
        shift = 11 * (2000 * d + d * (d + 1)) * W.EPS * np.linalg.norm(g, 2) if turn == 0 else 0
        upper = np.linalg.cholesky(g + shift * np.eye(d)).T
        q, r = W.solve_rows(q, upper), upper @ r
        g = q.T @ q
        if np.abs(g - np.eye(d)).max() < 64 * d * W.EPS:
            break
    np.testing.assert_allclose(np.linalg.svd(r)[1][:6], sigma[:6], rtol=1e-4)


def test_wide_numbers_and_empty_inputs(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert W.whiten(spark.createDataFrame([], schema)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # no variance
    big = [(1, [2.0 ** 51, 0.0]), (2, [-(2.0 ** 51), 1.0]), (2, [-(2.0 ** 51), 1.0]), (None, [3.0, 4.0])]
    rows = W.whiten(spark.createDataFrame(big, schema)).collect()
    assert len(rows) == 4 and {r.n for r in rows} == {4}  # the other direction is below double precision
    by_id = {r.vec_id: r.deviation for r in rows}
    assert by_id[1] is None  # beyond a long
    few = spark.createDataFrame([(1, [1.0, 2.0, 5.0]), (2, [2.0, 2.5, 1.0])], schema)
    assert {(r.vec_id, r.component) for r in W.whiten(few).collect()} == {(1, 1), (2, 1)}  # two rows span one direction
