"""Whitening of vectors by shifted Cholesky QR.

The principal axes of a table of vectors come from the R factor of its centred
rows, not from their covariance, whose condition number is the square:

1. One pass counts the rows and sums every dimension in whole numbers, so the
   centred rows are exact up to one rounding.
2. Gram passes: each sums ``Q'Q`` of ``Q = C R1^-1 R2^-1 ...`` (triangular solves
   in the tasks, one small matrix from each), and the driver factors it by
   Cholesky.  The first is shifted, so that it succeeds for columns as dependent
   as double precision can tell; later ones are shifted only if they fail.  Passes
   end when Q is orthonormal to rounding.
3. ``R = ... R2 R1`` is composed, and its singular values and right vectors are
   the standard deviations and axes.
4. A pass measures the covariance of the whitened rows.

The rows are read again by each pass and never stored in between, so a lost
executor repeats its own tasks; only matrices of the dimension's size reach the
driver.  Steps 2 and 4 add up partial sums, whose order may change the last digits.

Defined cases: a row is left out if its vector is null, holds null, NaN or an
infinite entry, no entry, or an entry of ``LIMIT`` or more (whose long would
overflow); vectors of another length than the most frequent one (the longer on ties) are left
out too.  Null and repeated ids are rows like any other.  Components without
variance to double precision have no whitened form and are not returned, so
equal vectors only, one vector or none give an empty result.  A deviation that no
long can hold is null.  Only the two named columns are read.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm.common import ship
from cauce.llm.textnum import parts_of, release

#: Entries at or beyond this have no long.
LIMIT = 2.0 ** 52
#: Gram passes at most; rows of a block inside a task.
PASSES, ROWS = 6, 4096
SCALE, OFFSET = 1024, 100_000
EPS = float(np.finfo(float).eps)
_WIDE = 1 << 62


# --------------------------------------------------------------- rows as longs
def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, lengths, entries) of the list values without null, non-finite or overflowing entries."""
    values = column.flatten()
    flat = np.asarray(values.fill_null(np.nan).to_numpy(zero_copy_only=False), float)
    length = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    bad = np.append(0, np.cumsum(~(np.abs(flat) < LIMIT)))
    end = np.cumsum(length)
    fine = (bad[end] == bad[end - length]) & (length > 0) & ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    return np.flatnonzero(fine), length[fine], flat[np.repeat(fine, length)]


def longs(entries: np.ndarray) -> np.ndarray:
    return np.floor(entries * SCALE).astype(np.int64) + OFFSET


def _matrix(part: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, longs as a matrix) of a batch's usable vectors of ``dim`` entries."""
    rows, length, entries = usable(part.column(part.num_columns - 1))
    right = length == dim
    return rows[right], longs(entries[np.repeat(right, length)]).reshape(-1, dim)


class Centre:
    """Row count and sums of the fit list; rows become n * x - S without rounding."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.small = max([n * OFFSET, *map(abs, sums)]) < _WIDE

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as 64-bit integers where they suffice and Python's otherwise."""
        if self.small and (not x.size or int(np.abs(x).max()) * self.n < _WIDE):
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return self.exact(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 of each row; None if it exceeds a long."""
        m = self.exact(x)
        if not m.size:
            return [0] * len(m)
        if m.dtype == object or int(np.abs(m).max()) ** 2 * m.shape[1] >= _WIDE:
            found = (m.astype(object) ** 2).sum(axis=1)
            return [int(v) if v < 1 << 63 else None for v in found]
        return (m * m).sum(axis=1).tolist()


def sums(vectors: DataFrame) -> Centre | None:
    """Count and sums of the fit list, from one pass; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for part in (p for b in batches for p in parts_of(b, ROWS)):
            _, length, entries = usable(part.column(0))
            for dim in np.unique(length):
                x = longs(entries[np.repeat(length == dim, length)]).reshape(-1, dim)
                if x.size and int(np.abs(x).max()) * len(x) >= _WIDE:
                    x = x.astype(object)
                n, s = total.get(int(dim), (0, np.zeros(dim, object)))
                total[int(dim)] = n + len(x), s + x.sum(axis=0).astype(object)
        rows = [(dim, at, v) for dim, (n, s) in total.items() for at, v in enumerate([n, *s], -1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([decimal.Decimal(int(r[2])) for r in rows], pa.decimal128(38, 0))], names=["len", "at", "v"])
        release()

    each = vectors.mapInArrow(run, "len int, at int, v decimal(38,0)").groupBy("len", "at").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    best = each.where("at = -1").orderBy(F.desc("v"), F.desc("len")).first()
    if best is None:
        return None
    found = {r["at"]: int(r["v"]) for r in each.where((F.col("len") == best["len"]) & (F.col("at") >= 0)).collect()}  # the dimension's size
    return Centre(int(best["v"]), [found[i] for i in range(best["len"])])


# -------------------------------------------------------------------- QR passes
def solve_rows(c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """c R^-1 for an upper triangular R, column by column."""
    out = np.empty_like(c)
    for j in range(c.shape[1]):
        out[:, j] = (c[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(vectors: DataFrame, centre: Centre, project: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """Sum over all rows of p'p / n, p being the projected centred rows (``dim`` columns)."""
    width = len(centre.sums)
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for part in (p for b in batches for p in parts_of(b, ROWS)):
            q = project(centre.rows(_matrix(part, width)[1]))
            total += q.T @ q / centre.n
        i, j = upper
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[upper])],
                                         names=["i", "j", "v"])
        release()

    cells = vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # dim^2 / 2 rows
    out = np.zeros((dim, dim))
    for r in cells:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _root(g: np.ndarray) -> np.ndarray:
    """F with F'F = g for a symmetric g without negative eigenvalues beyond rounding."""
    value, vector = np.linalg.eigh(g)
    return np.sqrt(np.maximum(value, 0))[:, None] * vector.T


def r_factor(vectors: DataFrame, centre: Centre) -> np.ndarray:
    """R with R'R the covariance, by repeated Cholesky QR; dimensions without variance get zero columns."""
    width = len(centre.sums)
    factors: list[np.ndarray] = []
    first = gram(vectors, centre, lambda c: c, width)
    live = np.flatnonzero(np.diag(first) > 0)
    g, r, d = first[np.ix_(live, live)], np.eye(len(live)), len(live)
    if not d:
        return np.zeros((0, width))
    for turn in range(PASSES):
        shift = 11 * (ROWS * d + d * (d + 1)) * EPS * np.linalg.norm(g, 2)
        try:
            upper = np.linalg.cholesky(g + (shift if not turn else 0) * np.eye(d)).T
        except np.linalg.LinAlgError:
            try:
                upper = np.linalg.cholesky(g + shift * np.eye(d)).T
            except np.linalg.LinAlgError:
                break
        factors.append(upper)
        r = upper @ r
        done = list(factors)

        def project(c: np.ndarray, done: list[np.ndarray] = done) -> np.ndarray:
            c = c[:, live]
            for factor in done:
                c = solve_rows(c, factor)
            return c

        g = gram(vectors, centre, project, d)
        if np.abs(g - np.eye(d)).max() <= 64 * d * EPS:
            break
    whole = np.zeros((d, width))
    whole[:, live] = _root(g) @ r  # what the last pass left besides the identity
    return whole


def axes(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(standard deviations, axes as columns) of the first k components with variance; the largest entry of an axis is positive."""
    if not len(r):
        return np.zeros(0), np.zeros((r.shape[1], 0))
    _, sigma, right = np.linalg.svd(r)
    sigma = sigma[sigma > 16 * r.shape[1] * EPS * sigma[0]][:k]
    right = right[:len(sigma)]
    sign = np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)])
    return sigma, (right * sign[:, None]).T


# ---------------------------------------------------------------------- result
def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 8) -> DataFrame:
    """One row per usable row of ``rows`` and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    ship(rows.sparkSession)
    named = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    schema = T.StructType([named.schema["vec_id"], *T.StructType.fromDDL(
        "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])
    vectors = named.select("v")
    centre = sums(vectors)
    if centre is None:
        return rows.sparkSession.createDataFrame([], schema)
    r = r_factor(vectors, centre)
    sigma, axis = axes(r, components)
    k, width = len(sigma), len(centre.sums)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    explained = sigma ** 2 / float((r * r).sum())
    map_to = axis / sigma

    def project(c: np.ndarray) -> np.ndarray:
        return c @ map_to

    error = float(np.abs(gram(vectors, centre, project, k) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts_of(b, ROWS)):
            at, x = _matrix(part, width)
            n = len(at)
            white = project(centre.rows(x))
            deviation = pa.array(centre.deviation(x), pa.int64())
            each = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                 pa.array(np.full(n * k, centre.n)), deviation.take(each), pa.array(white.ravel()),
                 pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))], names=schema.names)
        release()

    return named.mapInArrow(run, schema)
