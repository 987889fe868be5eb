"""Global order without a single-partition window.

``with_buckets`` maps a row's order tuple to one of ~N ordered buckets whose
bounds come from a sample in proportion to the buckets (the driver sees some
``SAMPLES_PER_BUCKET`` tuples of each, whatever the size of the data).
Bounds cover the whole order tuple, nulls being the lowest values, so a
leading value (or null) shared by a third of the rows is still split by the
following columns.

The bounds are data, not plan: one sorted array in a one-row table, which the
plan reads as a scalar subquery (computed once per query, whatever the number
of tasks), and a row finds its bucket by a binary search of that array, log2 N
comparisons.  So the plan is the same for 64 buckets and for 65,536.  The bucket
is a pure function of the values, so it does not depend on physical partitioning
or AQE coalescing and is stable under recompute.
Cumulative quantities then need only per-bucket totals (N rows) plus a
window *partitioned by bucket* — each bucket a balanced slice of the order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES_PER_BUCKET = 20


def _order_key(values: tuple) -> tuple:
    """Python's order of a tuple as Spark orders it: nulls first, NaN last."""
    return tuple((0, 0) if v is None else (2, 0) if isinstance(v, float) and math.isnan(v) else (1, v) for v in values)


def bucket_bounds(df: DataFrame, cols, n_buckets: int, samples: int = SAMPLES_PER_BUCKET) -> list:
    """Up to n_buckets-1 increasing bounds of the ``cols`` tuple from a seeded
    sample of ~``samples`` tuples per bucket."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    keyed = df.select(*cols)
    n = keyed.count()
    if n == 0 or n_buckets <= 1:
        return []
    share = min(1.0, samples * n_buckets / n)
    drawn = keyed.sample(False, share, seed=7) if share < 1.0 else keyed
    values = sorted((tuple(r) for r in drawn.collect()), key=_order_key)
    bounds: list = []
    for i in range(1, n_buckets):
        if values:
            v = values[min(len(values) - 1, len(values) * i // n_buckets)]
            if not bounds or _order_key(v) > _order_key(bounds[-1]):
                bounds.append(v)
    return bounds


def bounds_column(df: DataFrame, cols, bounds: list) -> Column:
    """The sorted bounds as one array value, from a one-row table: a scalar subquery of every plan that uses it."""
    fields = [T.StructField(f"_{i}", df.schema[c].dataType) for i, c in enumerate(cols)]
    one_row = T.StructType([T.StructField("bounds", T.ArrayType(T.StructType(fields), False), False)])
    return df.sparkSession.createDataFrame([(bounds,)], one_row).scalar()


def bounds_below(bounds: Column, n: int, cols) -> Column:
    """How many of the n sorted bounds lie strictly below the row's ``cols`` tuple (tuples compare
    lexicographically, nulls first).  A binary search: ``at`` bounds are known to be below, and each step
    tries to add the next smaller power of two."""
    key = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])

    def step(at: Column, width: Column) -> Column:
        there = at + width
        return F.when((there <= n) & (F.get(bounds, there - 1) < key), there).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def default_buckets(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism * 2)


def with_buckets(df: DataFrame, cols, n_buckets: int | None = None) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    bounds = bucket_bounds(df, cols, n_buckets or default_buckets(df))
    if not bounds:
        return df.withColumn("_bkt", F.lit(0))
    # a subquery may not stand inside a higher-order function, so the bounds pass through a column
    attached = df.withColumn("_bounds", bounds_column(df, cols, bounds))
    return attached.withColumn("_bkt", bounds_below(F.col("_bounds"), len(bounds), cols)).drop("_bounds")


def cumulative_below(df: DataFrame, order, cols, n_buckets: int | None = None) -> DataFrame:
    """For each row, sums of ``cols`` over all rows earlier in ``order``
    (a total order): bucket offsets (tiny) + running sums per bucket."""
    order = [order] if isinstance(order, str) else list(order)
    b = with_buckets(df, order, n_buckets)
    totals = b.groupBy("_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w_all = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bkt", *[F.coalesce(F.sum(f"_t_{c}").over(w_all), F.lit(0)).alias(f"_o_{c}")
                                      for c in cols])
    w_in = Window.partitionBy("_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = b.select("*", *[F.coalesce(F.sum(c).over(w_in), F.lit(0)).alias(f"_l_{c}") for c in cols])
    j = local.join(F.broadcast(offsets), "_bkt")  # one row per bucket (bounded)
    return j.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"{c}_below") for c in cols])


def row_numbers(df: DataFrame, order, col: str = "id", start: int = 1, n_buckets: int | None = None
                ) -> DataFrame:
    """1..N following ``order`` (a total order)."""
    order = [order] if isinstance(order, str) else list(order)
    b = with_buckets(df, order, n_buckets)
    counts = b.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_bkt", F.coalesce(F.sum("_n").over(
        Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = b.withColumn("_rn", F.row_number().over(Window.partitionBy("_bkt").orderBy(*order)))
    j = local.join(F.broadcast(offsets), "_bkt")  # one row per bucket (bounded)
    return j.select((F.col("_off") + F.col("_rn") + (start - 1)).alias(col), *df.columns)
