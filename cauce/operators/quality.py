"""Data-quality profiling and imputation.

Designed so no operator gathers a whole column into one task:

* counts, nulls, means, deviations, min/max: one fused ``agg`` (partial
  aggregation per task, one tiny row merged at the end);
* mode: ``groupBy(value).count()`` (hot values collapse map-side) then a
  partial ``min_by`` over the distinct values;
* exact quantiles: distributed selection — histogram passes narrow a value
  interval around each requested rank until it is one value; only bin counts
  reach the driver.  ``method="approx"`` uses the
  Greenwald-Khanna sketch (``percentile_approx``) instead.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)

HISTOGRAM_BINS = 1000
# narrower bins are not told apart by division: the interval then holds few doubles
MIN_WIDTH = 1e-320


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


# ---------------------------------------------------------------------------
# exact quantiles by distributed selection
# ---------------------------------------------------------------------------

def series_stats(base: DataFrame) -> dict:
    """Per series: rows below, inside and above the finite values, and their extremes."""
    inf = F.lit(float("inf"))
    finite = (F.col("v") > -inf) & (F.col("v") < inf)
    return {r["sid"]: r for r in base.groupBy("sid").agg(
        F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"),
        F.count_if(F.col("v") == -inf).alias("low"), F.count_if(finite).alias("n"),
        F.count(F.lit(1)).alias("total")).collect()}


def order_statistics(long: DataFrame, wanted: dict, stats: dict | None = None) -> dict:
    """Exact order statistics for many series at once.

    ``long`` has columns ``sid`` (series id) and ``v`` (double); ``wanted``
    maps sid → list of 0-based ranks.  Returns {(sid, rank): value}.

    Infinite values are only counted.  Each open (sid, rank) keeps an interval
    [lo, hi] of finite values and the count below lo.  Every pass is ONE scan:
    rows are matched to the open intervals of their series (a literal array
    filtered per row), binned, and reduced by ``groupBy(key, bin)`` to (count,
    min, max) — at most HISTOGRAM_BINS rows per open rank reach the driver,
    never the values of a column.  The interval becomes the exact [min, max]
    of the bin holding the rank (bins are monotone in the value, and the
    extremes fall into different bins), until it is a single value.  Where the
    interval is too narrow to be divided, only some thousand doubles fit into
    it, and the bins are the values themselves.
    """
    base = long.filter(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.col("v") + F.lit(0.0))
    st = stats if stats is not None else series_stats(base)
    result: dict = {}
    state: dict = {}
    for sid, ranks in wanted.items():
        if sid in st:
            low, n = st[sid]["low"], st[sid]["n"]
            for r in set(ranks):
                if r < low:
                    result[(sid, r)] = -math.inf
                elif r >= low + n:
                    result[(sid, r)] = math.inf
                else:
                    state[(sid, r)] = (st[sid]["lo"], st[sid]["hi"], low)
    while state:
        for key, (lo, hi, _) in list(state.items()):
            if lo == hi:
                result[key] = lo
                del state[key]
        if not state:
            break
        keys = list(state)
        # sid → that series' open intervals: each row only tests its own; halves cannot overflow
        by_sid: dict = {}
        for i, (sid, r) in enumerate(keys):
            lo, hi, _ = state[(sid, r)]
            by_sid.setdefault(sid, []).append(F.struct(
                F.lit(i).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                F.lit((hi / 2 - lo / 2) / HISTOGRAM_BINS).alias("width")))
        specs = F.element_at(F.create_map(*[x for sid, arr in by_sid.items()
                                            for x in (F.lit(sid), F.array(*arr))]), F.col("sid"))
        hits = F.filter(specs, lambda s: (F.col("v") >= s["lo"]) & (F.col("v") <= s["hi"]))
        ex = base.select("v", F.explode(hits).alias("s"))
        half = F.col("v") / 2 - F.col("s.lo") / 2
        b = F.when(F.col("s.width") >= F.lit(MIN_WIDTH),
                   F.least(F.floor(half / F.col("s.width")), F.lit(HISTOGRAM_BINS - 1)).cast("double")
                   ).otherwise(F.col("v"))
        hist = (ex.select(F.col("s.k").alias("k"), b.alias("b"), "v").groupBy("k", "b")
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        by_key: dict = {}
        for row in hist:
            by_key.setdefault(row["k"], []).append((row["lo"], row["hi"], row["n"]))
        for i, key in enumerate(keys):
            acc = state[key][2]
            for lo, hi, n in sorted(by_key.get(i, [])):
                if acc + n > key[1]:
                    state[key] = (lo, hi, acc)
                    break
                acc += n
    return result


def _between(lo: float, hi: float, share: float) -> float:
    """(1 - share)·lo + share·hi, the sum rounded once."""
    if math.isinf(lo) or math.isinf(hi):
        return lo * (1 - share) + hi * share
    return math.fma(1 - share, lo, hi * share)


def quantiles_long(long: DataFrame, probs) -> dict:
    """{(sid, p): value} with linear interpolation, (1-d)·lo + d·hi (DuckDB quantile_cont).

    The (sid, v) frame is persisted (memory and disk) for the few selection
    passes, so an expensive source is computed once; lost blocks are
    recomputed from lineage.
    """
    base = long.filter(F.col("v").isNotNull() & ~F.isnan("v")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = series_stats(base)
        counts = {sid: r["total"] for sid, r in stats.items()}
        need, wanted = {}, {}
        for sid, n in counts.items():
            for p in probs:
                h = (n - 1) * p
                a, b = math.floor(h), math.ceil(h)
                need[(sid, p)] = (a, b, h - a)
                wanted.setdefault(sid, set()).update({a, b})
        found = order_statistics(base, wanted, stats)
    finally:
        base.unpersist()
    out = {}
    for (sid, p), (a, b, frac) in need.items():
        lo, hi = found[(sid, a)], found[(sid, b)]
        out[(sid, p)] = lo if a == b or lo == hi else _between(lo, hi, frac)
    return out


def to_long(df: DataFrame, series: dict) -> DataFrame:
    """Unpivot ``{sid: column expression}`` into (sid, v double) rows."""
    arr = F.array(*[F.struct(F.lit(sid).alias("sid"), F.col(c).cast("double").alias("v"))
                    if isinstance(c, str) else
                    F.struct(F.lit(sid).alias("sid"), c.cast("double").alias("v"))
                    for sid, c in series.items()])
    return df.select(F.explode(arr).alias("s")).select("s.sid", "s.v")


def exact_quantiles(df: DataFrame, col: str, probs) -> dict[float, float]:
    """Exact linear-interpolated quantiles of one column."""
    q = quantiles_long(to_long(df, {"x": col}), probs)
    return {p: q.get(("x", p)) for p in probs}


def quantile_column(df: DataFrame, col: str, p: float, method: str = "exact"):
    """A Column (scalar) holding one quantile of ``col``."""
    if method == "approx":
        return df.agg(F.percentile_approx(col, p, 10000)).scalar()
    if method == "sql":
        return df.agg(F.percentile(col, p)).scalar()
    return F.lit(exact_quantiles(df, col, [p])[p])


# ---------------------------------------------------------------------------
# profile
# ---------------------------------------------------------------------------

def shape(df: DataFrame) -> DataFrame:
    """Rows, columns, column names and types in one row."""
    names = F.array(*[F.lit(c) for c in df.columns])
    types = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    return df.agg(F.count(F.lit(1)).alias("n_filas")).select(
        "n_filas", F.lit(len(df.columns)).alias("n_columnas"), names.alias("columnas"), types.alias("tipos"))


def is_missing(df: DataFrame, c: str):
    """Null, or NaN in a floating column (T2: NaN counts as null)."""
    kind = dict(df.dtypes)[c]
    return (F.col(c).isNull() | F.isnan(c)) if kind in ("float", "double") else F.col(c).isNull()


def value_of(df: DataFrame, c: str):
    """The column, null where it is NaN."""
    return F.when(~F.isnan(c), F.col(c)) if dict(df.dtypes)[c] in ("float", "double") else F.col(c)


def nan_as_null(df: DataFrame, cols=None) -> DataFrame:
    """``df`` with null for every NaN of its floating columns, which every statistic leaves out."""
    kinds = dict(df.dtypes)
    floating = [c for c in (cols or df.columns) if kinds[c] in ("float", "double")]
    return df.withColumns({c: value_of(df, c) for c in floating}) if floating else df


def null_counts(df: DataFrame) -> DataFrame:
    """(columna, nulos) for every column, from one aggregate pass."""
    counts = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in df.columns])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.col(c).alias("nulos")) for c in df.columns])).alias("s")
    ).select("s.*")


def completeness(df: DataFrame) -> DataFrame:
    """(1 - nulls/cells) * 100 rounded to 2; 0 for an empty frame."""
    cells_null = reduce(lambda a, b: a + b, [F.count_if(is_missing(df, c)) for c in df.columns])
    n = F.count(F.lit(1))
    return df.agg(
        F.when(n == 0, F.lit(0.0))
        .otherwise(F.round((1 - cells_null / (n * len(df.columns))) * 100, 2)).alias("completitud_datos"))


def duplicates(df: DataFrame) -> DataFrame:
    """Duplicate rows = n − distinct rows (dedup is an aggregate with partial combine)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    nd = df.dropDuplicates().agg(F.count(F.lit(1))).scalar()
    return df.sparkSession.range(1).select((n - nd).alias("duplicados"))


def mode_table(df: DataFrame, cols=None) -> DataFrame:
    """(columna, moda): the smallest of the most frequent non-null values, as text.

    One pass for all columns: rows are unpivoted to (column, text, number)
    — number is the value as double for numeric columns, so ties are broken
    in the column's own order — value counts are a partial aggregate (a hot
    value is one row per task), and ``min_by`` picks each column's mode.
    """
    cols = cols or df.columns
    df = nan_as_null(df, cols)
    numeric = set(numeric_columns(df))
    long = df.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("columna"), F.col(c).cast("string").alias("t"),
        (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("x"))
        for c in cols])).alias("s")).select("s.*").filter(F.col("t").isNotNull())
    counts = long.groupBy("columna", "t", "x").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("columna").agg(
        F.min_by(F.col("t"), F.struct(-F.col("_n"), F.col("x"), F.col("t"))).alias("moda"))


def describe(df: DataFrame, cols=None, method: str = "exact", decimals: int = 3) -> DataFrame:
    """count, mean, std (n−1), min, p25, p50, p75, max, median per numeric column.

    Moments come from one fused aggregate; quantiles from ``exact_quantiles``
    (or the sketch with ``method="approx"``).  Values rounded to ``decimals``.
    """
    cols = cols or numeric_columns(df)
    df = nan_as_null(df, cols)
    spark = df.sparkSession
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    m = df.agg(*aggs).first()
    probs = [0.25, 0.5, 0.75]
    if method == "approx":
        found = df.agg(*[F.percentile_approx(c, probs, 10000).alias(c) for c in cols]).first() if cols else {}
        qs = {(c, p): v for c in cols for p, v in zip(probs, found[c] or [None] * 3)}
    else:
        qs = quantiles_long(to_long(df, {c: c for c in cols}), probs)
    rows = []
    for c in cols:
        q = {p: qs.get((c, p)) for p in probs}
        rows.append((c, float(m[f"{c}__count"]), m[f"{c}__mean"], m[f"{c}__std"], m[f"{c}__min"],
                     q[0.25], q[0.5], q[0.75], m[f"{c}__max"], q[0.5]))
    schema = ("columna string, count double, mean double, std double, min double, p25 double, "
              "p50 double, p75 double, max double, mediana double")
    out = spark.createDataFrame(rows, schema)
    return out.select("columna", *[F.round(F.col(k), decimals).alias(k) for k in out.columns[1:]])


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(clase, conteo, pct) with pct = share ×100 rounded to 2; nulls and NaN dropped."""
    df = nan_as_null(df, [target])
    vc = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("conteo"))
    total = df.filter(F.col(target).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return vc.select(F.col(target).alias("clase"), "conteo",
                     F.round(F.col("conteo") / total * 100, 2).alias("pct"))


def imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    df = nan_as_null(df, [target])
    vc = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return vc.agg(F.round(F.max("n") / F.min("n"), 2).alias("ratio_desbalance"))


def fit_imputation(df: DataFrame, method: str = "exact") -> dict:
    """{column: fill value} for the columns with missing values: numeric → median, others → mode.

    Presence per column is one aggregate; all medians come from one batched
    selection (or one sketch aggregate), all modes from one grouped pass.
    """
    missing = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in df.columns]).first()
    numeric = set(numeric_columns(df))
    need_num = [c for c in df.columns if missing[c] > 0 and c in numeric]
    need_other = [c for c in df.columns if missing[c] > 0 and c not in numeric]
    fills = dict.fromkeys(need_num + need_other)
    if need_num and method == "exact":
        q = quantiles_long(to_long(df, {c: c for c in need_num}), [0.5])
        fills.update({c: q.get((c, 0.5)) for c in need_num})
    elif need_num:
        row = df.agg(*[F.percentile_approx(c, 0.5, 10000).cast("double").alias(c) for c in need_num]).first()
        fills.update({c: row[c] for c in need_num})
    if need_other:  # all modes in one pass; one (bounded) row per column
        fills.update({r.columna: r.moda for r in mode_table(df, need_other).collect()})
    return fills


def apply_imputation(df: DataFrame, fills: dict) -> DataFrame:
    """Fill missing values with fitted ones.  A filled integer column becomes
    double, since a median can lie between two integers."""
    numeric, types = set(numeric_columns(df)), dict(df.dtypes)
    out = {}
    for c, value in fills.items():
        if c in numeric:
            x = F.col(c).cast("double")
            x = F.when(F.isnan(x), F.lit(None)).otherwise(x)
            out[c] = F.coalesce(x, F.lit(value).cast("double"))
        else:
            out[c] = F.coalesce(F.col(c), F.lit(value).cast(types[c]))
    return df.withColumns(out) if out else df


def impute_all(df: DataFrame, method: str = "exact") -> DataFrame:
    """Columns with missing values: numeric → median, others → mode; others untouched."""
    return apply_imputation(df, fit_imputation(df, method))


def quality_report(df: DataFrame, target: str) -> DataFrame:
    """One-row summary: rows, columns, total nulls, duplicates, balance and ratio."""
    total_nulls = reduce(lambda a, b: a + b, [F.count_if(is_missing(df, c)) for c in df.columns])
    base = df.agg(F.count(F.lit(1)).alias("n_filas"), total_nulls.alias("total_nulos"))
    dup = duplicates(df).select("duplicados").scalar()
    bal = class_balance(df, target)
    bal_map = bal.agg(F.map_from_entries(F.collect_list(F.struct(F.col("clase").cast("string"), "pct"))))
    ratio = imbalance_ratio(df, target).scalar()
    return base.select("n_filas", F.lit(len(df.columns)).alias("n_columnas"), "total_nulos",
                       dup.alias("duplicados"), bal_map.scalar().alias("balance_pct"),
                       ratio.alias("ratio_desbalance"))


DESCRIBE_METRICS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max", "mediana"]


def describe_long(df: DataFrame, cols=None, method: str = "exact", decimals: int = 3) -> DataFrame:
    """The descriptive statistics in long form (columna, metrica, valor)."""
    wide = describe(df, cols, method, decimals)
    return wide.unpivot("columna", DESCRIBE_METRICS, "metrica", "valor")
