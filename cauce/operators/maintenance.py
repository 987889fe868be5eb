"""Table maintenance on immutable files: keys, constraints, insert-ignore,
upsert, sequential ids and target-schema conformance.

Each operator returns the *new version* of a table as a DataFrame; the
caller writes it to a new path and swaps (``cauce.sinks.writers``), which
is how a rewrite stays atomic without a transactional table format.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauce.operators.ordering import row_numbers


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent (a left anti join)."""
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    c = child.filter(F.col(child_key).isNotNull())
    return c.join(p, c[child_key] == p["_pk"], "left_anti")


def fk_report(checks) -> DataFrame:
    """``checks``: iterable of (name, child, child_key, parent, parent_key);
    returns (fk, huerfanos) with one row per foreign key."""
    parts = [orphans(ch, ck, pa, pk).agg(F.count(F.lit(1)).alias("huerfanos"))
             .select(F.lit(name).alias("fk"), "huerfanos") for name, ch, ck, pa, pk in checks]
    return reduce(DataFrame.unionByName, parts)


def first_per_key(df: DataFrame, key: str, order) -> DataFrame:
    """One row per key: the first by ``order`` (partial-aggregated min_by)."""
    cols = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def insert_ignore(target: DataFrame, incoming: DataFrame, key: str, order) -> DataFrame:
    """``INSERT … ON CONFLICT (key) DO NOTHING``: new version of ``target``.

    Incoming rows with a null key are refused (the key is NOT NULL); among
    incoming duplicates the first by ``order`` is inserted; keys already in
    the target are ignored.
    """
    inc = first_per_key(incoming.filter(F.col(key).isNotNull()).select(*target.columns), key, order)
    existing = target.select(F.col(key).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    new = inc.join(existing, inc[key] == existing["_k"], "left_anti")
    return target.unionByName(new.select(*target.columns))


def upsert(target: DataFrame, source: DataFrame, key: str, stamp_col: str | None = None,
           stamp=None) -> DataFrame:
    """UPSERT on ``key``: source rows replace target rows with the same key,
    other target rows are kept; ``stamp_col`` is set on the source rows
    (``stamp`` Column or ``current_timestamp()``)."""
    if stamp_col:
        source = source.withColumn(stamp_col, stamp if stamp is not None else F.current_timestamp())
    src_keys = source.select(F.col(key).alias("_k")).distinct()
    kept = target.join(src_keys, target[key] == src_keys["_k"], "left_anti")
    return kept.unionByName(source.select(*target.columns))


def sequential_ids(df: DataFrame, order, col: str = "id", start: int = 1) -> DataFrame:
    """1..N ids following ``order`` (a total order), without an unpartitioned
    window: value-range buckets from a bounded sample, per-bucket counts as
    offsets, row numbers inside each bucket (``cauce.operators.ordering``)."""
    return row_numbers(df, order, col=col, start=start)


@dataclass
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    default: object = None
    unique: bool = False


def conform(df: DataFrame, spec) -> DataFrame:
    """Project ``df`` onto the target layout: cast types, fill defaults for
    missing or null values (``DEFAULT``), keep column order."""
    cols = []
    for s in spec:
        src = F.col(s.name).cast(s.type) if s.name in df.columns else F.lit(None).cast(s.type)
        if s.default is not None:
            default = s.default if not isinstance(s.default, str) or not s.default.startswith("=") \
                else F.expr(s.default[1:])
            src = F.coalesce(src, default if hasattr(default, "cast") else F.lit(default).cast(s.type))
        cols.append(src.alias(s.name))
    return df.select(*cols)


def constraint_report(df: DataFrame, spec, unique_sets=()) -> DataFrame:
    """(restriccion, columna, violaciones): NOT NULL counts (one aggregate)
    and UNIQUE violations (keys appearing more than once, grouped counts)."""
    spark = df.sparkSession
    parts = []
    nn = [s.name for s in spec if not s.nullable]
    if nn:
        c = df.agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in nn])
        parts.append(c.select(F.explode(F.array(*[
            F.struct(F.lit("NOT NULL").alias("restriccion"), F.lit(x).alias("columna"),
                     F.col(x).alias("violaciones")) for x in nn])).alias("s")).select("s.*"))
    uniq = [[s.name] for s in spec if s.unique] + [list(u) for u in unique_sets]
    for u in uniq:
        dup = (df.filter(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in u]))
               .groupBy(*u).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1))
        parts.append(dup.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violaciones")).select(
            F.lit("UNIQUE").alias("restriccion"), F.lit(",".join(u)).alias("columna"), "violaciones"))
    if not parts:
        return spark.createDataFrame([], "restriccion string, columna string, violaciones long")
    return reduce(DataFrame.unionByName, parts)
