"""Connected components of an edge table by alternating large and small stars.

Works on (a, b) string pairs; every round is written to the shared folder, and
no component, hub or edge list is ever gathered in one task or the driver:
minima are partial aggregates and return to the edges by salted lookups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauce.llm.common import drop_tables, materialise, salt_of, salted_lookup


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on pairs (hi, lo) with hi > lo; returns pairs of the same kind."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = salted_lookup(both.withColumn("_salt", salt_of("v")), least, ["u"], "_salt")
    pairs = moved.where("v > u" if large else "v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    if not large:
        pairs = pairs.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return pairs.where("hi <> lo").distinct()


def _flat(pairs: DataFrame) -> bool:
    """Whether every node has one pair as ``hi`` and no ``lo`` is another pair's ``hi``: all point at their roots."""
    twice = pairs.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi")
    inner = pairs.select(F.col("lo").alias("hi")).distinct().join(pairs.select("hi"), "hi", "left_semi")
    return twice.unionByName(inner).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of its component.

    Self-loops are allowed; an edge with a null end is ignored.  With ``rounds`` the work may end early, and
    nodes of one component can then have different roots (each a node of the component).
    """
    given = (edges.where(f"{a} IS NOT NULL AND {b} IS NOT NULL")
             .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")))
    loops = given.where("hi = lo").select(F.col("hi").alias("node"), F.col("hi").alias("root"))
    now = materialise(given.where("hi <> lo").distinct(), "edges")
    done = 0
    while done != rounds and not _flat(now):
        before, now = now, materialise(_star(_star(now, True), False), "edges")
        drop_tables(before)
        done += 1
    found = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return (found.unionByName(roots).unionByName(loops)
            .groupBy("node").agg(F.min("root").alias("root")))
