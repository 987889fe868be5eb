"""Mixing sources to target weights as a Pfair schedule, in DataFrame operations only.

Every source's documents are put into a fixed pseudo-random order and cut into
blocks of ``block_docs``.  With weight w = share / period, block i (from 1) of
a source is released at slot floor((i-1)/w) and has its deadline at ceil(i/w);
in every slot the released block with the earliest deadline is taken (ties:
smaller source name).  Since the weights add up to one, each block lies inside
its window, so after every slot a source is less than one block away from its
target as long as all sources have blocks left.

Weights are integer shares of a period, so the schedule repeats after
``period`` slots; one period is computed (a fold over its slots) and every
block finds its slot by arithmetic.  A source that runs out leaves its later
slots empty and the others keep theirs: no row is dropped or repeated.

The order within a source uses a hash of ``doc_id``; ranks come from counts per
(source, hash bucket) and a window inside each bucket, so a source that holds
a third of all rows is spread over ``BUCKETS`` groups.

Defined cases: a null source counts as the source ``""``; rows that repeat a
``doc_id`` get ranks next to each other; an empty table gives an empty result;
a source missing from given weights gets one share; columns named like the
added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents in a block, shares in a period (before each source gets one at least).
BLOCK_DOCS, PARTS = 8, 1000
#: Hash buckets of each source: 16 ** _HEX.
_HEX = 3
BUCKETS = 16 ** _HEX

ADDED = ["source_rank", "block", "release", "deadline", "slot"]

# One period of the schedule: a fold over its slots. `shares` is the array of shares in the order of
# source names, `period` their sum; the state holds the blocks taken from each source and the sources
# taken so far. Of the released blocks (release <= t) that with the earliest (deadline, index) is taken.
_SCHEDULE = """
aggregate(
  sequence(0, cast(period - 1 as int)),
  named_struct('done', array_repeat(cast(0 as bigint), size(shares)), 'taken', cast(array() as array<int>)),
  (state, t) -> transform(
    array(array_min(filter(
      transform(shares, (k, j) -> named_struct(
        'deadline', if((state.done[j] * period) div k <= t, ((state.done[j] + 1) * period + k - 1) div k, null),
        'j', j)),
      c -> c.deadline is not null)).j),
    pick -> named_struct(
      'done', transform(state.done, (n, j) -> if(j = pick, n + 1, n)),
      'taken', concat(state.taken, array(pick)))
  )[0],
  state -> state.taken)
"""


def root_shares(counts: DataFrame, parts: int = PARTS) -> DataFrame:
    """(source, share) from (source, n): in proportion to the square root of the counts, one share at least."""
    total = counts.withColumn("_root", F.floor(F.sqrt(F.col("n").cast("double")) * 1000).cast("bigint"))
    everything = total.agg(F.sum("_root").alias("_all"))
    return (total.join(F.broadcast(everything))  # one row
            .select("source", F.greatest(F.lit(1).cast("bigint"), F.expr(f"({parts} * _root) div _all")).alias("share")))


def given_shares(counts: DataFrame, weights: dict[str, float], parts: int = PARTS) -> DataFrame:
    """(source, share) from target weights by source name; sources without one get one share."""
    total = sum(weights.values())
    if any(w < 0 for w in weights.values()) or (weights and total <= 0):
        raise ValueError("weights must not be negative, and one must be positive")
    share: Column = F.lit(1)
    for name, w in weights.items():
        share = F.when(F.col("source") == name, max(1, round(parts * w / total))).otherwise(share)
    return counts.select("source", share.cast("bigint").alias("share"))


def pfair_slots(shares: DataFrame) -> DataFrame:
    """Per source: share, period and ``slots``, the slots of one period that it gets, in order."""
    row = (shares.agg(F.sort_array(F.collect_list(F.struct("source", "share"))).alias("s"))
           .select(F.col("s.source").alias("sources"), F.col("s.share").alias("shares"),
                   F.expr("aggregate(s.share, cast(0 as bigint), (a, x) -> a + x)").alias("period"))
           .where("period > 0"))
    taken = row.withColumn("taken", F.expr(_SCHEDULE))
    one = taken.select("period", F.posexplode("taken").alias("t", "j"), "sources", "shares")
    return (one.groupBy(F.element_at("sources", F.col("j") + 1).alias("source"),
                        F.element_at("shares", F.col("j") + 1).alias("share"), "period")
            .agg(F.sort_array(F.collect_list("t")).alias("slots")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, parts: int = PARTS) -> DataFrame:
    """``docs`` with source_rank, block, release, deadline and slot of each row.

    Without ``weights`` the targets are proportional to the square root of each source's size.
    """
    own = [c for c in docs.columns if c not in ADDED]
    rows = (docs.select(F.struct(*own).alias("_row"), "doc_id", "source")
            .withColumn("_source", F.coalesce("source", F.lit("")))
            .withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
            .withColumn("_bucket", F.substring("_hash", 1, _HEX)))
    per_bucket = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    counts = rows.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"))
    shares = root_shares(counts, parts) if weights is None else given_shares(counts, weights, parts)
    slots = pfair_slots(shares).withColumnRenamed("source", "_source")
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_bucket.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .join(slots, "_source").drop("_n"))
    within = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id"))
    turn = F.expr("(block - 1) div share")
    return (rows.withColumn("_within", within)
            .join(offsets, ["_source", "_bucket"])
            .withColumn("source_rank", (F.col("_before") + F.col("_within")).cast("bigint"))
            .withColumn("block", F.expr(f"(source_rank - 1) div {int(block_docs)} + 1"))
            .withColumn("release", F.expr("((block - 1) * period) div share"))
            .withColumn("deadline", F.expr("(block * period + share - 1) div share"))
            .withColumn("slot", turn * F.col("period") + F.expr("element_at(slots, cast((block - 1) % share + 1 as int))"))
            .select("_row.*", *ADDED))


def interleave(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of ``docs`` in the order of the schedule (a global sort: files and rows follow the slots)."""
    mixed = mix(docs, weights, block_docs)
    return mixed.orderBy("slot", "source_rank").select(*docs.columns)
