"""Exact deduplication that survives hot groups: local merge, salted merge, global merge.

Texts are equal when they agree after deleting the six ASCII white-space
characters; null counts as empty.  Every merge groups by the digest *and* the
whole normalised text, so two texts that shared a digest would never merge.

* A narrow pass writes one slim row per document (digest, salt, rank) to the
  shared folder; digests that occur once are finished there, without moving
  their text.  Which digests occur more often reaches the next pass as a
  broadcast set of at most ``FILTER_BUCKETS`` hash buckets (a fixed bound; a
  bucket shared by chance only sends a text on to the merge, which then finds
  it alone).
* Stage 1 aggregates (digest, salt, content): Spark's map-side partial
  aggregate is the local merge, its final aggregate the salted one; a group of
  copies of any size reaches the shuffle as one row per map task and salt.
* Stage 2 merges the salt winners by (digest, content) again, which yields
  the group's keeper and size; a group has at most one row per salt there.
* The verdict returns to the rows on (digest, salt), so the rows of a hot
  group stay spread.

Defined cases: null or empty texts form one group; a null ``doc_id`` loses
every tie; of rows that repeat a ``doc_id`` within a group only one is kept;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cauce.llm.common import SALTS, materialise, salt_of

#: White space deleted before comparing: [\x20\x09-\x0D].
WHITE = " \n\t\x0b\x0c\r"
#: Hash buckets of the broadcast filter: its largest possible number of rows.
FILTER_BUCKETS = 1 << 18

# A (length, doc_id) pair packed into one decimal, so that the winner is a
# plain max() that hash-aggregates: length * 2^65 + (2^63 - doc_id), 0 for a null id.
_UNIT = str(1 << 65)
_TOP = str(1 << 63)


def normalised(text: str = "text") -> Column:
    col = F.coalesce(F.col(text), F.lit(""))
    for c in WHITE:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def _rank(text: Column, doc_id: Column) -> Column:
    length = F.length(F.coalesce(text, F.lit(""))).cast("decimal(10,0)")
    tie = F.coalesce(F.expr(f"cast({_TOP}BD as decimal(20,0))") - doc_id.cast("decimal(20,0)"), F.lit(0))
    return (length * F.expr(f"cast({_UNIT}BD as decimal(20,0))") + tie.cast("decimal(21,0)")).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    tie = rank % F.expr(f"cast({_UNIT}BD as decimal(38,0))")
    return F.when(tie > 0, (F.expr(f"cast({_TOP}BD as decimal(38,0))") - tie).cast("bigint"))


def _keyed(docs: DataFrame, salts: int) -> DataFrame:
    return (docs.withColumn("_content", normalised())
            .withColumn("_digest", F.sha2("_content", 256))
            .withColumn("_salt", salt_of("doc_id", salts=salts))
            .withColumn("_rank", _rank(F.col("text"), F.col("doc_id")))
            .withColumn("_bucket", F.pmod(F.xxhash64("_digest"), F.lit(FILTER_BUCKETS)).cast("int")))


def _slim(docs: DataFrame, salts: int) -> DataFrame:
    return materialise(_keyed(docs.select("doc_id", "text"), salts)
                       .select("doc_id", "_digest", "_salt", "_rank", "_bucket"), "exact-slim")


def _buckets(slim: DataFrame) -> DataFrame:
    """Hash buckets of the digests that occur more than once; at most FILTER_BUCKETS rows."""
    copies = slim.groupBy("_digest").agg(F.count("*").alias("_n"), F.min("_bucket").alias("_bucket"))
    return F.broadcast(copies.where("_n > 1").select("_bucket").distinct())


def _merge(docs: DataFrame, buckets: DataFrame, salts: int) -> DataFrame:
    """One row per group among the rows that the filter passes: digest, content, best, size, salts."""
    # local and salted merge, comparing whole content
    salted = (_keyed(docs.select("doc_id", "text"), salts).join(buckets, "_bucket", "left_semi")
              .groupBy("_digest", "_salt", "_content")
              .agg(F.max("_rank").alias("_best"), F.count("*").alias("_size")))
    # global merge of the salt winners, comparing whole content again
    merged = (salted.groupBy("_digest", "_content")
              .agg(F.max("_best").alias("_best"), F.sum("_size").alias("_size"),
                   F.collect_set("_salt").alias("_salts")))  # at most `salts` entries
    return materialise(merged, "exact-merged")


def _collided(merged: DataFrame) -> DataFrame:
    """Digests that stand for more than one content (a SHA-256 collision; none is known)."""
    return merged.groupBy("_digest").agg(F.count("*").alias("_n")).where("_n > 1").select("_digest")


def _judge(rows: DataFrame, merged: DataFrame, collided: DataFrame, how: str) -> DataFrame:
    """``rows`` with the group's ``_best`` and ``_size`` and the flag ``kept``."""
    verdict = (merged.join(collided, "_digest", "left_anti")
               .select("_digest", F.explode("_salts").alias("_salt"), "_best", "_size"))
    found = (rows.join(verdict, ["_digest", "_salt"], how)
             .withColumn("_best", F.coalesce("_best", "_rank"))
             .withColumn("_size", F.coalesce("_size", F.lit(1)).cast("bigint")))
    return _flag(found)


def _flag(found: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("_digest", "_salt", "doc_id").orderBy(F.desc("_rank")))
    return (found.withColumn("_nth", nth)
            .withColumn("kept", (F.col("_rank") == F.col("_best")) & (F.col("_nth") == 1)))


def _judge_collisions(docs: DataFrame, merged: DataFrame, collided: DataFrame, salts: int) -> DataFrame:
    """The rows of colliding digests, each judged within its own content."""
    groups = merged.drop("_salts").join(collided, "_digest", "left_semi")
    return _flag(_keyed(docs, salts).join(groups, ["_digest", "_content"]))


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = _slim(docs, salts)
    merged = _merge(docs, _buckets(slim), salts)
    collided = _collided(merged)
    out = [F.col("doc_id"), _id_of(F.col("_best")).alias("keep_id"), F.col("_size").alias("group_size"),
           F.col("kept"), F.col("_digest").alias("text_sha256")]
    if collided.isEmpty():
        return _judge(slim, merged, collided, "left").select(*out)
    rest = slim.join(collided, "_digest", "left_anti")
    return (_judge(rest, merged, collided, "left").select(*out)
            .unionByName(_judge_collisions(docs, merged, collided, salts).select(*out)))


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """``docs`` with one row of each group of equal texts; texts without copies are not moved."""
    buckets = _buckets(_slim(docs, salts))
    merged = _merge(docs, buckets, salts)
    collided = _collided(merged)
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    rows = _keyed(packed, salts).drop("text", "_content")
    single = rows.join(buckets, "_bucket", "left_anti").select("_row.*")
    shared = rows.join(buckets, "_bucket", "left_semi")
    if collided.isEmpty():
        return single.unionAll(_judge(shared, merged, collided, "inner").where("kept").select("_row.*"))
    shared = shared.join(collided, "_digest", "left_anti")
    return (single.unionAll(_judge(shared, merged, collided, "inner").where("kept").select("_row.*"))
            .unionAll(_judge_collisions(packed, merged, collided, salts).where("kept").select("_row.*")))
