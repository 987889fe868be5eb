"""Structured Streaming operators over an arriving quote feed.

The reference's "real-time" feed is a loop of generated records; here it is
a file stream with a declared schema (no inference), event time
``timestamp`` and ``trigger(availableNow=True)`` for bounded runs.

* ``quote_rules_stream``: stateless rules on each quote (append);
* ``best_quote_stream``: running cheapest quote per product — a streaming
  aggregate with ``min_by`` kept in the state store;
* ``supplier_counts_stream``: running quotes per supplier;
* ``score_stream``: score arriving profiles with a trained model, quarantine
  invalid ones, via ``foreachBatch`` (idempotent per batch id).

Running results are written in update mode: each micro-batch writes only its
changed keys to its own folder under the shared checkpoint folder, and
``read_updates`` takes the newest row of each key.  Every few batches the sink
merges the last compacted version with the batches after it into a new version,
so a reader opens one version and the few batches that follow.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.operators import procurement as P
from cauce.session import ensure_checkpoint_dir
from cauce.sinks.writers import folder_names
from cauce.sources.tables import quotes_from

LINEITEM_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_quantity", T.DoubleType()), T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType()), T.StructField("l_linestatus", T.StringType()),
    T.StructField("l_shipdate", T.TimestampNTZType()),
])


def quote_stream(spark: SparkSession, source_dir: str, file_glob: str = "lineitem*.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Quotes arriving as Parquet files in ``source_dir``."""
    r = spark.readStream.schema(LINEITEM_SCHEMA).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return quotes_from(r.parquet(source_dir))


def quote_rules_stream(quotes: DataFrame) -> DataFrame:
    return P.classify_quotes(quotes)


def best_quote_stream(quotes: DataFrame) -> DataFrame:
    """Running best quote per product (state: one candidate per product)."""
    return P.best_quote_per_product(quotes)


def supplier_counts_stream(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("proveedor_id").agg(F.count(F.lit(1)).alias("cotizaciones"))


def _run_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark, local_fallback=True)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


#: Batches between two compactions of an update-mode table.
COMPACT_EVERY = 10


def _update_sink(out: str, mode: str, keys=None, every: int = COMPACT_EVERY):
    """``foreachBatch`` writer, idempotent when a batch is retried: update mode rewrites
    the folder of its own batch id, complete mode the table.  With ``keys`` every ``every``-th
    batch of an update-mode table is followed by a compaction up to it."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch_id}")
        if mode == "update" and keys and (batch_id + 1) % every == 0:
            compact_batches(batch.sparkSession, out, keys, batch_id)
    return sink


def run_to_table(df: DataFrame, name: str, mode: str = "append", root: str | None = None, keys=None,
                 every: int = COMPACT_EVERY) -> str:
    """Run a stream to completion (availableNow) and return the table path.

    append: a Parquet file sink (exactly-once via its commit log); update: each
    micro-batch's changed keys go to a ``batch=<id>`` folder, which
    :func:`read_updates` reads; complete rewrites the whole result.  ``root``
    (a folder of an earlier run) continues from its checkpoint; with ``keys``
    an update-mode table is compacted after every ``every`` batches.
    """
    root = root or _run_dir(df.sparkSession, name)
    out, ckpt = f"{root}/table", f"{root}/checkpoint"
    w = df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:
        q = w.outputMode(mode).foreachBatch(_update_sink(out, mode, keys, every)).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return out


def _batch_ids(spark: SparkSession, base: str) -> list[int]:
    """Ids of the committed ``batch=`` folders below ``base``, ascending."""
    return sorted(int(n.partition("=")[2]) for n in folder_names(spark, base, "batch=", done=True))


def _versions(out: str) -> str:
    """Folder of the compacted versions of an update-mode table, named by the last batch they hold."""
    return f"{out.rstrip('/')}-versions"


def pending_parts(spark: SparkSession, out: str, upto: int | None = None) -> tuple[int | None, list[int]]:
    """What a reader opens: the newest complete version (None before the first) and the committed batches
    after it; with ``upto``, of the table as it was after that batch."""
    def seen(base):
        return [i for i in _batch_ids(spark, base) if upto is None or i <= upto]
    versions = seen(_versions(out))
    version = versions[-1] if versions else None
    return version, [i for i in seen(out) if version is None or i > version]


def _newest_rows(spark: SparkSession, out: str, keys, version: int | None, batches: list[int]) -> DataFrame:
    """For each key its row of the newest of these parts (a partial aggregate)."""
    parts = [spark.read.parquet(f"{_versions(out)}/batch={version}").withColumn("batch", F.lit(version).cast("long"))
             ] if version is not None else []
    if batches or not parts:  # a table without any batch fails here as a missing table does
        paths = [f"{out}/batch={i}" for i in batches] or [out]
        rows = spark.read.option("basePath", out).parquet(*paths)
        parts.append(rows.withColumn("batch", F.col("batch").cast("long")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")


def read_updates(spark: SparkSession, out: str, keys) -> DataFrame:
    """The table of an update-mode stream: for each key its row of the newest committed batch, from the newest
    compacted version and the batches after it (no row is read into one place).  Null keys are a key."""
    return _newest_rows(spark, out, keys, *pending_parts(spark, out))


def compact_batches(spark: SparkSession, out: str, keys, upto: int) -> str:
    """Merge the newest version before ``upto`` with the batches after it, up to and including ``upto``, into
    the version named ``upto``.  The same call again (a retried batch) rewrites the same version from the same
    parts; readers see it once its write is committed.  Merged batches stay for readers that still hold them."""
    path = f"{_versions(out)}/batch={upto}"
    version, _ = pending_parts(spark, out, upto - 1)
    batches = [i for i in _batch_ids(spark, out) if i <= upto and (version is None or i > version)]
    _newest_rows(spark, out, keys, version, batches).write.mode("overwrite").parquet(path)
    return path


def compact_updates(spark: SparkSession, out: str, keys, version: str) -> str:
    """Write the current table as a new version beside the batches; readers switch by its path."""
    path = f"{out.rstrip('/')}-compacted/run={version}"
    read_updates(spark, out, keys).write.mode("overwrite").parquet(path)
    return path


def start(df: DataFrame, out: str, checkpoint: str, mode: str = "append", every: str = "10 seconds", keys=None):
    """Start a continuous query (processing-time trigger) on a long-running
    feed; returns the StreamingQuery.  ``out`` and ``checkpoint`` must be on
    the shared filesystem so a restarted driver resumes exactly where the
    checkpoint says.  With ``keys`` an update-mode table is compacted on the way."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every)
    if mode == "append":
        return w.outputMode("append").format("parquet").option("path", out).start()
    return w.outputMode(mode).foreachBatch(_update_sink(out, mode, keys)).start()


def score_stream(profiles: DataFrame, model, features, params=None, scaled: bool = False,
                 fills=None, valid_col: str = "perfil_valido") -> DataFrame:
    """Score valid arriving profiles; invalid ones pass through unscored
    (``prob_abandono`` null) so the sink can quarantine them."""
    from cauce.operators.churn import score
    good = profiles.filter(F.col(valid_col))
    scored = score(good, model, features, params, scaled, fills)
    bad = profiles.filter(~F.col(valid_col)).select(
        *profiles.columns, F.lit(None).cast("double").alias("prob_abandono"),
        F.lit(None).cast("string").alias("segmento_riesgo"), F.lit(None).cast("string").alias("accion_retencion"))
    return scored.unionByName(bad)
