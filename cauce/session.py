"""Spark session helpers.

The library never creates a session implicitly inside an operator: every
operator takes DataFrames (or a session) from the caller.  ``build_session``
is for scripts, tests and the bench; on a cluster the session comes from
``spark-submit`` and only the SQL knobs below are applied.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# SQL settings the operators are designed around.  AQE re-plans joins at
# runtime (broadcast only when the measured side is under
# spark.sql.autoBroadcastJoinThreshold, i.e. a checked size), coalesces small
# shuffle partitions and splits skewed ones.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # streaming state on local disk with checkpoints, not in executor heaps
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "cauce",
    extra: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library's SQL defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SQL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: By application: the temporary folder of a local session that names no shared one.
_local_dirs: dict = {}


def ensure_checkpoint_dir(spark: SparkSession, local_fallback: bool = False) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared filesystem path set by the operator of
    the cluster; without it this fails.  Only a local master (tests, bench) may
    fall back to a temporary folder, which is removed when Python ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        local = master.startswith("local") and not master.startswith("local-cluster")
        if not (local_fallback and local):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder"
            )
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="cauce-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
            atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
        path = _local_dirs[app]
    spark.sparkContext.setCheckpointDir(path)
    return path
