"""Helpers shared by the corpus operators: shared folder, lineage cuts, salted lookups."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of ``documents``; every pipeline stage but the last returns exactly these.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Number of salts a hot key is spread over.
SALTS = 32

#: Bytes of an Arrow batch sent to a Python worker.
ARROW_BYTES = 8 << 20

#: By application: the temporary folder of a local master without a shared one.
_local_dirs: dict[str, str] = {}
#: Applications whose workers have this package.
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent a temporary folder is made on a local master
    (tests); on a cluster that is an error, since a machine-local folder would
    not be seen by the other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder all executors share")
        path = _local_dirs.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="cauce-llm-")
        _local_dirs[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), as ``--py-files`` would.

    Unless the session says otherwise, Arrow batches are kept to ``ARROW_BYTES``, so that a worker
    holds few texts at a time.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) in ("64MB", "67108864", "67108864b"):
        spark.conf.set(setting, ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    package = os.path.dirname(here)
    path = os.path.join(tempfile.mkdtemp(prefix="cauce-ship-"), "cauce_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.write(os.path.join(package, "__init__.py"), "cauce/__init__.py")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"cauce/llm/{name}")
    spark.sparkContext.addPyFile(path)  # executors fetch it from the driver
    _shipped.add(app)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, in this application's own subfolder."""
    return f"{shared_dir(spark)}/cauce-llm-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application's operators wrote to the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cauce-llm-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote, once everything that read them has been written itself."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has no lineage, so a lost executor costs a re-read of files
    that every machine sees, never a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def salt_of(*cols: str | Column, salts: int = SALTS) -> Column:
    """A salt in [0, salts) that is a function of the row's values."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted_lookup(facts: DataFrame, dims: DataFrame, key: list[str], salt: str, how: str = "left") -> DataFrame:
    """Join ``dims`` (unique on ``key``) to ``facts`` when a key may hold a large part of the facts.

    The distinct (key, salt) pairs of the facts are aggregated map-side first,
    so a hot key costs one row per salt there; each pair fetches its row of
    ``dims`` once, and the facts join on (key, salt), which spreads a hot key
    over the salts.  Keys must not be null.
    """
    pairs = facts.select(*key, salt).distinct()
    found = pairs.join(dims, key)
    return facts.join(found, [*key, salt], how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
