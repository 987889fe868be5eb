"""Sinks: files, versioned tables, prediction records, manifests, appends.

Rewrites never modify files in place: a new version is written under
``<base>/run=<run_id>`` and readers pick the newest run that is complete: a job
lists its run in a manifest after its last table (``begin_run``, ``commit_run``,
``latest_run``).  Appends add a new ``run=`` partition.  Nothing is collected to the
driver; manifests are one-row aggregates written by Spark.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce.operators.maintenance import sequential_ids

ID_NAMES = {"id", "cliente_id", "id_cliente", "customer_id", "customerid", "client_id", "clientid",
            "subscriber_id", "entidad_id"}  # FIXED VALUES: id column names recognised


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV; text is written as is (Spark's writer trims by default)."""
    (df.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def write_version(df: DataFrame, base: str, run_id: str, partition_by=None) -> str:
    """Write a new version of a table; older versions stay readable."""
    path = f"{base}/run={run_id}"
    write_parquet(df, path, "overwrite", partition_by)
    return path


#: Folder of a job's output that lists its complete runs, one ``run=`` folder each.
MANIFEST = "corridas"


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folder_names(spark: SparkSession, base: str, prefix: str, done: bool = False) -> list[str]:
    """Names below ``base`` that start with ``prefix``, sorted; ``done``: only those whose write was committed."""
    fs, path = _folder(spark, base)
    names = sorted(str(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []
    return [n for n in names if n.startswith(prefix) and (not done or fs.exists(_folder(spark, f"{base}/{n}/_SUCCESS")[1]))]


def _runs(spark: SparkSession, base: str, done: bool = False) -> list[str]:
    """Names of the ``run=`` folders below ``base``, oldest first; ``done``: only those whose write was committed."""
    return folder_names(spark, base, "run=", done)


def begin_run(spark: SparkSession, out_dir: str, run_id: str) -> None:
    """Take a run off the manifest before its tables are written (again), and start the manifest of a new output."""
    fs, entry = _folder(spark, f"{out_dir}/{MANIFEST}/run={run_id}")
    fs.delete(entry, True)
    fs.mkdirs(entry.getParent())


def commit_run(spark: SparkSession, out_dir: str, run_id: str, job: str) -> None:
    """List a run whose tables are all written: the last step of a job."""
    done = spark.range(1).select(F.lit(job).alias("trabajo"), F.current_timestamp().alias("terminada"))
    write_parquet(done.coalesce(1), f"{out_dir}/{MANIFEST}/run={run_id}")


def latest_run(spark: SparkSession, base: str) -> str | None:
    """The newest ``run=`` folder of a table, or None.

    Where the output that holds the table has a manifest, runs that it does not list do not count; without one
    (a table written by itself) every version whose own write was committed does.  A saved model, whose folder
    holds several writes, is only safe behind a manifest.
    """
    out_dir = base.rstrip("/").rpartition("/")[0]
    fs, manifest = _folder(spark, f"{out_dir}/{MANIFEST}")
    if fs.exists(manifest):
        listed = set(_runs(spark, f"{out_dir}/{MANIFEST}", done=True))
        runs = [r for r in _runs(spark, base) if r in listed]
    else:
        runs = _runs(spark, base, done=True)
    return f"{base}/{runs[-1]}" if runs else None


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    """Newest complete version of a versioned table; one run's files are listed and read."""
    found = latest_run(spark, base)
    if found is None:
        raise FileNotFoundError(f"no complete run of {base}")
    return spark.read.parquet(found)


def append(df: DataFrame, base: str, run_id: str, partition_by=None) -> None:
    """Append rows as the run's own partition of an append-only table; running
    the same run id again rewrites that partition, so rows are never doubled."""
    write_parquet(df, f"{base}/run={run_id}", "overwrite", partition_by)


def is_missing(error: AnalysisException) -> bool:
    """Whether a read failed because there is no table (no path, or no file in it)."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def append_if_empty(df: DataFrame, base: str, run_id: str) -> bool:
    """Load ``df`` only when the table at ``base`` has no rows; returns loaded?
    A table that exists but cannot be read is an error, not an empty table."""
    try:
        empty = df.sparkSession.read.parquet(base).isEmpty()
    except AnalysisException as error:
        if not is_missing(error):
            raise
        empty = True
    if empty:
        append(df, base, run_id)
    return empty


def export(df: DataFrame, role: str, path: str, writer=None) -> None:
    """Write the role's view of ``df``; a role without export permission is refused."""
    from cauce.operators import privacy as PV
    if not PV.can_export(role):
        raise PermissionError(f"El rol no puede exportar: {role}")
    (writer or write_csv)(PV.role_view(df, role), path)


def id_column(df: DataFrame) -> str | None:
    """First column that looks like an identifier (name set, *_id, id_*)."""
    for c in df.columns:
        n = c.strip().lower()
        if n in ID_NAMES or n.endswith("_id") or n.startswith("id_"):
            return c
    return None


def prediction_records(scored: DataFrame, entity: str = "CLIENTE", prob: str = "prob_abandono",
                       segment: str = "segmento_riesgo") -> DataFrame:
    """Rows of the predictions table: fila, entidad, entidad_id, score, probabilidad, prediccion.

    ``fila`` is always the 1-based row number (rows in the order of the id, rows
    without one last, then all columns); ``entidad_id`` is the id as text, of
    any type, or the row number where there is no id."""
    idc = id_column(scored)
    order = [c for c in scored.columns if c != idc]
    rows = scored
    if idc:
        rows = scored.withColumn("_no_id", F.col(idc).isNull().cast("int"))
        order = ["_no_id", idc, *order]
    numbered = sequential_ids(rows, order, col="fila")
    row = F.col("fila").cast("string")
    ident = F.coalesce(F.col(idc).cast("string"), row) if idc else row
    return numbered.select("fila", F.lit(entity).alias("entidad"), ident.alias("entidad_id"), F.col(prob).alias("score"),
                           F.col(prob).alias("probabilidad"), F.col(segment).alias("prediccion"))


def write_predictions(records: DataFrame, base: str) -> None:
    """Prediction rows as JSON plus a one-row manifest (generado_en, total)."""
    write_json(records, f"{base}/predicciones")
    manifest = records.agg(F.count(F.lit(1)).alias("total")).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("generado_en"), "total")
    write_json(manifest.coalesce(1), f"{base}/manifiesto")


def read_predictions(spark: SparkSession, base: str, limit: int | None = 50,
                     csv_fallback: str | None = None, csv_schema: str | None = None) -> DataFrame:
    """Newest predictions in a stable order, optionally the first ``limit``.

    JSON records first; when they are missing, the scored CSV at
    ``csv_fallback`` (rows in id order) stands in."""
    try:
        df = spark.read.json(f"{base}/predicciones")
        df.schema  # noqa: B018 - resolves the path
        df = df.orderBy("fila")
    except AnalysisException as error:
        if csv_fallback is None or not is_missing(error):
            raise
        r = spark.read.option("header", True)
        df = (r.schema(csv_schema) if csv_schema else r).csv(csv_fallback)
        idc = id_column(df)
        df = df.orderBy(*([idc] if idc else df.columns))
    return df.limit(limit) if limit is not None else df


METRICS_DOC_SCHEMA = (
    "modelo_seleccionado string, criterio_seleccion string, recall_cv5_optimizado double, "
    "matriz_confusion array<array<bigint>>, "
    "metricas_por_modelo map<string, struct<accuracy:double, precision:double, recall:double, f1:double, "
    "roc_auc:double, gini:double, tiempo_entrenamiento_s:double, escalado:boolean>>, "
    "importancia_variables map<string,double>, tiempo_total_s double")


def read_metrics_doc(spark: SparkSession, path: str) -> DataFrame:
    """The metrics document; an empty frame with the schema when it is missing or malformed."""
    try:
        docs = spark.read.schema(METRICS_DOC_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], METRICS_DOC_SCHEMA)
    # a malformed document parses to nulls throughout
    return docs.filter(F.col("modelo_seleccionado").isNotNull())
