"""File sources with declared schemas (no inference on the hot path).

* strict CSV: ``FAILFAST`` — any malformed record fails the read;
* tolerant CSV: ``PERMISSIVE`` and a missing path is an empty frame that
  keeps the schema;
* typed text: every field read as text, then parsed by column lists with
  ``''`` → null and non-numeric → null;
* raw landing: copy the raw file into the raw zone before it is parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cauce.functions import rules as R

# Schemas of the reference's files (FIXTURES.md part A).
SOLICITUDES = ("id int, producto string, cantidad int, presupuesto_max double, urgencia string, "
               "solicitante string, fecha_solicitud date")
PROVEEDORES = "id int, nombre string, rut string, email string, categoria string, reputacion_score double"
COTIZACIONES = ("proveedor_id int, proveedor_nombre string, producto string, precio_total double, "
                "plazo_dias int, garantia_meses int, risk_score double, email_asunto string, timestamp timestamp")
CLIENTES = ("edad int, anos_cliente int, uso_datos_gb double, llamadas_mes int, reclamos int, "
            "plan_premium int, abandona int")
VENTAS_RAW = "id string, fecha string, producto string, cantidad string, precio string, ciudad string"


def read_csv_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("nullValue", "").csv(path))


def read_csv_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """PERMISSIVE read; a missing path yields an empty frame with ``schema``."""
    try:
        df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
              .option("nullValue", "").csv(path))
        df.schema  # noqa: B018 - resolves the path
        return df
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_portfolio(spark: SparkSession, path: str | None = None, frame: DataFrame | None = None,
                   schema: str = CLIENTES) -> DataFrame:
    """The caller's frame when given (scoring job), else the CSV at ``path``."""
    if frame is not None:
        return frame
    return read_csv_strict(spark, path, schema)


def read_typed_text(spark: SparkSession, path: str, int_cols=(), float_cols=(), header: bool = True
                    ) -> DataFrame:
    """CSV with every field as text: each field trimmed, '' → null, listed
    columns parsed as integers / floats (non-numeric → null)."""
    df = spark.read.option("header", header).option("inferSchema", False).csv(path)
    out = {}
    for c in df.columns:
        v = F.when(R.strip_ws(c) != "", R.strip_ws(c))
        if c in int_cols:
            out[c] = R.to_double(v).try_cast("bigint")
        elif c in float_cols:
            out[c] = R.to_double(v)
        else:
            out[c] = v
    return df.withColumns(out)


def land_raw(spark: SparkSession, src: str, raw_zone: str) -> str:
    """Write the lines of the raw text file(s) into the raw zone, task by task; returns the path.

    Lines end at \\n alone and keep their bytes, whatever the encoding, a \\r before the \\n included.
    Two things may change: a last line without \\n gets one, and a UTF-8 byte order mark is dropped."""
    spark.read.option("lineSep", "\n").text(src).write.mode("overwrite").option("lineSep", "\n").text(raw_zone)
    return raw_zone


def read_quotes(spark: SparkSession, path: str, fmt: str = "json", schema: str = COTIZACIONES) -> DataFrame:
    """A batch of quote records (json or parquet) with the declared schema."""
    r = spark.read.schema(schema)
    return r.json(path) if fmt == "json" else r.parquet(path)


def with_retry(read, attempts: int = 3, base_delay: float = 1.0, fallback=None, sleep=None):
    """Call ``read()`` with exponential backoff (1 s, 2 s, 4 s …); after the
    last failure return ``fallback()`` (e.g. the last successful run's
    table) when given, else re-raise.

    Reads are lazy: for failures while the data are read to be retried too,
    ``read`` must end in an action, as :func:`land_with_retry` does."""
    import time as _time
    pause = sleep or _time.sleep
    for i in range(attempts):
        try:
            return read()
        except Exception:  # noqa: BLE001
            if i == attempts - 1:
                if fallback is not None:
                    return fallback()
                raise
            pause(base_delay * (2 ** i))
    return None


def land_with_retry(read, path: str, attempts: int = 3, base_delay: float = 1.0, sleep=None) -> DataFrame:
    """Read a source and write it to ``path`` as Parquet, retrying the whole of it (planning and
    reading); returns the landed table."""
    def landed() -> DataFrame:
        df = read()
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    return with_retry(landed, attempts, base_delay, sleep=sleep)
