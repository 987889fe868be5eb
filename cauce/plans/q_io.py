"""Source, sink and job queries.

Each writes driver-derived data to a run folder under the shared checkpoint
directory and reads it back through the operator under test, so the check
covers the full write → read path over whole tables.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.operators import sales as S
from cauce.plans import jobs as J
from cauce.plans import oracle as O
from cauce.plans.registry import register
from cauce.session import ensure_checkpoint_dir
from cauce.sinks import writers as W
from cauce.sources import files as FS
from cauce.sources import tables as T


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark, local_fallback=True), "io", f"{name}-{uuid.uuid4().hex[:10]}")


_REQ_SCHEMA = ("id bigint, solicitante_id bigint, presupuesto_max double, urgencia string, "
               "fecha_solicitud date, estado string")


@register("src_csv_strict", "SELECT * FROM requests", views=("requests",))
def src_csv_strict(spark, d):
    path = _scratch(spark, "requests_csv")
    W.write_csv(T.requests(spark, d), path)
    return FS.read_csv_strict(spark, path, _REQ_SCHEMA)


_SUP_SCHEMA = "id bigint, nombre string, rut string, email string, categoria_id int, reputacion_score double"


@register("src_csv_tolerant", "SELECT * FROM suppliers", views=("suppliers",))
def src_csv_tolerant(spark, d):
    """Suppliers from CSV plus a missing second file (empty, same schema)."""
    path = _scratch(spark, "suppliers_csv")
    W.write_csv(T.suppliers(spark, d), path)
    present = FS.read_csv_tolerant(spark, path, _SUP_SCHEMA)
    missing = FS.read_csv_tolerant(spark, path + "-missing", _SUP_SCHEMA)
    return present.unionByName(missing)


@register("src_portfolio", "SELECT * FROM portfolio", views=("portfolio",))
def src_portfolio(spark, d):
    path = _scratch(spark, "portfolio_csv")
    p = T.portfolio(spark, d)
    W.write_csv(p, path)
    return FS.read_portfolio(spark, path, schema="cliente_id bigint, " + FS.CLIENTES)


@register("src_typed_csv", f"""
SELECT CAST(id AS BIGINT) AS id, nullif({O.sql_strip('fecha')}, '') AS fecha,
  nullif({O.sql_strip('producto')}, '') AS producto,
  TRY_CAST({O.sql_to_double(f"nullif({O.sql_strip('cantidad')}, '')")} AS BIGINT) AS cantidad,
  {O.sql_to_double(f"nullif({O.sql_strip('precio')}, '')")} AS precio,
  nullif({O.sql_strip('ciudad')}, '') AS ciudad FROM sales_raw""",
          views=("sales_raw",))
def src_typed_csv(spark, d):
    """Raw sales written as text CSV and parsed back by column lists."""
    path = _scratch(spark, "sales_csv")
    W.write_csv(T.sales_raw(spark, d).select(*S.RAW_COLUMNS).withColumn("id", F.col("id").cast("string")), path)
    df = FS.read_typed_text(spark, path, int_cols=("id", "cantidad"), float_cols=("precio",))
    # the CSV writer writes null as empty text: a blank field and a null read back alike
    return df.select("id", "fecha", "producto", "cantidad", "precio", "ciudad")


@register("src_quotes_batch", """
SELECT proveedor_id, proveedor_nombre, producto, precio_total, plazo_dias, garantia_meses, risk_score,
  'Cotizacion: ' || producto AS email_asunto, "timestamp" FROM quotes_named""", views=("quotes_named",))
def src_quotes_batch(spark, d):
    path = _scratch(spark, "quotes_json")
    q = T.quotes(spark, d, with_names=True)
    W.write_json(q.select("proveedor_id", "proveedor_nombre", "producto", "precio_total", "plazo_dias",
                          "garantia_meses", "risk_score",
                          F.concat(F.lit("Cotizacion: "), F.col("producto")).alias("email_asunto"),
                          "timestamp"), path)
    schema = ("proveedor_id bigint, proveedor_nombre string, producto string, precio_total double, "
              "plazo_dias double, garantia_meses int, risk_score double, email_asunto string, "
              "timestamp timestamp_ntz")
    return FS.read_quotes(spark, path, "json", schema)


@register("src_valid_invalid", f"""
WITH f AS (
  SELECT coalesce({O.sql_to_date('fecha')} IS NOT NULL, false)
    AND {O.sql_is_numeric('cantidad')} AND {O.sql_is_numeric('precio')}
    AND coalesce({O.sql_to_double('cantidad')} > 0 AND {O.sql_to_double('cantidad')} <= {S.QUANTITY_MAX}, false)
    AND coalesce({O.sql_to_double('precio')} > 0, false)
    AND (descuento IS NULL OR coalesce(descuento >= 0 AND descuento <= 100, false))
    AND NOT (producto IS NULL OR length({O.sql_strip('producto')}) = 0)
    AND NOT (ciudad IS NULL OR length({O.sql_strip('ciudad')}) = 0) AS ok FROM (SELECT DISTINCT id, fecha, producto, cantidad, precio, ciudad, descuento FROM sales_raw
    WHERE id IS NOT NULL AND fecha IS NOT NULL AND producto IS NOT NULL AND cantidad IS NOT NULL AND precio IS NOT NULL
      AND ciudad IS NOT NULL AND {O.sql_to_double('precio')} IS NOT NULL AND {O.sql_to_double('cantidad')} IS NOT NULL
      AND {O.sql_to_date('fecha')} IS NOT NULL) c)
SELECT CASE WHEN ok THEN 'valido' ELSE 'error' END AS estado_calidad, count(*) AS count FROM f GROUP BY 1""",
          views=("sales_raw",))
def src_valid_invalid(spark, d):
    """The two validated outputs of the sales job, read back with their counts."""
    out = _scratch(spark, "sales_job")
    J.run_sales(spark, d, out, "r1")
    clean = spark.read.parquet(f"{out}/ventas_clean")
    err = spark.read.parquet(f"{out}/ventas_error")
    return clean.groupBy("estado_calidad").count().unionByName(err.groupBy("estado_calidad").count())


@register("src_jdbc_query", f"""
WITH flags AS (SELECT 1) SELECT 'python_notebook' AS fuente, count(*) AS total FROM (
  SELECT * FROM (SELECT DISTINCT id, fecha, producto, cantidad, precio, ciudad, descuento FROM sales_raw
    WHERE id IS NOT NULL AND fecha IS NOT NULL AND producto IS NOT NULL AND cantidad IS NOT NULL AND precio IS NOT NULL
      AND ciudad IS NOT NULL AND {O.sql_to_double('precio')} IS NOT NULL AND {O.sql_to_double('cantidad')} IS NOT NULL
      AND {O.sql_to_date('fecha')} IS NOT NULL) c WHERE
    coalesce({O.sql_to_date('fecha')} IS NOT NULL, false)
    AND {O.sql_is_numeric('cantidad')} AND {O.sql_is_numeric('precio')}
    AND coalesce({O.sql_to_double('cantidad')} > 0 AND {O.sql_to_double('cantidad')} <= {S.QUANTITY_MAX}, false)
    AND coalesce({O.sql_to_double('precio')} > 0, false)
    AND (descuento IS NULL OR coalesce(descuento >= 0 AND descuento <= 100, false))
    AND NOT (producto IS NULL OR length({O.sql_strip('producto')}) = 0)
    AND NOT (ciudad IS NULL OR length({O.sql_strip('ciudad')}) = 0)) t""", views=("sales_raw",))
def src_jdbc_query(spark, d):
    """Load, then read back with SQL over the loaded table (temp view)."""
    out = _scratch(spark, "sales_sql")
    J.run_sales(spark, d, out, "r1")
    spark.read.parquet(f"{out}/ventas_clean").createOrReplaceTempView("ventas_clean_cargadas")
    return spark.sql("SELECT fuente, COUNT(*) AS total FROM ventas_clean_cargadas GROUP BY fuente")


@register("sink_predictions_json", f"""
SELECT 'CLIENTE' AS entidad, CAST(cliente_id AS VARCHAR) AS entidad_id, uso_datos_gb / 100.0 AS score,
  uso_datos_gb / 100.0 AS probabilidad, {O.sql_segment('uso_datos_gb / 100.0')} AS prediccion FROM portfolio""",
          views=("portfolio",))
def sink_predictions_json(spark, d):
    out = _scratch(spark, "predictions")
    p = T.portfolio(spark, d)
    prob = F.col("uso_datos_gb") / 100.0
    scored = p.select("cliente_id", prob.alias("prob_abandono"), R.risk_segment(prob).alias("segmento_riesgo"))
    W.write_predictions(W.prediction_records(scored), out)
    back = W.read_predictions(spark, out, limit=None)
    return back.select("entidad", "entidad_id", "score", "probabilidad", "prediccion")


@register("limit_predictions", f"""
SELECT 'CLIENTE' AS entidad, CAST(cliente_id AS VARCHAR) AS entidad_id, {O.sql_segment('uso_datos_gb / 100.0')}
  AS prediccion FROM portfolio ORDER BY cliente_id LIMIT 50""", views=("portfolio",))
def limit_predictions(spark, d):
    """The first 50 stored predictions in row order (the reader's default limit)."""
    out = _scratch(spark, "predictions_limit")
    p = T.portfolio(spark, d)
    prob = F.col("uso_datos_gb") / 100.0
    scored = p.select("cliente_id", prob.alias("prob_abandono"), R.risk_segment(prob).alias("segmento_riesgo"))
    W.write_predictions(W.prediction_records(scored), out)
    return W.read_predictions(spark, out, limit=50).select("entidad", "entidad_id", "prediccion")


@register("preview", """
SELECT * FROM (SELECT 'solicitudes' AS fuente, CAST(id AS VARCHAR) AS clave FROM requests ORDER BY id LIMIT 2)
UNION ALL SELECT * FROM (SELECT 'proveedores', CAST(id AS VARCHAR) FROM suppliers ORDER BY id LIMIT 2)
UNION ALL SELECT * FROM (SELECT 'cotizaciones', CAST(solicitud_id AS VARCHAR) FROM quotes
                         ORDER BY solicitud_id, linea, producto_id, proveedor_id LIMIT 2)""",
          views=("requests", "suppliers", "quotes"))
def preview(spark, d):
    """First two rows of each source (a top-k per source, explicit order)."""
    r = T.requests(spark, d).orderBy("id").limit(2).select(F.lit("solicitudes").alias("fuente"),
                                                            F.col("id").cast("string").alias("clave"))
    s = T.suppliers(spark, d).orderBy("id").limit(2).select(F.lit("proveedores").alias("fuente"),
                                                             F.col("id").cast("string").alias("clave"))
    q = (T.quotes(spark, d).orderBy("solicitud_id", "linea", "producto_id", "proveedor_id").limit(2)
         .select(F.lit("cotizaciones").alias("fuente"), F.col("solicitud_id").cast("string").alias("clave")))
    return r.unionByName(s).unionByName(q)


@register("job_sales", f"""
WITH f AS (
  SELECT coalesce({O.sql_to_date('fecha')} IS NOT NULL, false)
    AND {O.sql_is_numeric('cantidad')} AND {O.sql_is_numeric('precio')}
    AND coalesce({O.sql_to_double('cantidad')} > 0 AND {O.sql_to_double('cantidad')} <= {S.QUANTITY_MAX}, false)
    AND coalesce({O.sql_to_double('precio')} > 0, false)
    AND (descuento IS NULL OR coalesce(descuento >= 0 AND descuento <= 100, false))
    AND NOT (producto IS NULL OR length({O.sql_strip('producto')}) = 0)
    AND NOT (ciudad IS NULL OR length({O.sql_strip('ciudad')}) = 0) AS ok FROM (SELECT DISTINCT id, fecha, producto, cantidad, precio, ciudad, descuento FROM sales_raw
    WHERE id IS NOT NULL AND fecha IS NOT NULL AND producto IS NOT NULL AND cantidad IS NOT NULL AND precio IS NOT NULL
      AND ciudad IS NOT NULL AND {O.sql_to_double('precio')} IS NOT NULL AND {O.sql_to_double('cantidad')} IS NOT NULL
      AND {O.sql_to_date('fecha')} IS NOT NULL) c)
SELECT 'ventas_clean' AS tabla, count(*) FILTER (WHERE ok) AS filas FROM f
UNION ALL SELECT 'ventas_error', count(*) FILTER (WHERE NOT ok) FROM f""", views=("sales_raw",))
def job_sales(spark, d):
    return J.run_sales(spark, d, _scratch(spark, "job_sales"), "r1")


@register("job_procurement", """
SELECT 'proveedores' AS tabla, count(*) AS filas FROM suppliers
UNION ALL SELECT 'solicitudes', count(*) FROM requests
UNION ALL SELECT 'cotizaciones', count(*) FROM quotes
UNION ALL SELECT 'negociaciones', count(*) FROM negotiations""",
          views=("suppliers", "requests", "quotes", "negotiations"))
def job_procurement(spark, d):
    return J.run_procurement(spark, d, _scratch(spark, "job_procurement"), "r1", salt=O.DEMO_SALT)


@register("job_churn")
def job_churn(spark, d):
    return J.run_churn(spark, d, _scratch(spark, "job_churn"), "r1").drop("tiempo_entrenamiento_s")


@register("src_predictions", f"""
SELECT 'CLIENTE' AS entidad, CAST(cliente_id AS VARCHAR) AS entidad_id, uso_datos_gb / 100.0 AS probabilidad
FROM portfolio
UNION ALL
SELECT 'CSV', CAST(cliente_id AS VARCHAR), uso_datos_gb / 100.0 FROM portfolio""", views=("portfolio",))
def src_predictions(spark, d):
    """Newest predictions: the JSON records of the latest run, and — where a
    run has no JSON — the scored CSV fallback, both read in full."""
    base = _scratch(spark, "predictions_src")
    p = T.portfolio(spark, d)
    prob = F.col("uso_datos_gb") / 100.0
    scored = p.select("cliente_id", prob.alias("prob_abandono"), R.risk_segment(prob).alias("segmento_riesgo"))
    W.write_predictions(W.prediction_records(scored), f"{base}/run=r2")
    csv = f"{base}/scored_csv"
    W.write_csv(scored, csv)
    from_json = W.read_predictions(spark, f"{base}/run=r2", limit=None).select(
        "entidad", "entidad_id", "probabilidad")
    from_csv = W.read_predictions(spark, f"{base}/run=missing", limit=None, csv_fallback=csv,
                                  csv_schema="cliente_id bigint, prob_abandono double, segmento_riesgo string")
    return from_json.unionByName(from_csv.select(
        F.lit("CSV").alias("entidad"), F.col("cliente_id").cast("string").alias("entidad_id"),
        F.col("prob_abandono").alias("probabilidad")))
