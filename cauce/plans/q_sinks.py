"""Sink queries and stage compositions (§2.14): each writes
driver-derived rows through the sink under test and reads them back."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.operators import churn as C
from cauce.operators import kpi as K
from cauce.operators import privacy as PV
from cauce.plans import jobs as J
from cauce.plans import oracle as O
from cauce.plans.q_io import _scratch
from cauce.plans.q_kpi import _BEST, _REPORT_CTE, _VIEWS, kpi_report_df
from cauce.plans.q_metrics import _model_rows, _model_sql
from cauce.plans.registry import register
from cauce.sinks import writers as W
from cauce.sources import files as FS
from cauce.sources import tables as T

_SEG_P = O.sql_segment("uso_datos_gb / 100.0")


def _scored_portfolio(spark, d):
    p = T.portfolio(spark, d)
    prob = F.col("uso_datos_gb") / 100.0
    return p.select("cliente_id", *T.FEATURES, T.TARGET, F.round(prob, 4).alias("prob_abandono"),
                    R.risk_segment(prob).alias("segmento_riesgo")).withColumn(
        "accion_retencion", R.retention_action("segmento_riesgo"))


_SCORED_SQL = f"""scored AS (
  SELECT cliente_id, {", ".join(T.FEATURES)}, {T.TARGET}, round(uso_datos_gb / 100.0, 4) AS prob_abandono,
    {_SEG_P} AS segmento_riesgo, {O.sql_action(_SEG_P)} AS accion_retencion FROM portfolio)"""
_SCORED_SCHEMA = ("cliente_id bigint, edad int, anos_cliente int, uso_datos_gb double, llamadas_mes int, "
                  "reclamos int, plan_premium int, abandona int, prob_abandono double, segmento_riesgo string, "
                  "accion_retencion string")


@register("sink_csv", f"WITH {_SCORED_SQL} SELECT * FROM scored", views=("portfolio",))
def sink_csv(spark, d):
    path = _scratch(spark, "scored_csv")
    W.write_csv(_scored_portfolio(spark, d), path)
    return FS.read_csv_strict(spark, path, _SCORED_SCHEMA)


@register("src_scored_csv", f"""
WITH {_SCORED_SQL} SELECT count(*) FILTER (WHERE segmento_riesgo = 'ALTO') AS clientes_alto_riesgo,
  round(count(*) FILTER (WHERE segmento_riesgo = 'ALTO') / CAST(greatest(count(*), 1) AS DOUBLE) * 100, 2)
    AS tasa_riesgo_alto FROM scored""", views=("portfolio",))
def src_scored_csv(spark, d):
    """KPIs re-read from the scored CSV."""
    path = _scratch(spark, "scored_csv_kpi")
    W.write_csv(_scored_portfolio(spark, d), path)
    return K.high_risk(FS.read_csv_tolerant(spark, path, _SCORED_SCHEMA))


@register("sink_layout", f"""
WITH {_SCORED_SQL} SELECT cliente_id, prob_abandono FROM scored WHERE segmento_riesgo = 'ALTO'""",
          views=("portfolio",))
def sink_layout(spark, d):
    """Scored rows partitioned by segment; reading one segment prunes the rest."""
    path = _scratch(spark, "scored_layout")
    W.write_version(_scored_portfolio(spark, d), path, "r1", partition_by="segmento_riesgo")
    back = W.read_latest(spark, path)
    return back.filter(F.col("segmento_riesgo") == "ALTO").select("cliente_id", "prob_abandono")


@register("sink_append", f"""
WITH {_SCORED_SQL} SELECT segmento_riesgo, 2 * count(*) AS filas FROM scored GROUP BY 1""", views=("portfolio",))
def sink_append(spark, d):
    """Two runs appended to the same table; both are kept (run partitions), and
    running the second one again does not double it."""
    path = _scratch(spark, "scored_append")
    s = _scored_portfolio(spark, d)
    W.append(s, path, "r1")
    W.append(s, path, "r2")
    W.append(s, path, "r2")
    return spark.read.parquet(path).groupBy("segmento_riesgo").agg(F.count(F.lit(1)).alias("filas"))


@register("sink_if_empty", "SELECT count(*) AS filas FROM suppliers", views=("suppliers",))
def sink_if_empty(spark, d):
    """Load only when the table is empty: the second load is skipped."""
    path = _scratch(spark, "if_empty")
    s = T.suppliers(spark, d)
    first = W.append_if_empty(s, path, "r1")
    second = W.append_if_empty(s, path, "r2")
    assert first and not second
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("filas"))


@register("sink_audit", """
SELECT 'SEUDONIMIZAR' AS accion, 'cauce.plans.q_sinks' AS modulo, 'proveedores.rut' AS tabla,
  count(*) AS filas, 'metodo=SHA256+sal' AS extra FROM suppliers""", views=("suppliers",))
def sink_audit(spark, d):
    path = _scratch(spark, "audit")
    s = PV.add_rut_hash(T.suppliers(spark, d), O.DEMO_SALT)
    rec = PV.audit_record(spark, "SEUDONIMIZAR", "cauce.plans.q_sinks", "proveedores.rut",
                          s.agg(F.count(F.lit(1))).scalar(), "metodo=SHA256+sal")
    W.append(rec, path, "r1")
    return spark.read.parquet(path).select("accion", "modulo", "tabla", "filas", "extra")


@register("sink_kpi", f"WITH {_BEST}, {_REPORT_CTE} SELECT * FROM report", views=_VIEWS)
def sink_kpi(spark, d):
    path = _scratch(spark, "kpi")
    W.append(kpi_report_df(spark, d), path, "r1")
    return spark.read.parquet(path).select("kpi", "valor", "texto")


_MT_COLS = "modelo, accuracy, precision, recall, f1, roc_auc, gini"


@register("sink_model_table", f"SELECT {_MT_COLS} FROM ({_model_sql()}) t", views=("scored_lines",))
def sink_model_table(spark, d):
    path = _scratch(spark, "model_table")
    W.write_csv(_model_rows(spark, d).drop("orden").coalesce(1), path)
    return FS.read_csv_strict(spark, path, "modelo string, accuracy double, precision double, recall double, "
                                           "f1 double, roc_auc double, gini double")


@register("sink_append_metrics", f"""
SELECT accuracy, recall, precision, f1, roc_auc, gini, modelo FROM ({_model_sql()}) t
ORDER BY recall DESC, f1 DESC, orden LIMIT 1""", views=("scored_lines",))
def sink_append_metrics(spark, d):
    """One run's selected-model metrics appended to ``ml_metricas``."""
    path = _scratch(spark, "ml_metricas")
    best = _model_rows(spark, d).orderBy(F.desc("recall"), F.desc("f1"), F.asc("orden")).limit(1)
    row = best.select(F.current_timestamp().alias("ts"), "accuracy", "recall", "precision", "f1", "roc_auc",
                      "gini", "modelo")
    W.append(row, path, "r1")
    return spark.read.parquet(path).drop("ts", "run")


def _write_metrics_doc(spark, d) -> str:
    """The metrics document (nested: map of models) written as one JSON row."""
    path = _scratch(spark, "metrics_doc")
    t = _model_rows(spark, d)
    best = t.orderBy(F.desc("recall"), F.desc("f1"), F.asc("orden")).limit(1).select("modelo")
    per_model = t.agg(F.map_from_entries(F.collect_list(F.struct(
        "modelo", F.struct("accuracy", "precision", "recall", "f1", "roc_auc", "gini")))).alias("m"))
    doc = best.select(F.col("modelo").alias("modelo_seleccionado"),
                      F.lit(C.SELECTION_RULE).alias("criterio_seleccion"),
                      per_model.select("m").scalar().alias("metricas_por_modelo"))
    W.write_json(doc.coalesce(1), path)
    return path


_BEST_DOC_SQL = f"""
SELECT modelo AS modelo_seleccionado, recall, gini FROM ({_model_sql()}) t
ORDER BY recall DESC, f1 DESC, orden LIMIT 1"""


@register("sink_metrics_json", _BEST_DOC_SQL, views=("scored_lines",))
def sink_metrics_json(spark, d):
    path = _write_metrics_doc(spark, d)
    back = spark.read.schema("modelo_seleccionado string, criterio_seleccion string, metricas_por_modelo "
                             "map<string, struct<accuracy:double, precision:double, recall:double, f1:double, "
                             "roc_auc:double, gini:double>>").json(path)
    m = back.select("modelo_seleccionado", F.col("metricas_por_modelo")[F.col("modelo_seleccionado")].alias("x"))
    return m.select("modelo_seleccionado", "x.recall", "x.gini")


@register("src_metrics_doc", _BEST_DOC_SQL, views=("scored_lines",))
def src_metrics_doc(spark, d):
    """Read the latest metrics document with the declared schema; a missing
    document reads as an empty frame (no rows, same columns)."""
    found = W.read_metrics_doc(spark, _write_metrics_doc(spark, d))
    missing = W.read_metrics_doc(spark, _scratch(spark, "no_doc"))
    both = found.unionByName(missing)
    m = both.select("modelo_seleccionado", F.col("metricas_por_modelo")[F.col("modelo_seleccionado")].alias("x"))
    return m.select("modelo_seleccionado", "x.recall", "x.gini")


@register("sink_append_predictions", f"""
SELECT 'CLIENTE' AS entidad, CAST(cliente_id AS VARCHAR) AS entidad_id, round(uso_datos_gb / 100.0, 4) AS score,
  {_SEG_P} AS prediccion FROM portfolio""", views=("portfolio",))
def sink_append_predictions(spark, d):
    path = _scratch(spark, "ml_predicciones")
    rec = W.prediction_records(_scored_portfolio(spark, d))
    W.append(rec.withColumn("ts", F.current_timestamp()), path, "r1")
    return spark.read.parquet(path).select("entidad", "entidad_id", "score", "prediccion")


@register("sink_model")
def sink_model(spark, d):
    """Save the trained pipeline, load it back and score with the loaded copy."""
    from cauce.plans.q_churn import trained
    t = trained(spark, d)
    path = _scratch(spark, "model")
    C.save_model(t["best_model"], path, T.FEATURES, t["params"], t["scaled"], t["fills"])
    m, prep = C.load_model(path)
    return C.score(T.portfolio(spark, d), m, prep["features"], prep["params"], prep["scaled"], prep["fills"]).groupBy(
        "segmento_riesgo").agg(F.count(F.lit(1)).alias("clientes"))


@register("tag_now", "SELECT count(*) AS filas, 1 AS sellos, count(*) AS textos_iguales, TRUE AS reciente FROM requests",
          views=("requests",))
def tag_now(spark, d):
    """Rows stamped with the run timestamp and its text form, reduced to what must hold:
    one stamp for all rows, a text equal to it, and a time of this hour."""
    stamped = T.requests(spark, d).select("id").withColumn("ts", F.current_timestamp()).withColumn(
        "ts_texto", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    same = F.to_timestamp("ts_texto", "yyyy-MM-dd HH:mm:ss") == F.date_trunc("second", "ts")
    started = F.lit(datetime.datetime.now(datetime.timezone.utc))
    return stamped.agg(F.count(F.lit(1)).alias("filas"), F.count_distinct("ts").cast("int").alias("sellos"),
                       F.count_if(same).alias("textos_iguales"),
                       (F.abs(F.unix_timestamp(F.max("ts")) - F.unix_timestamp(started)) < 3600).alias("reciente"))


@register("agg_load_summary", """
WITH c AS (SELECT 'proveedores' AS tabla, count(*) AS filas FROM suppliers
  UNION ALL SELECT 'solicitudes', count(*) FROM requests
  UNION ALL SELECT 'cotizaciones', count(*) FROM quotes
  UNION ALL SELECT 'negociaciones', count(*) FROM negotiations)
SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(filas) AS BIGINT) FROM c""",
          views=("suppliers", "requests", "quotes", "negotiations"))
def agg_load_summary(spark, d):
    s = J.run_procurement(spark, d, _scratch(spark, "load_summary"), "r1", salt=O.DEMO_SALT)
    return s.unionByName(s.agg(F.lit("total").alias("tabla"), F.sum("filas").alias("filas")))


_SUPPLIER_NAMED = ("(SELECT q.*, s.s_name AS proveedor_nombre FROM quotes q LEFT JOIN supplier s "
                   "ON q.proveedor_id = s.s_suppkey)")


@register("transform_all", f"""
WITH best AS (
  SELECT solicitud_id, proveedor_id, precio_total FROM (
    SELECT solicitud_id, proveedor_id, precio_total,
      row_number() OVER (PARTITION BY solicitud_id ORDER BY precio_total, linea, producto_id, proveedor_id) AS rn
    FROM quotes) t WHERE rn = 1),
b AS (SELECT min(precio_total) AS lo, max(precio_total) AS hi FROM quotes)
SELECT 'solicitud' AS fuente, CAST(r.id AS VARCHAR) AS clave, {O.sql_urgency_category('r.urgencia')} AS texto,
  round(b.precio_total, 2) AS v1, round((r.presupuesto_max - b.precio_total) / r.presupuesto_max * 100, 2) AS v2, 1 AS n
FROM requests r LEFT JOIN best b ON r.id = b.solicitud_id
UNION ALL
SELECT 'cotizacion', CAST(solicitud_id AS VARCHAR), {O.sql_right_closed('plazo_dias', R.LEAD_TIME_BINS)},
  round(min((precio_total - lo) / (hi - lo)), 6), round(max((precio_total - lo) / (hi - lo)), 6), count(*)
FROM quotes, b GROUP BY 2, 3
UNION ALL
SELECT 'resumen', proveedor_nombre, NULL, NULL, NULL, count(*) FROM {_SUPPLIER_NAMED} x
WHERE proveedor_nombre IS NOT NULL GROUP BY proveedor_nombre""", views=("requests", "quotes"))
def transform_all(spark, d):
    """All outputs of the transform stage: requests, quotes (scaled price, lead-time band) and supplier counts."""
    store = {"Solicitudes": T.requests(spark, d), "Cotizaciones": T.quotes(spark, d),
             "Proveedores": T.suppliers(spark, d)}
    out = J.transform_all(store)
    none = F.lit(None)
    req = out["Solicitudes"].select(
        F.lit("solicitud").alias("fuente"), F.col("id").cast("string").alias("clave"), F.col("urgencia_categoria").alias("texto"),
        F.round("mejor_precio", 2).alias("v1"), F.col("ahorro_pct").alias("v2"), F.lit(1).cast("bigint").alias("n"))
    quo = (out["Cotizaciones"].groupBy(F.col("solicitud_id").cast("string").alias("clave"), F.col("plazo_categoria").alias("texto"))
           .agg(F.round(F.min("precio_norm"), 6).alias("v1"), F.round(F.max("precio_norm"), 6).alias("v2"),
                F.count(F.lit(1)).alias("n")).withColumn("fuente", F.lit("cotizacion")))
    res = out["Resumen_Cotizaciones"].select(
        F.lit("resumen").alias("fuente"), F.col("proveedor_nombre").alias("clave"), none.cast("string").alias("texto"),
        none.cast("double").alias("v1"), none.cast("double").alias("v2"), F.col("cotizaciones").alias("n"))
    return req.unionByName(quo).unionByName(res)


@register("validate_all", f"""
SELECT {O.sql_right_closed('risk_score', R.RISK_BINS)} AS nivel_riesgo,
  {O.sql_price_in_range('precio_total', 'producto')} AS precio_valido, count(*) AS n
FROM quotes GROUP BY 1, 2""", views=("quotes",))
def validate_all(spark, d):
    out = J.validate_all({"Cotizaciones": T.quotes(spark, d), "Proveedores": T.suppliers(spark, d)})
    return out["Cotizaciones"].groupBy("nivel_riesgo", "precio_valido").agg(F.count(F.lit(1)).alias("n"))


@register("load_all", """
WITH best AS (
  SELECT solicitud_id, proveedor_id FROM (
    SELECT solicitud_id, proveedor_id,
      row_number() OVER (PARTITION BY solicitud_id ORDER BY precio_total, linea, producto_id, proveedor_id) AS rn
    FROM quotes) t WHERE rn = 1)
SELECT CASE WHEN r.estado = 'pendiente' AND b.proveedor_id IS NOT NULL THEN 'completada' ELSE r.estado END
  AS estado, count(*) AS n
FROM requests r LEFT JOIN best b ON r.id = b.solicitud_id GROUP BY 1""", views=("requests", "quotes"))
def load_all(spark, d):
    out_dir = _scratch(spark, "load_all")
    store = {"Solicitudes": T.requests(spark, d), "Cotizaciones": T.quotes(spark, d)}
    J.load_all(store, out_dir, "r1")
    loaded = W.read_latest(spark, f"{out_dir}/solicitudes")
    return loaded.groupBy("estado").agg(F.count(F.lit(1)).alias("n"))
