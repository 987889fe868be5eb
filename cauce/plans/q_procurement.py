"""Procurement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.operators import procurement as P
from cauce.operators.quality import exact_quantiles
from cauce.plans import oracle as O
from cauce.plans.registry import register
from cauce.sources import tables as T

_BEST_PER_REQUEST_SQL = """
best AS (
  SELECT solicitud_id, proveedor_id, precio_total FROM (
    SELECT solicitud_id, proveedor_id, precio_total,
      row_number() OVER (PARTITION BY solicitud_id
                         ORDER BY precio_total, linea, producto_id, proveedor_id) AS rn
    FROM quotes) t WHERE rn = 1)"""


@register("join_best_quote", f"""
WITH {_BEST_PER_REQUEST_SQL}
SELECT r.*, {O.sql_urgency_category('r.urgencia')} AS urgencia_categoria,
  b.proveedor_id AS mejor_proveedor_id, s.nombre AS mejor_proveedor,
  b.precio_total AS mejor_precio,
  round((r.presupuesto_max - b.precio_total) / r.presupuesto_max * 100, 2) AS ahorro_pct
FROM requests r LEFT JOIN best b ON r.id = b.solicitud_id
LEFT JOIN suppliers s ON s.id = b.proveedor_id""", views=("requests", "quotes", "suppliers"))
def join_best_quote(spark, d):
    return P.enrich_requests(T.requests(spark, d), T.quotes(spark, d), T.suppliers(spark, d))


@register("win_distinct_on", f"""
WITH {_BEST_PER_REQUEST_SQL}
SELECT solicitud_id, proveedor_id, precio_total FROM best""", views=("quotes",))
def win_distinct_on(spark, d):
    return P.best_quote(T.quotes(spark, d), "solicitud_id")


@register("win_best_per_product", """
SELECT producto_id, proveedor_id AS mejor_proveedor_id, precio_total AS mejor_precio FROM (
  SELECT producto_id, proveedor_id, precio_total,
    row_number() OVER (PARTITION BY producto_id
                       ORDER BY precio_total, linea, producto_id, proveedor_id) AS rn
  FROM quotes) t WHERE rn = 1""", views=("quotes",))
def win_best_per_product(spark, d):
    return P.best_quote_per_product(T.quotes(spark, d))


@register("map_urgency", f"""
SELECT id, urgencia, {O.sql_urgency_category('urgencia')} AS urgencia_categoria FROM requests""",
          views=("requests",))
def map_urgency(spark, d):
    return T.requests(spark, d).select("id", "urgencia", R.urgency_category("urgencia").alias("urgencia_categoria"))


@register("agg_urgency_counts", f"""
SELECT {O.sql_urgency_category('urgencia')} AS urgencia_categoria, count(*) AS n
FROM requests GROUP BY 1""", views=("requests",))
def agg_urgency_counts(spark, d):
    r = T.requests(spark, d).select(R.urgency_category("urgencia").alias("urgencia_categoria"))
    return P.value_counts(r, "urgencia_categoria")


@register("bucket_lead_time", f"""
SELECT solicitud_id, linea, producto_id, proveedor_id, plazo_dias,
  {O.sql_right_closed('plazo_dias', R.LEAD_TIME_BINS)} AS plazo_categoria FROM quotes""",
          views=("quotes",))
def bucket_lead_time(spark, d):
    q = T.quotes(spark, d)
    return q.select("solicitud_id", "linea", "producto_id", "proveedor_id", "plazo_dias",
                    R.lead_time_bucket("plazo_dias").alias("plazo_categoria"))


@register("bucket_risk", f"""
SELECT {O.sql_right_closed('risk_score', R.RISK_BINS)} AS nivel_riesgo, count(*) AS n
FROM quotes GROUP BY 1""", views=("quotes",))
def bucket_risk(spark, d):
    q = T.quotes(spark, d).select(R.risk_level("risk_score").alias("nivel_riesgo"))
    return q.groupBy("nivel_riesgo").agg(F.count(F.lit(1)).alias("n"))


@register("impute_median_price", """
SELECT solicitud_id, linea, producto_id, proveedor_id,
  coalesce(precio_total, (SELECT median(precio_total) FROM quotes)) AS precio_total FROM quotes""",
          views=("quotes",))
def impute_median_price(spark, d):
    q = T.quotes(spark, d)
    med = exact_quantiles(q, "precio_total", [0.5])[0.5]
    return q.select("solicitud_id", "linea", "producto_id", "proveedor_id",
                    F.coalesce(F.col("precio_total"), F.lit(med)).alias("precio_total"))


@register("scale_minmax", """
WITH f AS (SELECT solicitud_id, linea, producto_id, proveedor_id,
             coalesce(precio_total, (SELECT median(precio_total) FROM quotes)) AS precio_total FROM quotes),
     s AS (SELECT min(precio_total) AS lo, max(precio_total) AS hi FROM f)
SELECT f.*, CASE WHEN s.hi = s.lo THEN 0.0 ELSE (f.precio_total - s.lo) / (s.hi - s.lo) END AS precio_norm
FROM f, s""", views=("quotes",))
def scale_minmax(spark, d):
    q = T.quotes(spark, d).select("solicitud_id", "linea", "producto_id", "proveedor_id", "precio_total")
    return P.normalize_prices(q)


@register("savings_pct", f"""
WITH {_BEST_PER_REQUEST_SQL}
SELECT r.id, round((r.presupuesto_max - b.precio_total) / r.presupuesto_max * 100, 2) AS ahorro_pct
FROM requests r LEFT JOIN best b ON r.id = b.solicitud_id""", views=("requests", "quotes"))
def savings_pct(spark, d):
    return P.enrich_requests(T.requests(spark, d), T.quotes(spark, d)).select("id", "ahorro_pct")


@register("val_price_range", f"""
SELECT solicitud_id, linea, producto_id, proveedor_id, producto, precio_total,
  {O.sql_price_in_range('precio_total', 'producto')} AS precio_valido FROM quotes""",
          views=("quotes",))
def val_price_range(spark, d):
    q = T.quotes(spark, d)
    return q.select("solicitud_id", "linea", "producto_id", "proveedor_id", "producto", "precio_total",
                    R.price_in_range("precio_total", "producto").alias("precio_valido"))


@register("join_rule_table", f"""
SELECT solicitud_id, linea, producto_id, proveedor_id, producto, precio_total,
  {O.sql_price_in_range('precio_total', 'producto')} AS precio_valido FROM quotes""",
          views=("quotes",))
def join_rule_table(spark, d):
    q = T.quotes(spark, d).select("solicitud_id", "linea", "producto_id", "proveedor_id", "producto",
                                  "precio_total")
    return P.price_check_by_rule_table(q, R.price_rule_table(spark))


@register("agg_quotes_by_supplier", """
SELECT proveedor_nombre, count(*) AS cotizaciones FROM quotes_named
WHERE proveedor_nombre IS NOT NULL GROUP BY proveedor_nombre""", views=("quotes_named",))
def agg_quotes_by_supplier(spark, d):
    return P.quotes_by_named_supplier(T.quotes(spark, d), T.suppliers(spark, d))


@register("src_quotes", """
SELECT proveedor_id, proveedor_nombre, producto, precio_total, plazo_dias, garantia_meses,
  risk_score, 'Cotizacion: ' || producto AS email_asunto, "timestamp"
FROM quotes_named""", views=("quotes_named",))
def src_quotes(spark, d):
    q = T.quotes(spark, d, with_names=True)
    return q.select("proveedor_id", "proveedor_nombre", "producto", "precio_total", "plazo_dias",
                    "garantia_meses", "risk_score",
                    F.concat(F.lit("Cotizacion: "), F.col("producto")).alias("email_asunto"), "timestamp")


@register("join_update_best", f"""
WITH {_BEST_PER_REQUEST_SQL}
SELECT r.id, r.estado,
  CASE WHEN b.solicitud_id IS NOT NULL THEN b.proveedor_id END AS proveedor_elegido_id,
  CASE WHEN b.solicitud_id IS NOT NULL
       THEN round((r.presupuesto_max - b.precio_total) / r.presupuesto_max * 100, 2)
       ELSE 0.0 END AS ahorro_conseguido
FROM requests r LEFT JOIN best b ON r.id = b.solicitud_id""", views=("requests", "quotes"))
def join_update_best(spark, d):
    r = T.requests(spark, d).select("id", "estado", "presupuesto_max")
    return P.apply_best_quote_update(r, T.quotes(spark, d)).drop("presupuesto_max")


@register("update_status", f"""
WITH {_BEST_PER_REQUEST_SQL}
SELECT r.id,
  CASE WHEN r.estado = 'pendiente' AND b.proveedor_id IS NOT NULL THEN 'completada'
       ELSE r.estado END AS estado
FROM requests r LEFT JOIN best b ON r.id = b.solicitud_id""", views=("requests", "quotes"))
def update_status(spark, d):
    r = T.requests(spark, d).select("id", "estado", "presupuesto_max")
    return P.complete_status(P.apply_best_quote_update(r, T.quotes(spark, d))).select("id", "estado")


@register("stream_quote_rules_batch", f"""
SELECT solicitud_id, linea, producto_id, proveedor_id,
  {O.sql_right_closed('plazo_dias', R.LEAD_TIME_BINS)} AS plazo_categoria,
  {O.sql_right_closed('risk_score', R.RISK_BINS)} AS nivel_riesgo,
  {O.sql_price_in_range('precio_total', 'producto')} AS precio_valido,
  'Cotizacion: ' || producto AS email_asunto
FROM quotes""", views=("quotes",))
def quote_rules(spark, d):
    q = P.classify_quotes(T.quotes(spark, d))
    return q.select("solicitud_id", "linea", "producto_id", "proveedor_id", "plazo_categoria",
                    "nivel_riesgo", "precio_valido", "email_asunto")
