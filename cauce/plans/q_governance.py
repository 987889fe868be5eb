"""Privacy and table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.operators import maintenance as MT
from cauce.operators import privacy as PV
from cauce.plans import oracle as O
from cauce.plans.registry import register
from cauce.sources import tables as T


@register("val_rut", f"""
SELECT id, rut, coalesce(regexp_matches({O.sql_strip('rut')}, '{R.RUT_PATTERN_ENGINE}'), false) AS rut_valido
FROM suppliers""", views=("suppliers",))
def val_rut(spark, d):
    s = T.suppliers(spark, d)
    return s.select("id", "rut", R.rut_is_valid("rut").alias("rut_valido"))


@register("agg_rut_valid", f"""
SELECT count(*) FILTER (WHERE coalesce(regexp_matches({O.sql_strip('rut')}, '{R.RUT_PATTERN_ENGINE}'), false))
  AS ruts_validos, count(*) AS proveedores FROM suppliers""", views=("suppliers",))
def agg_rut_valid(spark, d):
    s = T.suppliers(spark, d)
    return s.agg(F.count_if(R.rut_is_valid("rut")).alias("ruts_validos"),
                 F.count(F.lit(1)).alias("proveedores"))


@register("mask_pseudonym", f"""
SELECT {O.sql_pseudonym('cliente_id')} AS cliente_id, edad, reclamos FROM portfolio""", views=("portfolio",))
def mask_pseudonym(spark, d):
    p = T.portfolio(spark, d).select("cliente_id", "edad", "reclamos")
    return PV.pseudonymize(p, ["cliente_id"], O.DEMO_SALT)


@register("mask_rut", f"""
SELECT *, {O.sql_pseudonym('rut')} AS rut_hash FROM suppliers""", views=("suppliers",))
def mask_rut(spark, d):
    return PV.add_rut_hash(T.suppliers(spark, d), O.DEMO_SALT)


@register("mask_age_band", f"""
SELECT {O.sql_age_band('edad')} AS rango_edad, count(*) AS n FROM portfolio GROUP BY 1""", views=("portfolio",))
def mask_age_band(spark, d):
    p = T.portfolio(spark, d).select(R.age_band("edad").alias("rango_edad"))
    return p.groupBy("rango_edad").agg(F.count(F.lit(1)).alias("n"))


_SCORED_PORTFOLIO = f"""
sp AS (SELECT cliente_id, edad, reclamos, uso_datos_gb / 100.0 AS prob_abandono,
  {O.sql_segment('uso_datos_gb / 100.0')} AS segmento_riesgo FROM portfolio)"""


def _scored_portfolio(spark, d):
    p = T.portfolio(spark, d)
    prob = F.col("uso_datos_gb") / 100.0
    return p.select("cliente_id", "edad", "reclamos", prob.alias("prob_abandono"),
                    R.risk_segment(prob).alias("segmento_riesgo"))


def _role_query(role):
    def q(spark, d):
        return PV.role_view(_scored_portfolio(spark, d), role)
    return q


for _role, _perm in PV.ROLES.items():
    _age = "edad" if _perm["ver_sensibles"] else f"{O.sql_age_band('edad')} AS edad"
    _score = ", prob_abandono, segmento_riesgo" if _perm["ver_scoring"] else ""
    register(f"role_view_{_role}", f"WITH {_SCORED_PORTFOLIO} SELECT cliente_id, {_age}, reclamos{_score} FROM sp",
             views=("portfolio",))(_role_query(_role))


@register("join_fk_check", """
SELECT 'cotizaciones.solicitud_id' AS fk, count(*) AS huerfanos FROM quotes q
  WHERE q.solicitud_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM requests r WHERE r.id = q.solicitud_id)
UNION ALL
SELECT 'cotizaciones.proveedor_id', count(*) FROM quotes q
  WHERE q.proveedor_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM suppliers s WHERE s.id = q.proveedor_id)
UNION ALL
SELECT 'solicitudes.solicitante_id', count(*) FROM requests r
  WHERE r.solicitante_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = r.solicitante_id)
""", views=("quotes", "requests", "suppliers"))
def join_fk_check(spark, d):
    q, r, s = T.quotes(spark, d), T.requests(spark, d), T.suppliers(spark, d)
    c = T.table(spark, d, "customer")
    return MT.fk_report([
        ("cotizaciones.solicitud_id", q, "solicitud_id", r, "id"),
        ("cotizaciones.proveedor_id", q, "proveedor_id", s, "id"),
        ("solicitudes.solicitante_id", r, "solicitante_id", c, "c_custkey"),
    ])


@register("join_insert_ignore", """
WITH target AS (SELECT * FROM suppliers WHERE categoria_id < 12),
inc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rut ORDER BY id) AS rn
                       FROM suppliers WHERE rut IS NOT NULL) t WHERE rn = 1)
SELECT id, nombre, rut, email, categoria_id, reputacion_score FROM target
UNION ALL
SELECT id, nombre, rut, email, categoria_id, reputacion_score FROM inc
WHERE NOT EXISTS (SELECT 1 FROM target WHERE target.rut = inc.rut)""", views=("suppliers",))
def join_insert_ignore(spark, d):
    """The catalogue already holds the suppliers of nations 0-11; the whole
    catalogue is re-sent and inserted with ON CONFLICT (rut) DO NOTHING."""
    s = T.suppliers(spark, d)
    return MT.insert_ignore(s.filter(F.col("categoria_id") < 12), s, "rut", ["id"])


_LOAD_TS = "2026-01-01 00:00:00"


@register("join_upsert", f"""
WITH target AS (SELECT cliente_id, edad, reclamos, 0.0 AS prob_abandono,
                  CAST(TIMESTAMP '2025-01-01 00:00:00' AS TIMESTAMP) AS fecha_carga
                FROM portfolio),
source AS (SELECT cliente_id, edad, reclamos, uso_datos_gb / 100.0 AS prob_abandono,
             CAST(TIMESTAMP '{_LOAD_TS}' AS TIMESTAMP) AS fecha_carga FROM portfolio WHERE plan_premium = 1)
SELECT * FROM target WHERE NOT EXISTS (SELECT 1 FROM source WHERE source.cliente_id = target.cliente_id)
UNION ALL SELECT * FROM source""", views=("portfolio",))
def join_upsert(spark, d):
    """Last load scored every customer with 0; this load re-scores the
    premium customers and upserts them on cliente_id, stamping fecha_carga."""
    p = T.portfolio(spark, d)
    target = p.select("cliente_id", "edad", "reclamos", F.lit(0.0).alias("prob_abandono"),
                      F.lit("2025-01-01 00:00:00").cast("timestamp_ntz").alias("fecha_carga"))
    source = p.filter(F.col("plan_premium") == 1).select(
        "cliente_id", "edad", "reclamos", (F.col("uso_datos_gb") / 100.0).alias("prob_abandono"))
    return MT.upsert(target, source, "cliente_id", "fecha_carga", F.lit(_LOAD_TS).cast("timestamp_ntz"))


@register("win_row_id", """
SELECT row_number() OVER (ORDER BY id) AS fila, id, estado FROM requests""", views=("requests",))
def win_row_id(spark, d):
    r = T.requests(spark, d).select("id", "estado")
    return MT.sequential_ids(r, ["id"], col="fila")


@register("map_entity", f"""
WITH p AS (SELECT CASE WHEN cliente_id % 50 = 0 THEN NULL ELSE 'C-' || CAST(cliente_id AS VARCHAR) END AS cliente_id,
  uso_datos_gb / 100.0 AS prob, {O.sql_segment('uso_datos_gb / 100.0')} AS prediccion, cliente_id AS orden FROM portfolio),
n AS (SELECT *, row_number() OVER (ORDER BY cliente_id IS NULL, cliente_id, orden) AS fila FROM p)
SELECT fila, 'CLIENTE' AS entidad, coalesce(cliente_id, CAST(fila AS VARCHAR)) AS entidad_id, prob AS score,
  prob AS probabilidad, prediccion FROM n""",
          views=("portfolio",))
def map_entity(spark, d):
    """Text ids; every fiftieth customer has none and is named by its row number."""
    from cauce.sinks.writers import prediction_records
    p = T.portfolio(spark, d)
    prob = F.col("uso_datos_gb") / 100.0
    ident = F.when(F.col("cliente_id") % 50 != 0, F.concat(F.lit("C-"), F.col("cliente_id").cast("string")))
    scored = p.select(ident.alias("cliente_id"), F.col("cliente_id").alias("orden"), prob.alias("prob_abandono"),
                      R.risk_segment(prob).alias("segmento_riesgo"))
    return prediction_records(scored)


_SOLICITUDES_SPEC = [
    MT.ColumnSpec("id", "bigint", nullable=False, unique=True),
    MT.ColumnSpec("presupuesto_max", "double", nullable=False),
    MT.ColumnSpec("urgencia", "string", default="normal"),
    MT.ColumnSpec("estado", "string", default="pendiente"),
    MT.ColumnSpec("proveedor_elegido_id", "bigint"),
    MT.ColumnSpec("ahorro_conseguido", "double", default=0.0),
    MT.ColumnSpec("prob_abandono", "double", default=0.0),
    MT.ColumnSpec("segmento_riesgo", "string", default="BAJO"),
    MT.ColumnSpec("accion_retencion", "string", default="Monitoreo estándar"),
]


@register("sink_table_schema", """
SELECT id, presupuesto_max, coalesce(urgencia, 'normal') AS urgencia, coalesce(estado, 'pendiente') AS estado,
  CAST(NULL AS BIGINT) AS proveedor_elegido_id, CAST(0.0 AS DOUBLE) AS ahorro_conseguido,
  CAST(0.0 AS DOUBLE) AS prob_abandono,
  'BAJO' AS segmento_riesgo, 'Monitoreo estándar' AS accion_retencion FROM requests""", views=("requests",))
def sink_table_schema(spark, d):
    return MT.conform(T.requests(spark, d), _SOLICITUDES_SPEC)


_COTIZACIONES_SPEC = [
    MT.ColumnSpec("solicitud_id", "bigint", nullable=False),
    MT.ColumnSpec("proveedor_id", "bigint", nullable=False),
    MT.ColumnSpec("precio_total", "double", nullable=False),
    MT.ColumnSpec("linea", "int"),
]


@register("check_constraints", """
SELECT 'NOT NULL' AS restriccion, 'solicitud_id' AS columna, count(*) FILTER (WHERE solicitud_id IS NULL)
  AS violaciones FROM quotes
UNION ALL SELECT 'NOT NULL', 'proveedor_id', count(*) FILTER (WHERE proveedor_id IS NULL) FROM quotes
UNION ALL SELECT 'NOT NULL', 'precio_total', count(*) FILTER (WHERE precio_total IS NULL) FROM quotes
UNION ALL SELECT 'UNIQUE', 'solicitud_id,linea', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (
  SELECT count(*) AS n FROM quotes WHERE solicitud_id IS NOT NULL AND linea IS NOT NULL
  GROUP BY solicitud_id, linea HAVING count(*) > 1) t""", views=("quotes",))
def check_constraints(spark, d):
    """NOT NULL and UNIQUE (request, line) checks of the quotes table."""
    q = T.quotes(spark, d)
    return MT.constraint_report(q, _COTIZACIONES_SPEC, unique_sets=[("solicitud_id", "linea")])


@register("agg_supplier_response", f"""
SELECT round(count(DISTINCT proveedor_id) / CAST((SELECT count(*) FROM supplier) AS DOUBLE) * 100, 1)
  AS tasa_respuesta_proveedores FROM quotes""", views=("quotes",))
def agg_supplier_response(spark, d):
    from cauce.operators.kpi import supplier_response
    n_cat = T.table(spark, d, "supplier").agg(F.count(F.lit(1))).first()[0]
    return spark.range(1).select(supplier_response(T.quotes(spark, d), n_cat).alias("tasa_respuesta_proveedores"))
