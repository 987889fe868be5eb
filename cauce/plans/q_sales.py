"""Sales cleaning / validation / load queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.operators import sales as S
from cauce.plans import oracle as O
from cauce.plans.registry import register
from cauce.sources import tables as T

_RAW = ", ".join(S.RAW_COLUMNS)

# SQL twin of the rule flags over sales_raw
_FLAGS = f"""
flags AS (
  SELECT {_RAW}, descuento,
    coalesce({O.sql_to_date('fecha')} IS NOT NULL, false) AS val_fecha,
    {O.sql_is_numeric('cantidad')} AS val_cantidad_tipo,
    {O.sql_is_numeric('precio')} AS val_precio_tipo,
    coalesce({O.sql_to_double('cantidad')} > 0 AND {O.sql_to_double('cantidad')} <= {S.QUANTITY_MAX}, false)
      AS val_cantidad_negocio,
    coalesce({O.sql_to_double('precio')} > 0 AND NOT isnan({O.sql_to_double('precio')}), false)
      AS val_precio_negocio,
    (descuento IS NULL OR coalesce(descuento >= 0 AND descuento <= 100, false)) AS val_descuento,
    NOT (producto IS NULL OR length({O.sql_strip('producto')}) = 0) AS val_producto,
    NOT (ciudad IS NULL OR length({O.sql_strip('ciudad')}) = 0) AS val_ciudad
  FROM sales_raw),
obs AS (
  SELECT *, ({' AND '.join(S.RULES)}) AS registro_valido,
    concat_ws('{S.MESSAGE_SEPARATOR}',
      {", ".join(
        f"CASE WHEN val_cantidad_tipo AND NOT val_cantidad_negocio THEN '{S.MESSAGES[r]}' END"
        if r == "val_cantidad_negocio" else
        f"CASE WHEN val_precio_tipo AND NOT val_precio_negocio THEN '{S.MESSAGES[r]}' END"
        if r == "val_precio_negocio" else
        f"CASE WHEN NOT {r} THEN '{S.MESSAGES[r]}' END" for r in S.RULES)}) AS _joined
  FROM flags),
validated AS (
  SELECT * EXCLUDE (_joined),
    CASE WHEN _joined = '' THEN '{S.VALID_TEXT}' ELSE _joined END AS observaciones
  FROM obs)"""

_CLEAN_CTE = f"""
dedup AS (SELECT DISTINCT {_RAW} FROM sales_raw),
nonnull AS (SELECT * FROM dedup WHERE {" AND ".join(c + " IS NOT NULL" for c in S.RAW_COLUMNS)}),
parsed AS (
  SELECT id, {O.sql_to_date('fecha')} AS fecha, producto, {O.sql_to_double('cantidad')} AS cantidad,
    {O.sql_to_double('precio')} AS precio, ciudad FROM nonnull),
cleaned AS (
  SELECT *, cantidad * precio AS total FROM parsed
  WHERE fecha IS NOT NULL AND cantidad IS NOT NULL AND precio IS NOT NULL)"""


def _validated(spark, d):
    return S.validate_sales(T.sales_raw(spark, d))


@register("src_raw_landing", "SELECT count(*) AS lineas FROM sales_raw", views=("sales_raw",))
def src_raw_landing(spark, d):
    """The raw CSV is landed line by line in the raw zone before parsing, by as
    many tasks as it has files; the landed copy has one line per raw row."""
    from cauce.plans.q_io import _scratch
    from cauce.sources.files import land_raw
    src = _scratch(spark, "raw_src")
    T.sales_raw(spark, d).select(*S.RAW_COLUMNS).write.option("header", False).csv(src)
    landed = land_raw(spark, src, _scratch(spark, "raw_zone"))
    return spark.read.text(landed).agg(F.count(F.lit(1)).alias("lineas"))


@register("src_typed_text", f"""
SELECT id, TRY_CAST({O.sql_to_double("nullif(cantidad, '')")} AS BIGINT) AS cantidad,
  {O.sql_to_double("nullif(precio, '')")} AS precio, nullif(ciudad, '') AS ciudad
FROM sales_raw""", views=("sales_raw",))
def src_typed_text(spark, d):
    r = T.sales_raw(spark, d)
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return r.select("id", R.to_double(blank("cantidad")).try_cast("bigint").alias("cantidad"),
                    R.to_double(blank("precio")).alias("precio"), blank("ciudad").alias("ciudad"))


@register("agg_dedup", f"""
SELECT count(*) AS filas, (SELECT count(*) FROM (SELECT DISTINCT {_RAW} FROM sales_raw) t) AS distintas,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_RAW} FROM sales_raw) t) AS duplicados
FROM sales_raw""", views=("sales_raw",))
def agg_dedup(spark, d):
    r = T.sales_raw(spark, d).select(*S.RAW_COLUMNS)
    n = r.agg(F.count(F.lit(1))).scalar()
    nd = r.dropDuplicates().agg(F.count(F.lit(1))).scalar()
    return r.sparkSession.range(1).select(n.alias("filas"), nd.alias("distintas"),
                                          (n - nd).alias("duplicados"))


@register("clean_dropna", f"""
WITH dedup AS (SELECT DISTINCT {_RAW} FROM sales_raw)
SELECT * FROM dedup WHERE {" AND ".join(c + " IS NOT NULL" for c in S.RAW_COLUMNS)}""",
          views=("sales_raw",))
def clean_dropna(spark, d):
    return T.sales_raw(spark, d).select(*S.RAW_COLUMNS).dropDuplicates().na.drop("any")


@register("clean_to_numeric", f"""
SELECT id, precio AS precio_texto, {O.sql_to_double('precio')} AS precio FROM sales_raw""",
          views=("sales_raw",))
def clean_to_numeric(spark, d):
    r = T.sales_raw(spark, d)
    return r.select("id", F.col("precio").alias("precio_texto"), R.to_double("precio").alias("precio"))


@register("clean_to_date", f"""
SELECT id, fecha AS fecha_texto, {O.sql_to_date('fecha')} AS fecha FROM sales_raw""",
          views=("sales_raw",))
def clean_to_date(spark, d):
    r = T.sales_raw(spark, d)
    return r.select("id", F.col("fecha").alias("fecha_texto"), R.to_iso_date("fecha").alias("fecha"))


@register("calc_total", f"WITH {_CLEAN_CTE} SELECT * FROM cleaned", views=("sales_raw",))
def calc_total(spark, d):
    return S.clean_sales(T.sales_raw(spark, d))


@register("job_sales_clean", f"""
WITH {_CLEAN_CTE} SELECT count(*) AS filas, sum(CAST(total AS DECIMAL(38,2))) AS total_ventas FROM cleaned""",
          views=("sales_raw",))
def job_sales_clean(spark, d):
    c = S.clean_sales(T.sales_raw(spark, d))
    return c.agg(F.count(F.lit(1)).alias("filas"),
                 F.sum(F.col("total").cast("decimal(38,2)")).alias("total_ventas"))


# one query per validator: (id, flag)
_VALIDATORS = {
    "val_date_iso": "val_fecha",
    "val_numeric": "val_cantidad_tipo",
    "val_quantity": "val_cantidad_negocio",
    "val_price_positive": "val_precio_negocio",
    "val_discount": "val_descuento",
    "val_text_nonempty": "val_producto",
}


def _validator_query(flag):
    def q(spark, d):
        return _validated(spark, d).select("id", flag)
    return q


for _qid, _flag in _VALIDATORS.items():
    register(_qid, f"WITH {_FLAGS} SELECT id, {_flag} FROM validated", views=("sales_raw",))(
        _validator_query(_flag))


@register("val_add_discount_col", f"""
SELECT {_RAW}, CAST(NULL AS DOUBLE) AS descuento FROM sales_raw""", views=("sales_raw",))
def val_add_discount_col(spark, d):
    return S.with_discount(T.sales_raw(spark, d).select(*S.RAW_COLUMNS))


@register("val_all", f"WITH {_FLAGS} SELECT id, {', '.join(S.RULES)}, registro_valido FROM validated",
          views=("sales_raw",))
def val_all(spark, d):
    return _validated(spark, d).select("id", *S.RULES, "registro_valido")


@register("val_observations", f"WITH {_FLAGS} SELECT * FROM validated", views=("sales_raw",))
def val_observations(spark, d):
    return _validated(spark, d)


@register("split_quarantine", f"""
WITH {_FLAGS} SELECT {_RAW}, observaciones FROM validated WHERE registro_valido""", views=("sales_raw",))
def split_quarantine(spark, d):
    valid, _ = S.split_quarantine(_validated(spark, d))
    return valid.select(*S.RAW_COLUMNS, "observaciones")


@register("split_quarantine_rejected", f"""
WITH {_FLAGS} SELECT {_RAW}, observaciones FROM validated WHERE NOT registro_valido""",
          views=("sales_raw",))
def split_quarantine_rejected(spark, d):
    _, bad = S.split_quarantine(_validated(spark, d))
    return bad.select(*S.RAW_COLUMNS, "observaciones")


@register("tag_lineage", f"""
WITH {_FLAGS}
SELECT id, 'valido' AS estado_calidad, '{S.SOURCE_TAG}' AS fuente, NULL AS observacion
FROM validated WHERE registro_valido
UNION ALL
SELECT id, 'error', '{S.SOURCE_TAG}', observaciones FROM validated WHERE NOT registro_valido""",
          views=("sales_raw",))
def tag_lineage(spark, d):
    valid, bad = S.split_quarantine(_validated(spark, d))
    v = S.tag_valid(valid).select("id", "estado_calidad", "fuente",
                                  F.lit(None).cast("string").alias("observacion"))
    b = S.tag_rejected(bad).select("id", "estado_calidad", "fuente", "observacion")
    return v.unionByName(b)


_DEC = "DECIMAL(18,2)"


@register("project_load_cols", f"""
WITH {_FLAGS}
SELECT id, fecha, producto,
  CAST({O.sql_to_double('cantidad')} AS {_DEC}) AS cantidad,
  CAST({O.sql_to_double('precio')} AS {_DEC}) AS precio, ciudad,
  CAST(CAST({O.sql_to_double('cantidad')} AS {_DEC}) * CAST({O.sql_to_double('precio')} AS {_DEC}) AS {_DEC})
    AS total,
  'valido' AS estado_calidad, '{S.SOURCE_TAG}' AS fuente
FROM validated WHERE registro_valido""", views=("sales_raw",))
def project_load_cols(spark, d):
    valid, _ = S.split_quarantine(S.validate_sales(T.sales_raw(spark, d), keep_parsed=True))
    return S.project_clean(S.tag_valid(valid))


@register("project_load_cols_rejected", f"""
WITH {_FLAGS}
SELECT id, fecha, producto, cantidad, precio, ciudad, 'error' AS estado_calidad,
  '{S.SOURCE_TAG}' AS fuente, observaciones AS observacion
FROM validated WHERE NOT registro_valido""", views=("sales_raw",))
def project_load_cols_rejected(spark, d):
    _, bad = S.split_quarantine(_validated(spark, d))
    return S.project_rejected(S.tag_rejected(bad))


@register("check_load_ready", """
SELECT 'fecha' AS columna, 'La columna fecha contiene valores nulos' AS error
  FROM sales_raw HAVING count(*) FILTER (WHERE fecha IS NULL) > 0
UNION ALL SELECT 'cantidad', 'La columna cantidad contiene valores nulos'
  FROM sales_raw HAVING count(*) FILTER (WHERE cantidad IS NULL) > 0
UNION ALL SELECT 'ciudad', 'La columna ciudad contiene valores nulos'
  FROM sales_raw HAVING count(*) FILTER (WHERE ciudad IS NULL) > 0
UNION ALL SELECT 'id', 'La columna id contiene valores nulos'
  FROM sales_raw HAVING count(*) FILTER (WHERE id IS NULL) > 0
UNION ALL SELECT 'producto', 'La columna producto contiene valores nulos'
  FROM sales_raw HAVING count(*) FILTER (WHERE producto IS NULL) > 0
UNION ALL SELECT 'precio', 'La columna precio contiene valores nulos'
  FROM sales_raw HAVING count(*) FILTER (WHERE precio IS NULL) > 0
UNION ALL SELECT 'estado_calidad', 'Falta la columna obligatoria: estado_calidad'""",
          views=("sales_raw",))
def check_load_ready(spark, d):
    """The pre-load check run on the raw frame: reports the missing tag column
    and every required column holding nulls."""
    return S.load_ready_errors(T.sales_raw(spark, d), S.CLEAN_REQUIRED)


@register("agg_valid_counts", f"""
WITH {_FLAGS}
SELECT count(*) AS total, count(*) FILTER (WHERE registro_valido) AS validos,
  count(*) FILTER (WHERE NOT registro_valido) AS invalidos,
  {", ".join(f"count(*) FILTER (WHERE NOT {r}) AS fallas_{r}" for r in S.RULES)}
FROM validated""", views=("sales_raw",))
def agg_valid_counts(spark, d):
    return S.valid_counts(_validated(spark, d))


@register("agg_load_by_source", f"""
WITH {_FLAGS} SELECT '{S.SOURCE_TAG}' AS fuente, count(*) AS total FROM validated WHERE registro_valido""",
          views=("sales_raw",))
def agg_load_by_source(spark, d):
    valid, _ = S.split_quarantine(_validated(spark, d))
    return S.project_clean(S.tag_valid(valid)).groupBy("fuente").agg(F.count(F.lit(1)).alias("total"))


@register("agg_errors_by_reason", f"""
WITH {_FLAGS} SELECT observaciones AS observacion, count(*) AS total FROM validated
WHERE NOT registro_valido GROUP BY observaciones""", views=("sales_raw",))
def agg_errors_by_reason(spark, d):
    _, bad = S.split_quarantine(_validated(spark, d))
    rej = S.project_rejected(S.tag_rejected(bad))
    return rej.groupBy("observacion").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"))


@register("agg_table_counts", f"""
WITH {_FLAGS}
SELECT 'ventas_clean' AS tabla, count(*) AS filas FROM validated WHERE registro_valido
UNION ALL SELECT 'ventas_error', count(*) FROM validated WHERE NOT registro_valido""",
          views=("sales_raw",))
def agg_table_counts(spark, d):
    v = _validated(spark, d)
    c = v.agg(F.count_if(F.col("registro_valido")).alias("ventas_clean"),
              F.count_if(~F.col("registro_valido")).alias("ventas_error"))
    return c.select(F.explode(F.array(
        F.struct(F.lit("ventas_clean").alias("tabla"), F.col("ventas_clean").alias("filas")),
        F.struct(F.lit("ventas_error").alias("tabla"), F.col("ventas_error").alias("filas")))).alias("s")
    ).select("s.*")
