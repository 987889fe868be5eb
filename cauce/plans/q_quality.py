"""Data-quality profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce.operators import quality as Q
from cauce.operators import sales as S
from cauce.plans.registry import register
from cauce.sources import tables as T

PROFILE_COLS = T.FEATURES + [T.TARGET]
RAW_COLS = S.RAW_COLUMNS + ["descuento"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _profile(spark, d):
    return T.portfolio(spark, d).select(*PROFILE_COLS)


def _measured(spark, d):
    """The profile with NaN among its values, which no statistic counts."""
    return T.portfolio_gaps(spark, d).select(*PROFILE_COLS)


@register("agg_describe", _union([f"""
SELECT '{c}' AS columna, CAST(count({c}) AS DOUBLE) AS count, round(avg(CAST({c} AS DOUBLE)), 3) AS mean,
  round(stddev_samp(CAST({c} AS DOUBLE)), 3) AS std, round(CAST(min({c}) AS DOUBLE), 3) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 3) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 3) AS p50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 3) AS p75, round(CAST(max({c}) AS DOUBLE), 3) AS max,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 3) AS mediana
FROM portfolio_gaps""" for c in PROFILE_COLS]), views=("portfolio_gaps",))
def agg_describe(spark, d):
    return Q.describe(_measured(spark, d))


_DESCRIBE_WIDE = "\nUNION ALL\n".join(f"""
SELECT '{c}' AS columna, CAST(count({c}) AS DOUBLE) AS count, round(avg(CAST({c} AS DOUBLE)), 3) AS mean,
  round(stddev_samp(CAST({c} AS DOUBLE)), 3) AS std, round(CAST(min({c}) AS DOUBLE), 3) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 3) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 3) AS p50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 3) AS p75, round(CAST(max({c}) AS DOUBLE), 3) AS max,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 3) AS mediana
FROM portfolio""" for c in PROFILE_COLS)


@register("agg_describe_long", "WITH w AS (" + _DESCRIBE_WIDE + ")\n" + "\nUNION ALL\n".join(
    f"SELECT columna, '{m}' AS metrica, {m} AS valor FROM w" for m in Q.DESCRIBE_METRICS), views=("portfolio",))
def agg_describe_long(spark, d):
    return Q.describe_long(_profile(spark, d))


@register("agg_mode", _union([f"""
SELECT * FROM (SELECT '{c}' AS columna, CAST({c} AS VARCHAR) AS moda FROM portfolio_gaps WHERE {c} IS NOT NULL
  GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)""" for c in PROFILE_COLS]), views=("portfolio_gaps",))
def agg_mode(spark, d):
    return Q.mode_table(_measured(spark, d))


@register("agg_nulls", _union([f"""
SELECT '{c}' AS columna, count(*) FILTER (WHERE {c} IS NULL) AS nulos FROM sales_raw""" for c in RAW_COLS]),
          views=("sales_raw",))
def agg_nulls(spark, d):
    return Q.null_counts(T.sales_raw(spark, d).select(*RAW_COLS))


@register("agg_completeness", f"""
SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE round((1 - CAST({" + ".join(
    f"count(*) FILTER (WHERE {c} IS NULL)" for c in RAW_COLS)} AS DOUBLE) / (count(*) * {len(RAW_COLS)})) * 100, 2)
  END AS completitud_datos FROM sales_raw""", views=("sales_raw",))
def agg_completeness(spark, d):
    return Q.completeness(T.sales_raw(spark, d).select(*RAW_COLS))


@register("agg_duplicates", f"""
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(PROFILE_COLS)} FROM portfolio) t)
  AS duplicados FROM portfolio""", views=("portfolio",))
def agg_duplicates(spark, d):
    return Q.duplicates(_profile(spark, d))


@register("agg_shape", f"""
SELECT count(*) AS n_filas, {len(PROFILE_COLS)} AS n_columnas, '{",".join(PROFILE_COLS)}' AS columnas,
  'edad:int,anos_cliente:int,uso_datos_gb:double,llamadas_mes:int,reclamos:int,plan_premium:int,abandona:int' AS tipos
FROM portfolio""", views=("portfolio",))
def agg_shape(spark, d):
    sh = Q.shape(_profile(spark, d))
    types = F.array_join(F.transform("columnas", lambda c: F.concat(c, F.lit(":"), F.element_at("tipos", c))), ",")
    return sh.select("n_filas", "n_columnas", F.array_join("columnas", ",").alias("columnas"), types.alias("tipos"))


def _mode_sql(c):
    return (f"(SELECT {c} FROM sales_raw WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


# every fifth sale has no visit count; the others 0, 1, 6 or 7, so that the median lies between
_VISITS = ("CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN NULL WHEN CAST(id AS BIGINT) % 5 < 3 "
           "THEN CAST(id AS BIGINT) % 2 ELSE 6 + CAST(id AS BIGINT) % 2 END")


@register("agg_impute_all", f"""
SELECT id, coalesce(fecha, {_mode_sql('fecha')}) AS fecha, producto,
  coalesce(cantidad, {_mode_sql('cantidad')}) AS cantidad, precio,
  coalesce(ciudad, {_mode_sql('ciudad')}) AS ciudad,
  coalesce(descuento, (SELECT quantile_cont(descuento, 0.5) FROM sales_raw)) AS descuento,
  coalesce({_VISITS}, (SELECT quantile_cont({_VISITS}, 0.5) FROM sales_raw)) AS visitas
FROM sales_raw""", views=("sales_raw",))
def agg_impute_all(spark, d):
    """All columns of the raw sales, plus an integer one with missing values (its median may be x.5)."""
    return Q.impute_all(T.sales_raw(spark, d).select(*RAW_COLS, F.expr(_VISITS).cast("int").alias("visitas")))


@register("agg_balance_pct", """
SELECT abandona AS clase, count(*) AS conteo,
  round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM portfolio WHERE abandona IS NOT NULL) * 100, 2) AS pct
FROM portfolio WHERE abandona IS NOT NULL GROUP BY abandona""", views=("portfolio",))
def agg_balance_pct(spark, d):
    return Q.class_balance(T.portfolio(spark, d), T.TARGET)


@register("agg_imbalance_ratio", """
SELECT round(max(n) / min(n), 2) AS ratio_desbalance FROM (
  SELECT count(*) AS n FROM portfolio WHERE abandona IS NOT NULL GROUP BY abandona) t""",
          views=("portfolio",))
def agg_imbalance_ratio(spark, d):
    return Q.imbalance_ratio(T.portfolio(spark, d), T.TARGET)


@register("agg_class_weight", """
SELECT abandona AS clase, count(*) AS n,
  (SELECT count(*) FROM portfolio) / (2.0 * count(*)) AS peso
FROM portfolio GROUP BY abandona""", views=("portfolio",))
def agg_class_weight(spark, d):
    from cauce.operators.churn import class_weights
    return class_weights(T.portfolio(spark, d), T.TARGET)


@register("agg_quality_report", f"""
SELECT count(*) AS n_filas, {len(PROFILE_COLS)} AS n_columnas,
  {" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in PROFILE_COLS)} AS total_nulos,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(PROFILE_COLS)} FROM portfolio_gaps) t) AS duplicados,
  (SELECT string_agg(abandona || '=' || printf('%.2f', pct), ',' ORDER BY abandona) FROM (
     SELECT abandona, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM portfolio_gaps) * 100, 2) AS pct
     FROM portfolio_gaps GROUP BY abandona) b) AS balance_pct,
  (SELECT round(max(n) / min(n), 2) FROM (SELECT count(*) AS n FROM portfolio_gaps GROUP BY abandona) t)
    AS ratio_desbalance
FROM portfolio_gaps""", views=("portfolio_gaps",))
def agg_quality_report(spark, d):
    report = Q.quality_report(_measured(spark, d), T.TARGET)
    share = F.transform(F.array_sort(F.map_entries("balance_pct")),
                        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"])))
    return report.withColumn("balance_pct", F.array_join(share, ","))
