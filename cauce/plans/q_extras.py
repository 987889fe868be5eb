"""Documented-only rules: age clamp, {0,1} filter, Latin
alphabet filter, no-model fallback segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.plans.registry import register
from cauce.sources import tables as T


@register("clamp_age", f"""
SELECT cliente_id, least(greatest(edad - 20, {R.AGE_CLAMP[0]}), {R.AGE_CLAMP[1]}) AS edad FROM portfolio""",
          views=("portfolio",))
def clamp_age(spark, d):
    """Ages captured with an offset error (edad − 20 can go negative) clamped to [0, 120]."""
    p = T.portfolio(spark, d)
    return p.select("cliente_id", R.clamp_age(F.col("edad") - 20).alias("edad"))


@register("filter_binary", """
SELECT count(*) FILTER (WHERE coalesce(plan_premium IN (0, 1), false) AND coalesce(abandona IN (0, 1), false))
  AS aceptadas,
  count(*) FILTER (WHERE NOT (coalesce(plan_premium IN (0, 1), false) AND coalesce(abandona IN (0, 1), false)))
  AS rechazadas
FROM portfolio""", views=("portfolio",))
def filter_binary(spark, d):
    p = T.portfolio(spark, d)
    ok = R.is_binary("plan_premium") & R.is_binary("abandona")
    return p.agg(F.count_if(ok).alias("aceptadas"), F.count_if(~ok).alias("rechazadas"))


@register("latin_filter", f"""
SELECT doc_id, lang, coalesce(regexp_matches(text, '{R.LATIN_TEXT}'), false) AS texto_latino FROM documents""")
def latin_filter(spark, d):
    """Whole document texts checked against the Latin-alphabet pattern."""
    docs = T.table(spark, d, "documents").select("doc_id", "lang", "text")
    return docs.select("doc_id", "lang", R.is_latin_text("text").alias("texto_latino"))


@register("fallback_segment", f"""
SELECT CASE WHEN reclamos > {R.FALLBACK_COMPLAINTS} THEN 'ALTO' WHEN reclamos IS NOT NULL THEN 'BAJO' END
  AS segmento_riesgo, count(*) AS n FROM portfolio GROUP BY 1""", views=("portfolio",))
def fallback_segment(spark, d):
    p = T.portfolio(spark, d).select(R.fallback_segment("reclamos").alias("segmento_riesgo"))
    return p.groupBy("segmento_riesgo").agg(F.count(F.lit(1)).alias("n"))


@register("read_retry", "SELECT solicitud_id, proveedor_id, precio_total, plazo_dias FROM quotes", views=("quotes",))
def read_retry(spark, d):
    """Quotes landed by a retried read: the feed's folder is not there at the first attempt and arrives during the pause."""
    from cauce.plans.q_io import _scratch
    from cauce.sources.files import land_with_retry
    feed = _scratch(spark, "late_feed")
    quotes = T.quotes(spark, d).select("solicitud_id", "proveedor_id", "precio_total", "plazo_dias")
    return land_with_retry(lambda: spark.read.parquet(feed), _scratch(spark, "landed_feed"),
                           sleep=lambda _: quotes.write.parquet(feed))
