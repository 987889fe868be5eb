"""Streaming queries: each runs a stream to completion with
``availableNow`` over the whole quote feed and returns the sink table; the
oracle is the batch SQL of the same operator."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.plans import oracle as O
from cauce.plans.registry import register
from cauce.streaming import quotes as S


@register("stream_quotes", "SELECT * FROM quotes", views=("quotes",))
def stream_quotes(spark, d):
    path = S.run_to_table(S.quote_stream(spark, d), "quotes", "append")
    return spark.read.parquet(path)


@register("stream_quote_rules", f"""
SELECT solicitud_id, linea, producto_id, proveedor_id,
  {O.sql_right_closed('plazo_dias', R.LEAD_TIME_BINS)} AS plazo_categoria,
  {O.sql_right_closed('risk_score', R.RISK_BINS)} AS nivel_riesgo,
  {O.sql_price_in_range('precio_total', 'producto')} AS precio_valido,
  'Cotizacion: ' || producto AS email_asunto
FROM quotes""", views=("quotes",))
def stream_quote_rules(spark, d):
    s = S.quote_rules_stream(S.quote_stream(spark, d)).select(
        "solicitud_id", "linea", "producto_id", "proveedor_id", "plazo_categoria", "nivel_riesgo",
        "precio_valido", "email_asunto")
    return spark.read.parquet(S.run_to_table(s, "quote_rules", "append"))


@register("stream_best_quote", """
SELECT producto_id, proveedor_id AS mejor_proveedor_id, precio_total AS mejor_precio FROM (
  SELECT producto_id, proveedor_id, precio_total,
    row_number() OVER (PARTITION BY producto_id
                       ORDER BY precio_total, linea, producto_id, proveedor_id) AS rn
  FROM quotes) t WHERE rn = 1""", views=("quotes",))
def stream_best_quote(spark, d):
    s = S.best_quote_stream(S.quote_stream(spark, d, max_files_per_trigger=1))
    return S.read_updates(spark, S.run_to_table(s, "best_quote", "update", keys="producto_id"), "producto_id")


@register("stream_supplier_counts", """
SELECT proveedor_id, count(*) AS cotizaciones FROM quotes GROUP BY proveedor_id""", views=("quotes",))
def stream_supplier_counts(spark, d):
    s = S.supplier_counts_stream(S.quote_stream(spark, d))
    return S.read_updates(spark, S.run_to_table(s, "supplier_counts", "update", keys="proveedor_id"), "proveedor_id")


@register("stream_score")
def stream_score(spark, d):
    """Profiles land as Parquet files; the stream scores valid ones with the
    trained model and keeps invalid ones unscored for quarantine."""
    from cauce.plans.q_churn import PROFILE_RULES, _profiles, profile_flags, trained
    from cauce.sources.tables import FEATURES
    t = trained(spark, d)
    landing = os.path.join(S._run_dir(spark, "profiles_landing"), "in")
    prof = _profiles(spark, d)
    prof.write.mode("overwrite").parquet(landing)
    stream = spark.readStream.schema(prof.schema).parquet(landing).withColumns(profile_flags())
    ok = F.lit(True)
    for c in PROFILE_RULES:
        ok = ok & F.col(f"ok_{c}")
    stream = stream.withColumn("perfil_valido", ok).drop(*[f"ok_{c}" for c in PROFILE_RULES])
    scored = S.score_stream(stream, t["best_model"], FEATURES, t["params"], t["scaled"], t["fills"])
    return spark.read.parquet(S.run_to_table(scored, "score", "append"))
