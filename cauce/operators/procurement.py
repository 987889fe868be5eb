"""Procurement operators: best quote, request enrichment, quote rules, updates.

All operators are DataFrame → DataFrame.  Whole-table minima and maxima are
scalar subqueries, computed once as a tiny aggregate and folded into the
projection without a join; the median is an exact distributed selection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.operators.quality import exact_quantiles

# Tie-break for "first row on ties": price, then line, product, supplier.
QUOTE_ORDER = ("precio_total", "linea", "producto_id", "proveedor_id")


def best_quote(quotes: DataFrame, key: str, keep=("proveedor_id", "precio_total"),
               order=QUOTE_ORDER) -> DataFrame:
    """Cheapest quote per ``key`` (first on ties by ``order``).

    ``min_by`` over a struct is an aggregate with map-side partial
    aggregation: each task emits at most one candidate per key, so a hot key
    (a third of all rows) costs one row per task in the shuffle, not a third
    of the table in one task.  No window sort over raw rows.
    """
    best = F.min_by(F.struct(*[F.col(c) for c in keep]), F.struct(*[F.col(c) for c in order]))
    return (quotes.groupBy(key).agg(best.alias("_b"))
            .select(key, *[F.col(f"_b.{c}").alias(c) for c in keep]))


def enrich_requests(requests: DataFrame, quotes: DataFrame, suppliers: DataFrame | None = None,
                    key: str = "id", quote_key: str = "solicitud_id") -> DataFrame:
    """Requests LEFT JOIN their best quote, plus savings and urgency category.

    Adds ``urgencia_categoria``, ``mejor_proveedor_id``, ``mejor_proveedor``
    (supplier name when ``suppliers`` is given), ``mejor_precio`` and
    ``ahorro_pct``.  The best-quote aggregate comes out hash-partitioned on
    the request key, so the join shuffles only the request side; the name
    lookup runs after the aggregate (one row per request, not per quote).
    """
    best = best_quote(quotes, quote_key).select(
        F.col(quote_key).alias("_rk"),
        F.col("proveedor_id").alias("mejor_proveedor_id"),
        F.col("precio_total").alias("mejor_precio"))
    if suppliers is not None:
        names = suppliers.select(F.col("id").alias("mejor_proveedor_id"),
                                 F.col("nombre").alias("mejor_proveedor"))
        best = best.join(names, "mejor_proveedor_id", "left")
    out = requests.join(best, requests[key] == best["_rk"], "left").drop("_rk")
    if "urgencia" in requests.columns:
        out = out.withColumn("urgencia_categoria", R.urgency_category("urgencia"))
    if "presupuesto_max" in requests.columns:
        out = out.withColumn("ahorro_pct", R.savings_pct("presupuesto_max", "mejor_precio"))
    return out


def best_quote_per_product(quotes: DataFrame) -> DataFrame:
    """Best quote per product, renamed as the reference does."""
    b = best_quote(quotes, "producto_id", keep=("proveedor_id", "precio_total"))
    return b.select("producto_id", F.col("proveedor_id").alias("mejor_proveedor_id"),
                    F.col("precio_total").alias("mejor_precio"))


def quotes_by_supplier(quotes: DataFrame, name_col: str = "proveedor_nombre") -> DataFrame:
    """Quotes per supplier name; null names are dropped (pandas groupby rule)."""
    return (quotes.filter(F.col(name_col).isNotNull())
            .groupBy(name_col).agg(F.count(F.lit(1)).alias("cotizaciones")))


def quotes_by_named_supplier(quotes: DataFrame, suppliers: DataFrame) -> DataFrame:
    """:func:`quotes_by_supplier` from quotes without names: counted by supplier id first, so that one
    row per supplier, not every quote, meets the names (``id``, ``nombre``)."""
    counts = quotes.groupBy("proveedor_id").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(suppliers.select(F.col("id").alias("proveedor_id"), F.col("nombre").alias("proveedor_nombre")),
                        "proveedor_id")
    return (named.filter(F.col("proveedor_nombre").isNotNull())
            .groupBy("proveedor_nombre").agg(F.sum("n").alias("cotizaciones")))


def normalize_prices(quotes: DataFrame, col: str = "precio_total") -> DataFrame:
    """Impute missing prices (null or NaN) with the column median, then min-max scale to [0,1].

    A constant column scales to 0.  The exact median comes from distributed
    selection (no column in one task); it lies inside [min, max], so these are
    plain aggregates of the given prices.
    """
    known = F.when(~F.isnan(F.col(col).cast("double")), F.col(col))
    clean = quotes.withColumn(col, known)
    med = F.lit(exact_quantiles(clean, col, [0.5])[0.5])
    bounds = clean.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    lo, span = bounds["lo"], bounds["hi"] - bounds["lo"]
    filled = clean.withColumn(col, F.coalesce(F.col(col), med.cast(dict(quotes.dtypes)[col])))
    return filled.withColumn(
        "precio_norm", F.when(span == 0, F.lit(0.0)).otherwise((F.col(col) - lo) / span))


def classify_quotes(quotes: DataFrame) -> DataFrame:
    """Stateless per-quote rules: lead-time band, risk level, price check, subject."""
    out = quotes
    if "plazo_dias" in quotes.columns:
        out = out.withColumn("plazo_categoria", R.lead_time_bucket("plazo_dias"))
    if "risk_score" in quotes.columns:
        out = out.withColumn("nivel_riesgo", R.risk_level("risk_score"))
    if "precio_total" in quotes.columns and "producto" in quotes.columns:
        out = out.withColumn("precio_valido", R.price_in_range("precio_total", "producto"))
    if "producto" in quotes.columns:
        out = out.withColumn("email_asunto", F.concat(F.lit("Cotizacion: "), F.col("producto")))
    return out


def price_check_by_rule_table(quotes: DataFrame, rules: DataFrame) -> DataFrame:
    """Keyword range lookup as a join (the alternate form of ``price_in_range``).

    ``rules`` is the 15-row keyword table (fixed size, so broadcasting it is a
    bounded cost).  The non-equi match runs once per *distinct product*
    (catalogue-sized, not quote-sized); the winning rule is the lowest
    priority via ``min_by``; the per-product ranges are then equi-joined back
    to the quotes (AQE broadcasts them only if their measured size is small).
    Quotes without a keyword are valid.
    """
    products = quotes.select("producto").distinct()
    m = products.join(F.broadcast(rules), F.lower(products["producto"]).contains(rules["clave"]), "inner")
    per_product = m.groupBy("producto").agg(
        F.min_by(F.struct("precio_min", "precio_max"), F.col("prioridad")).alias("_r"))
    j = quotes.join(per_product, "producto", "left")
    ok = F.when(F.col("_r").isNull(), F.lit(True)).otherwise(
        F.coalesce((F.col("precio_total") >= F.col("_r.precio_min"))
                   & (F.col("precio_total") <= F.col("_r.precio_max")), F.lit(False)))
    return j.withColumn("precio_valido", ok).drop("_r")


def apply_best_quote_update(requests: DataFrame, quotes: DataFrame,
                            key: str = "id", quote_key: str = "solicitud_id") -> DataFrame:
    """``UPDATE requests SET supplier, savings FROM best quote per request``.

    Requests with a quote get ``proveedor_elegido_id`` and
    ``ahorro_conseguido``; others keep their old values (or defaults 0/null).
    Produces the new version of the table (write it to a new path).
    """
    best = best_quote(quotes, quote_key).select(
        F.col(quote_key).alias("_rk"), F.col("proveedor_id").alias("_sup"),
        F.col("precio_total").alias("_price"))
    j = requests.join(best, requests[key] == best["_rk"], "left")
    old_sup = F.col("proveedor_elegido_id") if "proveedor_elegido_id" in requests.columns else F.lit(None).cast("long")
    old_sav = F.col("ahorro_conseguido") if "ahorro_conseguido" in requests.columns else F.lit(0.0)
    return (j.withColumn("proveedor_elegido_id", F.when(F.col("_rk").isNotNull(), F.col("_sup")).otherwise(old_sup))
             .withColumn("ahorro_conseguido",
                         F.when(F.col("_rk").isNotNull(), R.savings_pct("presupuesto_max", "_price"))
                         .otherwise(old_sav))
             .drop("_rk", "_sup", "_price"))


def complete_status(requests: DataFrame) -> DataFrame:
    """pendiente + chosen supplier → completada; other rows unchanged."""
    return requests.withColumn(
        "estado",
        F.when((F.col("estado") == "pendiente") & F.col("proveedor_elegido_id").isNotNull(),
               F.lit("completada")).otherwise(F.col("estado")))


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Distribution of a category, nulls dropped, most frequent first."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc(col)))
