"""KPI report and threshold alerts as tables.

Each indicator is a one-row aggregate; the report is their long-form union
``(kpi, valor)``; alerts are the report joined with the fixed rule table
(10 rows, broadcast) and evaluated with ``when``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES — alert rules: key, warn, crit, label, direction.
ALERT_RULES = [
    ("completitud_datos", 90.0, 80.0, "Completitud de datos (%)", "min"),
    ("tasa_parsing_exitoso", 85.0, 70.0, "Tasa parsing exitoso (%)", "min"),
    ("errores_validacion", 3, 10, "Errores de validacion (N)", "max"),
    ("disponibilidad_api", None, None, "Disponibilidad API cotizaciones", "bool"),
    ("filas_cargadas_neon", 1, 0, "Filas Cargadas Neon", "min"),
    ("latencia_ingesta_ms", 5000, 30000, "Latencia de ingesta (ms)", "max"),
    ("recall_modelo", 0.50, 0.30, "Recall del modelo churn", "min"),
    ("clientes_alto_riesgo", 200, 300, "Clientes en riesgo ALTO", "max"),
    ("tasa_respuesta_proveedores", 60.0, 40.0, "Tasa respuesta proveedores (%)", "min"),
    ("rondas_negociacion_prom", 4, 6, "Rondas negociacion promedio", "max"),
]
NO_MODEL = "No disponible"
SUPPLIER_CATALOG_SIZE = 10  # the reference divides by a literal 10 (SURVEY D6)


# KPIs reported as whole numbers (formatted without decimals in messages)
INTEGER_KPIS = {"errores_validacion", "filas_cargadas_neon", "clientes_alto_riesgo"}


def rule_table(spark: SparkSession) -> DataFrame:
    """The 10 rules with thresholds as numbers and as written (for messages)."""
    rows = [(k, None if w is None else float(w), None if c is None else float(c),
             None if w is None else str(w), None if c is None else str(c), lab, d)
            for k, w, c, lab, d in ALERT_RULES]
    return spark.createDataFrame(rows, "key string, warn double, crit double, warn_txt string, "
                                       "crit_txt string, label string, direccion string")


def null_cells(columns) -> F.Column:
    """Aggregate: the null cells of ``columns``."""
    return reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in columns])


def completeness(rows, nulls, n_columns: int) -> F.Column:
    """Filled cells ×100 (2 decimals) from the counted rows and null cells; 0 without rows."""
    return F.when(rows == 0, F.lit(0.0)).otherwise(F.round((1 - nulls / (rows * n_columns)) * 100, 2))


def completeness_of(df: DataFrame) -> DataFrame:
    return df.agg(completeness(F.count(F.lit(1)), null_cells(df.columns), len(df.columns)).alias("valor"))


def parse_rate(parsed: DataFrame, raw: DataFrame) -> F.Column:
    """parsed / raw ×100 rounded to 2; 100 when there is no raw row (scalar)."""
    n_raw = raw.agg(F.count(F.lit(1))).scalar()
    n_ok = parsed.agg(F.count(F.lit(1))).scalar()
    return F.when(n_raw == 0, F.lit(100.0)).otherwise(F.round(n_ok / n_raw * 100, 2))


def high_risk(scored: DataFrame, seg: str = "segmento_riesgo") -> DataFrame:
    """ALTO count and share ×100 (2 decimals)."""
    n = F.count(F.lit(1))
    alto = F.count_if(F.col(seg) == "ALTO")
    return scored.agg(alto.alias("clientes_alto_riesgo"),
                      F.round(alto / F.greatest(n, F.lit(1)) * 100, 2).alias("tasa_riesgo_alto"))


def supplier_response(quotes: DataFrame, catalog_size=SUPPLIER_CATALOG_SIZE) -> F.Column:
    """distinct suppliers / catalogue size ×100, 1 decimal (scalar)."""
    return quotes.agg(F.round(F.count_distinct("proveedor_id") / catalog_size * 100, 1)).scalar()


def quote_stats(quotes: DataFrame, parsed: F.Column, price_ok: F.Column) -> DataFrame:
    """One pass over the quotes for every indicator about them: raw and parsed rows, price errors,
    suppliers that answered."""
    return quotes.agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(parsed).alias("n_ok"),
                      F.count_if(~price_ok).alias("errors"),
                      F.count_distinct(F.when(parsed, F.col("proveedor_id"))).alias("suppliers"))


def high_risk_of_groups(groups: DataFrame, segment: F.Column) -> DataFrame:
    """:func:`high_risk` from one row per distinct score (``filas`` rows each); ``segment`` is the score's."""
    n = F.coalesce(F.sum("filas"), F.lit(0))
    alto = F.coalesce(F.sum(F.when(segment == "ALTO", F.col("filas"))), F.lit(0))
    return groups.agg(alto.alias("clientes_alto_riesgo"),
                      F.round(alto / F.greatest(n, F.lit(1)) * 100, 2).alias("tasa_riesgo_alto"))


def mean_rounds(negotiations: DataFrame | None) -> F.Column:
    if negotiations is None:
        return F.lit(0.0)
    return negotiations.agg(F.coalesce(F.round(F.avg("ronda"), 1), F.lit(0.0))).scalar()


def kpi_report(spark: SparkSession, *, requests: DataFrame | None = None, scored: DataFrame | None = None,
               complete: F.Column | None = None, risk: DataFrame | None = None, quotes: DataFrame | None = None,
               quotes_raw: DataFrame | None = None, price_flags: DataFrame | None = None,
               stats: DataFrame | None = None, load_summary: DataFrame | None = None,
               model_metrics: DataFrame | None = None, negotiations: DataFrame | None = None,
               catalog_size=SUPPLIER_CATALOG_SIZE, with_timestamp: bool = True,
               only=None) -> DataFrame:
    """The 13 indicators in long form ``(kpi, valor double, texto string)``.

    ``price_flags`` has a boolean ``precio_valido``; ``scored`` a
    ``segmento_riesgo``; ``load_summary`` one row with ``total_filas`` and
    the whole load's ``duracion_s``; ``model_metrics`` one row (modelo, recall, gini) of the
    selected model; ``stats``, a :func:`quote_stats` row, stands for ``quotes``,
    ``quotes_raw`` and ``price_flags``, ``complete`` (a completeness) for ``requests`` and ``risk``
    (a :func:`high_risk` row) for ``scored``.  A summary without seconds gives a null latency.  Every value is a scalar subquery, so the report is one
    small projection over a one-row frame; ``only`` (a set of KPI names)
    builds just those indicators and runs just their subqueries.
    """
    one = spark.range(1)
    shared: dict = {}

    def once(key, build):
        """One scalar subquery per group of indicators (a struct), shared."""
        if key not in shared:
            shared[key] = build()
        return shared[key]

    def load_total():
        if load_summary is None:
            return F.lit(0)
        return once("load", lambda: load_summary.agg(F.struct(
            F.sum("total_filas").alias("t"), (F.max("duracion_s") * 1000).alias("ms"))).scalar())["t"]

    def load_ms():
        if load_summary is None:
            return F.lit(0.0)
        load_total()
        return shared["load"]["ms"]

    def model_field(name, default):
        if model_metrics is None:
            return F.lit(default)
        return once("model", lambda: model_metrics.agg(F.first(F.struct("modelo", "recall", "gini"))).scalar())[name]

    def hr(field):
        return once("hr", lambda: (high_risk(scored) if risk is None else risk).select(F.struct("*")).scalar())[field]

    def quote(field):
        return once("quotes", lambda: stats.select(F.struct("*")).scalar())[field]

    def parse():
        if stats is None:
            return parse_rate(quotes, quotes_raw)
        return F.when(quote("n_raw") == 0, F.lit(100.0)).otherwise(F.round(quote("n_ok") / quote("n_raw") * 100, 2))

    def price_errors():
        return (quote("errors") if stats is not None
                else price_flags.agg(F.count_if(~F.col("precio_valido"))).scalar())

    def available():
        return (quote("n_ok") >= 1) if stats is not None else quotes.agg(F.count(F.lit(1)) >= 1).scalar()

    def response():
        return (F.round(quote("suppliers") / catalog_size * 100, 1) if stats is not None
                else supplier_response(quotes, catalog_size))

    builders = {  # name → (value, text); built lazily
        "completitud_datos": lambda: (completeness_of(requests).scalar() if complete is None else complete, None),
        "tasa_parsing_exitoso": lambda: (parse(), None),
        "errores_validacion": lambda: (price_errors(), None),
        "disponibilidad_api": lambda: (available().cast("double"), None),
        "filas_cargadas_neon": lambda: (load_total(), None),
        "latencia_ingesta_ms": lambda: (load_ms(), None),
        "modelo_activo": lambda: (F.lit(None), model_field("modelo", NO_MODEL)),
        "recall_modelo": lambda: (model_field("recall", 0.0), None),
        "gini_modelo": lambda: (model_field("gini", 0.0), None),
        "clientes_alto_riesgo": lambda: (hr("clientes_alto_riesgo"), None),
        "tasa_riesgo_alto": lambda: (hr("tasa_riesgo_alto"), None),
        "tasa_respuesta_proveedores": lambda: (response(), None),
        "rondas_negociacion_prom": lambda: (mean_rounds(negotiations), None),
    }
    structs = []
    for k, build in builders.items():
        if only is not None and k not in only:
            continue
        v, t = build()
        structs.append(F.struct(F.lit(k).alias("kpi"), v.cast("double").alias("valor"),
                                (t if t is not None else F.lit(None)).cast("string").alias("texto")))
    if with_timestamp and (only is None or "timestamp" in only):
        structs.append(F.struct(F.lit("timestamp").alias("kpi"), F.lit(None).cast("double").alias("valor"),
                                F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("texto")))
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def value_text(kpi, v) -> F.Column:
    """Text of a KPI value as the reference prints it: booleans True/False,
    whole-number KPIs without decimals, others as doubles."""
    return (F.when(kpi == "disponibilidad_api", F.when(v == 1, F.lit("True")).otherwise(F.lit("False")))
            .when(kpi.isin(*INTEGER_KPIS), v.cast("bigint").cast("string"))
            .otherwise(v.cast("string")))


def alerts(report: DataFrame, rules: DataFrame) -> DataFrame:
    """Alert rows (key, valor, nivel, mensaje) for indicators past a threshold.

    max rules: ≥crit CRITICAL else ≥warn WARNING; min rules: ≤crit CRITICAL
    else ≤warn WARNING; bool rules: CRITICAL when false; null values skipped.
    """
    j = report.join(F.broadcast(rules), report["kpi"] == rules["key"], "inner")  # 10-row rule table
    v = F.col("valor")
    txt = value_text(F.col("key"), v)
    d = F.col("direccion")
    nivel = (F.when(v.isNull(), F.lit(None))
             .when(d == "bool", F.when(v == 0, F.lit("CRITICAL")))
             .when((d == "max") & (v >= F.col("crit")), F.lit("CRITICAL"))
             .when((d == "max") & (v >= F.col("warn")), F.lit("WARNING"))
             .when((d == "min") & (v <= F.col("crit")), F.lit("CRITICAL"))
             .when((d == "min") & (v <= F.col("warn")), F.lit("WARNING")))
    op = F.when(d == "max", F.lit("<=")).otherwise(F.lit(">="))
    msg = F.when(d == "bool", F.concat(F.col("label"), F.lit(" = "), txt, F.lit(" — API no disponible"))) \
        .otherwise(F.concat(
            F.col("label"), F.lit(" = "), txt,
            F.when(nivel == "CRITICAL", F.lit(" (umbral critico: ")).otherwise(F.lit(" (umbral warning: ")),
            op, F.when(nivel == "CRITICAL", F.col("crit_txt")).otherwise(F.col("warn_txt")), F.lit(")")))
    return (j.withColumn("nivel", nivel).filter(F.col("nivel").isNotNull())
             .select("key", txt.alias("valor"), "nivel", msg.alias("mensaje")))
