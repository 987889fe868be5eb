"""Composed jobs: procurement, churn and sales, as Spark applications.

Each job builds lazy DataFrames stage by stage and acts only at sinks.
Outputs go to ``<out>/<table>/run=<run_id>`` (a new version per run); a
rerun of a run rewrites its own version only.  A run is listed in the manifest
``<out>/corridas`` as its last step, and readers of the newest version see
listed runs only, so a job that dies halfway leaves nothing they would read.  Entry points take a
session so ``spark-submit`` wrappers stay one line.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.operators import churn as C
from cauce.operators import kpi as K
from cauce.operators import privacy as PV
from cauce.operators import procurement as P
from cauce.operators import quality as Q
from cauce.operators import sales as S
from cauce.sinks import writers as W
from cauce.sources import tables as T


def new_run_id() -> str:
    return time.strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:6]


def _summary(spark: SparkSession, counts: dict) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in counts.items()], "tabla string, filas long")


def load_summary(spark: SparkSession, counts: dict, seconds: float) -> DataFrame:
    """The load's one-row summary: total rows and seconds of the whole load."""
    return spark.createDataFrame([(sum(counts.values()), round(float(seconds), 3))], "total_filas long, duracion_s double")


@dataclass
class Load:
    """What a load wrote: the written tables, their rows, further counts of them, its seconds."""
    tables: dict
    counts: dict
    seen: dict
    seconds: float


def load_tables(frames: dict, out_dir: str, run_id: str, watch: dict | None = None) -> Load:
    """Write each frame as a new version; the frames returned read the written versions (lineage ends at a
    durable table).  Rows, and the aggregates that ``watch`` names for a table ({name: Column}), are one
    aggregate of the written version that reads only their columns.  (``DataFrame.observe`` would save that read,
    but it leaves an object in the session that Spark ML's closures cannot serialise afterwards.)"""
    t0 = time.perf_counter()
    tables, counts, seen = {}, {}, {}
    for name, df in frames.items():
        extra = [c.alias(k) for k, c in (watch or {}).get(name, {}).items()]
        path = W.write_version(df, f"{out_dir}/{name}", run_id)
        tables[name] = df.sparkSession.read.schema(df.schema).parquet(path)
        seen[name] = tables[name].agg(F.count(F.lit(1)).alias("filas"), *extra).first().asDict()
        counts[name] = seen[name]["filas"]
    return Load(tables, counts, seen, time.perf_counter() - t0)


# ---------------------------------------------------------------------------
# procurement: ingest → transform → validate → pseudonymise → load → KPIs
# ---------------------------------------------------------------------------

def transform_all(store: dict) -> dict:
    """Stage 2: urgency, price normalisation, lead-time band, supplier counts,
    best-quote enrichment.  Missing inputs are skipped (column/table guards)."""
    out = dict(store)
    if "Cotizaciones" in out:
        q = P.normalize_prices(out["Cotizaciones"])
        q = q.withColumn("plazo_categoria", R.lead_time_bucket("plazo_dias")) if "plazo_dias" in q.columns else q
        out["Cotizaciones"] = q
        if "proveedor_nombre" in q.columns:
            out["Resumen_Cotizaciones"] = P.quotes_by_supplier(q)
        elif "Proveedores" in out:  # names meet one row per supplier, not every quote
            out["Resumen_Cotizaciones"] = P.quotes_by_named_supplier(q, out["Proveedores"])
    if "Solicitudes" in out and "Cotizaciones" in out:
        out["Solicitudes"] = P.enrich_requests(out["Solicitudes"], out["Cotizaciones"], out.get("Proveedores"))
    elif "Solicitudes" in out and "urgencia" in out["Solicitudes"].columns:
        out["Solicitudes"] = out["Solicitudes"].withColumn("urgencia_categoria", R.urgency_category("urgencia"))
    return out


def validate_all(store: dict) -> dict:
    """Stage 3: RUT format, price ranges and risk levels (flags are kept, D1)."""
    out = dict(store)
    if "Proveedores" in out:
        out["Proveedores"] = out["Proveedores"].withColumn("rut_valido", R.rut_is_valid("rut"))
    if "Cotizaciones" in out:
        q = out["Cotizaciones"].withColumn("precio_valido", R.price_in_range("precio_total", "producto"))
        out["Cotizaciones"] = q.withColumn("nivel_riesgo", R.risk_level("risk_score"))
    return out


#: Tables of the procurement load, in writing order.
LOADED = ("Proveedores", "Solicitudes", "Cotizaciones", "Negociaciones")


def load_all(store: dict, out_dir: str, run_id: str) -> dict:
    """Stage 5: write each table as a new version; the best-quote update and
    the status completion are applied to the requests being written (D2).

    ``Conteos`` holds what was counted of the written tables: null cells of the columns that the requests
    had before the update, and prices out of their range."""
    out = dict(store)
    watch = {}
    if "Solicitudes" in out:
        watch["solicitudes"] = {"nulos": K.null_cells(out["Solicitudes"].columns)}
    if "Cotizaciones" in out and "precio_valido" in out["Cotizaciones"].columns:
        watch["cotizaciones"] = {"errores": F.count_if(~F.col("precio_valido"))}
    if "Solicitudes" in out and "Cotizaciones" in out:
        out["Solicitudes"] = P.complete_status(P.apply_best_quote_update(out["Solicitudes"], out["Cotizaciones"]))
    names = {n.lower(): n for n in LOADED if n in out}
    load = load_tables({k: out[n] for k, n in names.items()}, out_dir, run_id, watch)
    out.update({n: load.tables[k] for k, n in names.items()})
    spark = next(iter(store.values())).sparkSession
    out["Filas_Cargadas"] = _summary(spark, load.counts)
    out["Resumen_Carga"] = load_summary(spark, load.counts, load.seconds)
    out["Conteos"] = load.seen
    return out


def score_portfolio(spark: SparkSession, sf_dir: str, out_dir: str, run_id: str, model_dir: str | None) -> tuple:
    """Stage 4: score the portfolio with the newest saved model and write it.

    Without a saved model the documented fallback segment is written and the
    KPIs report no model.  Returns (written scores, selected model's metrics or None).
    """
    portfolio = T.portfolio(spark, sf_dir)
    saved = W.latest_run(spark, f"{model_dir}/modelo") if model_dir else None
    metrics = None
    if saved:
        model, prep = C.load_model(saved)
        scored = C.score(portfolio, model, prep["features"], prep["params"], prep["scaled"], prep["fills"])
        doc = W.latest_run(spark, f"{model_dir}/metricas")
        if doc:
            chosen = F.col("metricas_por_modelo")[F.col("modelo_seleccionado")]
            metrics = W.read_metrics_doc(spark, doc).select(
                F.col("modelo_seleccionado").alias("modelo"), chosen["recall"].alias("recall"), chosen["gini"].alias("gini"))
    else:
        scored = portfolio.withColumn("prob_abandono", F.lit(None).cast("double")).withColumn(
            "segmento_riesgo", R.fallback_segment("reclamos"))
        scored = scored.withColumn("accion_retencion", R.retention_action("segmento_riesgo"))
    path = W.write_version(scored, f"{out_dir}/clientes_scoreados", run_id)
    return spark.read.parquet(path), metrics


def run_procurement(spark: SparkSession, sf_dir: str, out_dir: str, run_id: str | None = None,
                    salt: str | None = None, model_dir: str | None = None) -> DataFrame:
    """The whole procurement run; ``model_dir`` is the output folder of a churn run whose model scores
    the portfolio.  Returns the rows loaded per table."""
    run_id = run_id or new_run_id()
    salt = salt or R.salt_from(spark)
    W.begin_run(spark, out_dir, run_id)
    q = T.quotes(spark, sf_dir)
    store = {"Solicitudes": T.requests(spark, sf_dir), "Proveedores": T.suppliers(spark, sf_dir),
             "Cotizaciones_Raw": q, "Cotizaciones": parsed_quotes(q), "Negociaciones": T.negotiations(spark, sf_dir)}
    store = transform_all(store)
    store = validate_all(store)
    scored, model_metrics = score_portfolio(spark, sf_dir, out_dir, run_id, model_dir)
    store["Proveedores"] = PV.add_rut_hash(store["Proveedores"], salt)
    audit = PV.audit_record(spark, "SEUDONIMIZAR", "cauce.plans.jobs.run_procurement", "proveedores.rut",
                            store["Proveedores"].agg(F.count(F.lit(1))).scalar(), "metodo=SHA256+sal")
    W.append(audit, f"{out_dir}/auditoria", run_id)
    answered = W.write_version(q.filter(is_parsed()).groupBy("proveedor_id").agg(F.count(F.lit(1)).alias("cotizaciones")),
                               f"{out_dir}/cotizaciones_por_proveedor", run_id)
    n_columns, raw = len(store["Solicitudes"].columns), store["Cotizaciones_Raw"]
    store = load_all(store, out_dir, run_id)
    W.append(store["Resumen_Carga"], f"{out_dir}/resumen_carga", run_id)
    report = K.kpi_report(spark, scored=scored, load_summary=store["Resumen_Carga"], model_metrics=model_metrics,
                          negotiations=store["Negociaciones"],
                          catalog_size=store["Proveedores"].agg(F.count(F.lit(1))).scalar(),
                          **counted_kpis(spark, store["Conteos"], n_columns, raw.agg(F.count(F.lit(1))).scalar(),
                                         spark.read.parquet(answered)))
    W.append(report, f"{out_dir}/kpi", run_id)
    W.append(K.alerts(report, K.rule_table(spark)), f"{out_dir}/alertas", run_id)
    W.commit_run(spark, out_dir, run_id, "procurement")
    return store["Filas_Cargadas"]


def counted_kpis(spark: SparkSession, seen: dict, n_columns: int, n_raw: F.Column, by_supplier: DataFrame) -> dict:
    """The KPI inputs that the load counted, without another pass over requests or quotes:
    completeness, and the row of quote statistics (suppliers from the counts per supplier)."""
    asked, quoted = seen["solicitudes"], seen["cotizaciones"]
    stats = spark.range(1).select(
        n_raw.alias("n_raw"), F.lit(quoted["filas"]).alias("n_ok"), F.lit(quoted["errores"]).alias("errors"),
        by_supplier.agg(F.count("proveedor_id")).scalar().alias("suppliers"))
    return {"complete": K.completeness(F.lit(asked["filas"]), F.lit(asked["nulos"]), n_columns), "stats": stats}


def is_parsed() -> F.Column:
    """Quotes that parse: a price and a lead time."""
    return F.col("precio_total").isNotNull() & ~F.isnan("precio_total") & F.col("plazo_dias").isNotNull()


def parsed_quotes(quotes: DataFrame) -> DataFrame:
    return quotes.filter(is_parsed())


# ---------------------------------------------------------------------------
# churn: train → persist metrics/model → score → persist predictions
# ---------------------------------------------------------------------------

def run_churn(spark: SparkSession, sf_dir: str, out_dir: str, run_id: str | None = None,
              with_grid: bool = False) -> DataFrame:
    run_id = run_id or new_run_id()
    W.begin_run(spark, out_dir, run_id)
    t0 = time.perf_counter()
    # training, quality report and scoring take some ten passes: the table is derived once for all of them
    portfolio = T.portfolio(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _churn_of(portfolio, out_dir, run_id, t0, with_grid)
    finally:
        portfolio.unpersist()


def _churn_of(portfolio: DataFrame, out_dir: str, run_id: str, t0: float, with_grid: bool) -> DataFrame:
    """:func:`run_churn` of a portfolio, from the training on."""
    spark = portfolio.sparkSession
    t = C.train_and_select(portfolio, T.FEATURES, T.TARGET, "cliente_id", with_grid=with_grid)
    table = C.model_table(t["results"])
    W.write_csv(table.coalesce(1), f"{out_dir}/comparacion_modelos/run={run_id}")
    C.save_model(t["best_model"], f"{out_dir}/modelo/run={run_id}", T.FEATURES, t["params"], t["scaled"], t["fills"])
    best = t["results"][t["best_name"]]["metrics"]
    conf = t["confusion"].first()
    metrics_row = spark.range(1).select(
        F.current_timestamp().alias("ts"), *[F.lit(float(best[k])).alias(k) for k in
                                             ("accuracy", "recall", "precision", "f1", "roc_auc", "gini")],
        F.to_json(F.array(F.array(F.lit(conf["tn"]), F.lit(conf["fp"])),
                          F.array(F.lit(conf["fn"]), F.lit(conf["tp"])))).alias("matriz_confusion"),
        F.lit(t["best_name"]).alias("modelo"),
        F.lit(portfolio.count()).cast("bigint").alias("n_samples"),
        F.lit(round(time.perf_counter() - t0, 3)).alias("tiempo_total_s"))
    W.append(metrics_row, f"{out_dir}/ml_metricas", run_id)
    profile = portfolio.select(*T.FEATURES, T.TARGET)
    doc = C.metrics_document(t, Q.quality_report(profile, T.TARGET), time.perf_counter() - t0)
    W.write_json(doc.coalesce(1), f"{out_dir}/metricas/run={run_id}")
    scored = C.score(portfolio, t["best_model"], T.FEATURES, t["params"], t["scaled"], t["fills"])
    # score once: write the scored table, then derive the prediction records from it
    path = W.write_version(scored, f"{out_dir}/clientes_scoreados", run_id, partition_by="segmento_riesgo")
    records = W.prediction_records(spark.read.parquet(path))
    W.write_predictions(records, f"{out_dir}/predicciones/run={run_id}")
    W.commit_run(spark, out_dir, run_id, "churn")
    return table


# ---------------------------------------------------------------------------
# sales: clean → validate → quarantine → load-ready check → load → verify
# ---------------------------------------------------------------------------

def run_sales(spark: SparkSession, sf_dir: str, out_dir: str, run_id: str | None = None,
              source: str = S.SOURCE_TAG) -> DataFrame:
    """Clean, validate, quarantine, check and load the raw sales (D15).

    Cleaning drops repeated deliveries, rows with missing fields and rows whose
    numbers or date do not parse; validation judges what is left.
    """
    run_id = run_id or new_run_id()
    W.begin_run(spark, out_dir, run_id)
    cleaned = S.cleaned_text(T.sales_raw(spark, sf_dir))
    flagged = S.validate_sales(cleaned, keep_parsed=True)
    flagged_path = W.write_version(flagged, f"{out_dir}/ventas_validadas", run_id)  # one pass, reused twice
    flagged = spark.read.parquet(flagged_path)
    valid, bad = S.split_quarantine(flagged)
    clean = S.project_clean(S.tag_valid(valid, source))
    rejected = S.project_rejected(S.tag_rejected(bad, source))
    counts = {}
    for name, df, req in (("ventas_clean", clean, S.CLEAN_REQUIRED), ("ventas_error", rejected, S.ERROR_REQUIRED)):
        errors = S.load_ready_errors(df, req)
        if errors.isEmpty():
            W.append(df, f"{out_dir}/{name}", run_id)
            counts[name] = spark.read.parquet(f"{out_dir}/{name}").filter(F.col("run") == run_id).count()
        else:
            counts[name] = 0
    W.commit_run(spark, out_dir, run_id, "sales")
    return _summary(spark, counts)
