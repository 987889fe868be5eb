"""Composed jobs write every output and read back consistently."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cauce.operators import kpi as K
from cauce.operators import sales as S
from cauce.plans import jobs as J
from cauce.sinks import writers as W
from cauce.sources import tables as T


def test_sales_job_counts(spark, sf_small):
    out = tempfile.mkdtemp(prefix="cauce-job-sales-")
    summary = {r.tabla: r.filas for r in J.run_sales(spark, sf_small, out, "r1").collect()}
    kept = S.clean_sales(T.sales_raw(spark, sf_small).select(*S.RAW_COLUMNS, "descuento"), [*S.RAW_COLUMNS]).count()
    assert summary["ventas_clean"] + summary["ventas_error"] == kept and summary["ventas_error"] > 0
    clean = spark.read.parquet(f"{out}/ventas_clean")
    assert clean.select("id").distinct().count() == clean.count()  # repeated deliveries are gone
    J.run_sales(spark, sf_small, out, "r1")  # the same run again changes nothing
    assert spark.read.parquet(f"{out}/ventas_clean").count() == summary["ventas_clean"]
    err = spark.read.parquet(f"{out}/ventas_error")
    assert err.filter(F.col("observacion") == "Registro válido").count() == 0


def test_procurement_job_outputs(spark, sf_small):
    out = tempfile.mkdtemp(prefix="cauce-job-proc-")
    with pytest.raises(ValueError, match="salt"):
        J.run_procurement(spark, sf_small, out, "r1")
    summary = {r.tabla: r.filas for r in J.run_procurement(spark, sf_small, out, "r1", salt="s").collect()}
    assert summary["solicitudes"] == T.requests(spark, sf_small).count()
    req = W.read_latest(spark, f"{out}/solicitudes")
    assert req.filter((F.col("estado") == "pendiente") & F.col("proveedor_elegido_id").isNotNull()).count() == 0
    sup = W.read_latest(spark, f"{out}/proveedores")
    assert "rut_hash" in sup.columns and "rut_valido" in sup.columns
    kpis = {r.kpi: r for r in spark.read.parquet(f"{out}/kpi").collect()}
    load = spark.read.parquet(f"{out}/resumen_carga").collect()
    assert len(load) == 1 and load[0].total_filas == sum(summary.values()) and load[0].duracion_s > 0
    fallback = spark.read.parquet(f"{out}/clientes_scoreados/run=r1")
    high = fallback.filter("segmento_riesgo = 'ALTO'").count()
    quotes = spark.read.parquet(f"{out}/cotizaciones/run=r1")
    want = {"filas_cargadas_neon": sum(summary.values()), "latencia_ingesta_ms": load[0].duracion_s * 1000, "recall_modelo": 0.0,
            "gini_modelo": 0.0, "clientes_alto_riesgo": high, "tasa_riesgo_alto": round(high / fallback.count() * 100, 2),
            "disponibilidad_api": 1.0, "errores_validacion": quotes.filter(~F.col("precio_valido")).count(),
            "tasa_parsing_exitoso": 100.0,
            "tasa_respuesta_proveedores": round(quotes.select("proveedor_id").distinct().count() / summary["proveedores"] * 100, 1),
            "rondas_negociacion_prom": round(spark.read.parquet(f"{out}/negociaciones/run=r1").agg(F.avg("ronda")).first()[0], 1)}
    for name, value in want.items():
        assert kpis[name].valor == pytest.approx(value), name
    assert kpis["modelo_activo"].texto == K.NO_MODEL and 0 < kpis["completitud_datos"].valor < 100 and "timestamp" in kpis
    assert os.path.isdir(f"{out}/auditoria")


def test_churn_job_and_stream_score(spark, sf_small):
    out = tempfile.mkdtemp(prefix="cauce-job-churn-")
    table = J.run_churn(spark, sf_small, out, "r1")
    assert table.count() == 4
    n = T.portfolio(spark, sf_small).count()
    doc = W.read_metrics_doc(spark, f"{out}/metricas/run=r1").first()
    assert doc.modelo_seleccionado in doc.metricas_por_modelo and len(doc.matriz_confusion) == 2
    proc = tempfile.mkdtemp(prefix="cauce-job-proc-")  # the saved model scores the procurement run's portfolio
    J.run_procurement(spark, sf_small, proc, "r1", salt="s", model_dir=out)
    kpis = {r.kpi: r for r in spark.read.parquet(f"{proc}/kpi").collect()}
    assert kpis["modelo_activo"].texto == doc.modelo_seleccionado
    assert kpis["recall_modelo"].valor == doc.metricas_por_modelo[doc.modelo_seleccionado].recall
    assert kpis["clientes_alto_riesgo"].valor == spark.read.parquet(
        f"{out}/clientes_scoreados/run=r1").filter("segmento_riesgo = 'ALTO'").count()
    man = spark.read.json(f"{out}/predicciones/run=r1/manifiesto").first()
    assert man.total == n
    loaded = spark.read.parquet(f"{out}/clientes_scoreados/run=r1")
    assert loaded.count() == n and set(r[0] for r in loaded.select("segmento_riesgo").distinct().collect()) <= \
        {"ALTO", "MEDIO", "BAJO"}
    from __spark_entry__ import queries
    scored = queries()["stream_score"](spark, sf_small)
    assert scored.count() == n
    assert scored.filter(~F.col("perfil_valido") & F.col("prob_abandono").isNotNull()).count() == 0
    assert scored.filter(F.col("perfil_valido") & F.col("prob_abandono").isNull()).count() == 0


def test_a_run_that_died_halfway_is_not_read(spark, tmp_path):
    out = str(tmp_path / "out")
    for run, n, dies in (("r1", 3, False), ("r2", 5, True)):
        W.begin_run(spark, out, run)
        W.write_version(spark.range(n), f"{out}/tabla", run)
        if dies:
            continue  # the second table and the manifest are never written
        W.write_version(spark.range(n), f"{out}/otra", run)
        W.commit_run(spark, out, run, "prueba")
    assert W.read_latest(spark, f"{out}/tabla").count() == W.read_latest(spark, f"{out}/otra").count() == 3
    assert W.latest_run(spark, f"{out}/modelo") is None
    W.write_version(spark.range(5), f"{out}/otra", "r2")
    W.commit_run(spark, out, "r2", "prueba")
    assert W.read_latest(spark, f"{out}/tabla").count() == 5
    W.begin_run(spark, out, "r2")  # run again: off the manifest until it is complete
    assert W.read_latest(spark, f"{out}/tabla").count() == 3
    W.begin_run(spark, str(tmp_path / "new"), "r1")
    W.write_version(spark.range(1), str(tmp_path / "new" / "tabla"), "r1")
    with pytest.raises(FileNotFoundError):
        W.read_latest(spark, str(tmp_path / "new" / "tabla"))


def test_a_version_without_its_success_mark_is_not_read(spark, tmp_path):
    base = str(tmp_path / "sola" / "tabla")
    W.write_version(spark.range(2), base, "r1")
    W.write_version(spark.range(9), base, "r2")
    os.remove(f"{base}/run=r2/_SUCCESS")
    assert W.read_latest(spark, base).count() == 2
