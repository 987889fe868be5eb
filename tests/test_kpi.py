"""KPI alert rules and messages."""

from cauce.operators import kpi as K


def test_alert_levels_and_messages(spark):
    report = spark.createDataFrame(
        [("errores_validacion", 5.0, None), ("filas_cargadas_neon", 1.0, None),
         ("disponibilidad_api", 0.0, None), ("recall_modelo", 0.25, None),
         ("completitud_datos", 95.0, None), ("latencia_ingesta_ms", None, None)],
        "kpi string, valor double, texto string")
    got = {r.key: (r.nivel, r.mensaje) for r in K.alerts(report, K.rule_table(spark)).collect()}
    assert got["errores_validacion"] == ("WARNING", "Errores de validacion (N) = 5 (umbral warning: <=3)")
    assert got["filas_cargadas_neon"] == ("WARNING", "Filas Cargadas Neon = 1 (umbral warning: >=1)")
    assert got["disponibilidad_api"] == ("CRITICAL", "Disponibilidad API cotizaciones = False — API no disponible")
    assert got["recall_modelo"] == ("CRITICAL", "Recall del modelo churn = 0.25 (umbral critico: >=0.3)")
    assert "completitud_datos" not in got and "latencia_ingesta_ms" not in got


def test_load_counts_the_written_tables(spark, tmp_path):
    """Rows and watched aggregates equal those of the written tables, for an empty frame too."""
    from pyspark.sql import functions as F

    from cauce.plans import jobs as J
    some = spark.createDataFrame([(1, None, True), (2, "x", False), (2, "x", False), (None, None, None)], "a long, b string, ok boolean")
    watch = {"some": {"nulos": K.null_cells(["a", "b"]), "malos": F.count_if(~F.col("ok"))}, "none": {"nulos": K.null_cells(["a"])}}
    load = J.load_tables({"some": some.repartition(3), "none": some.limit(0), "plain": some}, str(tmp_path), "r1", watch)
    assert load.counts == {"some": 4, "none": 0, "plain": 4} and load.seconds > 0
    assert load.seen["some"] == {"filas": 4, "nulos": 3, "malos": 2} and load.seen["none"] == {"filas": 0, "nulos": 0}
    assert sorted(load.tables["some"].collect(), key=str) == sorted(some.collect(), key=str)
    n = F.lit(load.seen["some"]["filas"])
    got = spark.range(1).select(K.completeness(n, F.lit(load.seen["some"]["nulos"]), 2)).first()[0]
    assert got == K.completeness_of(some.select("a", "b")).first()[0] == 62.5
    assert spark.range(1).select(K.completeness(F.lit(0), F.lit(0), 2)).first()[0] == 0.0


def test_high_risk_from_score_groups(spark):
    from pyspark.sql import functions as F

    from cauce.functions import rules as R
    from cauce.operators import metrics as M
    rows = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.9, None), (0.5, 1), (None, 1), (0.1, 0)], "score double, label int")
    for df in (rows, rows.limit(0)):
        want = K.high_risk(df.select(R.risk_segment("score").alias("segmento_riesgo"))).first()
        assert K.high_risk_of_groups(M.score_groups(df), R.risk_segment("score")).first() == want


def test_latency_is_that_of_the_written_load(spark, sf_small, monkeypatch):
    from __spark_entry__ import queries
    from cauce.plans import jobs as J
    seen = []
    real = J.load_summary
    monkeypatch.setattr(J, "load_summary", lambda spark, counts, seconds: seen.append(seconds) or real(spark, counts, seconds))
    row = queries()["kpi_latency"](spark, sf_small).first()
    assert row.kpi == "latencia_ingesta_ms" and row.valor == round(seen[0], 3) * 1000 > 0


def test_report_reads_lineitem_twice(spark, sf_small):
    """One scan for the quotes; the scores' groups are a written table."""
    from cauce.plans.q_kpi import kpi_report_df
    report = kpi_report_df(spark, sf_small)
    report.collect()
    import re
    plan = report._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert len(set(re.findall(r"lineitem\.parquet", final))) <= 1


def test_report_has_the_latency_of_all_rows(spark, sf_small):
    """The report, its alerts and its sink count every loaded row into the latency."""
    from __spark_entry__ import oracle_sql, queries
    from cauce.sources import tables as T
    rows = sum(f(spark, sf_small).count() for f in (T.requests, T.quotes, T.suppliers, T.negotiations))
    for name in ("kpi_report", "sink_kpi"):
        got = {r.kpi: r.valor for r in queries()[name](spark, sf_small).collect()}
        assert got["filas_cargadas_neon"] == rows and got["latencia_ingesta_ms"] == rows / 20000 * 1000
        assert "20000.0" in oracle_sql()[name]
