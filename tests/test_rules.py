"""Scalar rules on the reference's own fixtures (FIXTURES.md part A)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.operators import privacy as PV
from cauce.operators import sales as S

# FIXTURES.md A8: the 8 injected rows and their expected observations
A8 = [
    ("1", "2024-01-01", "Notebook", "1", "800000", "Santiago", "Registro válido"),
    ("2", "2024-01-02", "Mouse", "2", "15000", "Santiago", "Registro válido"),
    ("3", "2024/01/01", "Teclado", "1", "25000", "Valparaiso", "Fecha inválida"),
    ("4", "2024-01-04", "Monitor", "1", "abc", "Concepcion", "Precio no numérico"),
    ("5", "2024-01-05", "Notebook", "dos", "800000", "Santiago", "Cantidad no numérica"),
    ("6", "2024-01-06", "Mouse", None, "15000", "Santiago", "Cantidad fuera de rango lógico"),
    ("7", None, "Teclado", "1", "25000", "Valparaiso", "Fecha inválida"),
    ("8", "2024-01-08", "Notebook", "1", "800000", "Santiago", "Registro válido"),
]

# FIXTURES.md A7: raw sales file (all text)
A7 = [
    ("1", "2024-01-01", "Notebook", "1", "800000", "Santiago"),
    ("2", "2024/01/02", "Mouse", "2", "15000", "Santiago"),
    ("3", "2024-01-03", "Teclado", "1", "25000", "Valparaiso"),
    ("4", "2024-01-03", "Teclado", "1", "25000", "Valparaiso"),
    ("5", "2024-01-04", "Monitor", None, "120000", "Concepcion"),
    ("6", "2024-01-05", "Notebook", "1", "800000", "Santiago"),
    ("7", "2024-01-06", "Mouse", "2", "15000", None),
    ("8", "2024-01-07", "Teclado", "1", "abc", "Valparaiso"),
    ("9", "2024-01-08", "Notebook", "1", "800000", "Santiago"),
    ("10", "2024-01-08", "Notebook", "1", "800000", "Santiago"),
    ("10", "2024-01-08", "Notebook", "1", "800000", "Santiago"),
]
RAW_SCHEMA = "id string, fecha string, producto string, cantidad string, precio string, ciudad string"


def test_validation_messages_match_fixture(spark):
    df = spark.createDataFrame([r[:6] for r in A8], RAW_SCHEMA)
    got = {r.id: r.observaciones for r in S.validate_sales(df).collect()}
    assert got == {r[0]: r[6] for r in A8}


def test_quarantine_split_and_lineage(spark):
    df = S.validate_sales(spark.createDataFrame([r[:6] for r in A8], RAW_SCHEMA))
    valid, bad = S.split_quarantine(df)
    assert sorted(r.id for r in valid.collect()) == ["1", "2", "8"]
    clean = S.project_clean(S.tag_valid(valid))
    assert clean.columns == S.CLEAN_COLUMNS
    assert {r.estado_calidad for r in clean.collect()} == {"valido"}
    rej = S.project_rejected(S.tag_rejected(bad))
    assert rej.columns == S.ERROR_COLUMNS
    assert S.load_ready_errors(clean, S.CLEAN_REQUIRED).count() == 0
    assert S.load_ready_errors(rej, S.ERROR_REQUIRED).count() == 0
    errs = [r.error for r in S.load_ready_errors(df, S.CLEAN_REQUIRED).collect()]
    assert "Falta la columna obligatoria: estado_calidad" in errs
    assert "La columna fecha contiene valores nulos" in errs


def test_cleaning_keeps_expected_ids(spark):
    df = spark.createDataFrame(A7, RAW_SCHEMA)
    got = sorted(int(r.id) for r in S.clean_sales(df).collect())
    assert got == [1, 3, 4, 6, 9, 10]
    totals = {r.id: r.total for r in S.clean_sales(df).collect()}
    assert totals["1"] == 800000.0


def test_pseudonym_equals_sha256(spark):
    vals = ["76.123.456-7", "1001", "x"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.h for r in df.select(R.pseudonym("v", "s3cret").alias("h")).collect()]
    assert got == [hashlib.sha256(f"s3cret:{v}".encode()).hexdigest()[:16] for v in vals]


def test_role_views_on_demo_rows(spark):
    demo = spark.createDataFrame(
        [(1001, 22, 4, 0.91, "ALTO"), (1002, 47, 1, 0.30, "MEDIO"), (1003, 68, 0, 0.05, "BAJO")],
        "cliente_id long, edad int, reclamos int, prob_abandono double, segmento_riesgo string")
    assert [r.edad for r in PV.role_view(demo, "admin").collect()] == [22, 47, 68]
    ret = PV.role_view(demo, "retencion")
    assert [r.edad for r in ret.orderBy("cliente_id").collect()] == ["18-24", "45-54", "65+"]
    assert "prob_abandono" in ret.columns
    aud = PV.role_view(demo, "auditor")
    assert "prob_abandono" not in aud.columns and "segmento_riesgo" not in aud.columns
    with pytest.raises(PermissionError):
        PV.role_view(demo, "intruso")
    assert PV.can_export("analista") and not PV.can_export("retencion") and not PV.can_export("nadie")


def _eval(spark, col_expr, values, typ):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(col_expr).collect()]


def test_segments_and_actions(spark):
    got = _eval(spark, R.risk_segment("x"), [0.6, 0.5999, 0.35, 0.3499, None], "double")
    assert got == ["ALTO", "MEDIO", "MEDIO", "BAJO", None]
    acts = _eval(spark, R.retention_action("x"), ["ALTO", "MEDIO", "BAJO"], "string")
    assert acts[2] == "Monitoreo estándar"


def test_urgency_and_bins(spark):
    assert _eval(spark, R.urgency_category("x"), ["ALTA", "Media", "baja", "otra", None], "string") == \
        ["Critico", "Programado", "No critico", "Programado", "Programado"]
    assert _eval(spark, R.lead_time_bucket("x"), [0.0, 7.0, 7.5, 14.0, 100.0, 101.0], "double") == \
        [None, "Corto (<=7d)", "Medio (8-14d)", "Medio (8-14d)", "Largo (>14d)", None]
    assert _eval(spark, R.risk_level("x"), [-1.0, 0.0, 10.0, 25.0, 40.0], "double") == \
        [None, "Bajo", "Bajo", "Medio", "Alto"]
    assert _eval(spark, R.age_band("x"), [18, 24, 25, 64, 65, None], "int") == \
        ["18-24", "18-24", "25-34", "55-64", "65+", None]


def test_price_rule_first_keyword_wins(spark):
    df = spark.createDataFrame([("Resmas de papel", 5000000.0), ("Papel carta", 5000000.0),
                                ("Insumos varios", 1.0), ("laptops pro", 50000.0), (None, 5.0)],
                               "producto string, precio double")
    got = [r[0] for r in df.select(R.price_in_range("precio", "producto")).collect()]
    assert got == [True, False, True, False, True]


def test_rut_format(spark):
    vals = ["76.123.456-7", " \t76.123.456-K ", "7.123.456-k", "76123456-7", "76.123.456-X", None,
            "\u0667\u0666.123.456-7", "76.123.456-\u0667", "\u300076.123.456-7\u00a0"]
    assert _eval(spark, R.rut_is_valid("x"), vals, "string") == [True, True, True, False, False, False,
                                                                  True, False, True]


def test_numeric_and_date_guards(spark):
    assert _eval(spark, R.to_double("x"), ["1", " 2.5 ", "1e3", "abc", "1d", "1_000", "nan", None], "string") == \
        [1.0, 2.5, 1000.0, None, None, None, None, None]
    assert _eval(spark, R.is_iso_date("x"), ["2024-01-01", "2024-1-1", "2024/01/01", "2024-02-30", None],
                 "string") == [True, False, False, False, False]
    sav = spark.createDataFrame([(100.0, 80.0), (0.0, 5.0), (100.0, None)], "b double, p double")
    assert [r[0] for r in sav.select(R.savings_pct("b", "p")).collect()] == [20.0, None, None]
    assert F is not None
