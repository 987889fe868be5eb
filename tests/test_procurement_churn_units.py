"""Unit checks of procurement and churn helpers on small frames."""

import random

from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.operators import churn as C
from cauce.operators import procurement as P


def test_update_and_status(spark):
    req = spark.createDataFrame([(1, 100.0, "pendiente"), (2, 50.0, "pendiente"), (3, 80.0, "en_proceso")],
                                "id long, presupuesto_max double, estado string")
    q = spark.createDataFrame([(1, 9, 1, 5, 90.0), (1, 8, 2, 5, 70.0), (3, 7, 1, 6, 80.0)],
                              "solicitud_id long, proveedor_id long, linea int, producto_id long, precio_total double")
    out = {r.id: r for r in P.complete_status(P.apply_best_quote_update(req, q)).collect()}
    assert (out[1].proveedor_elegido_id, out[1].ahorro_conseguido, out[1].estado) == (8, 30.0, "completada")
    assert (out[2].proveedor_elegido_id, out[2].ahorro_conseguido, out[2].estado) == (None, 0.0, "pendiente")
    assert (out[3].ahorro_conseguido, out[3].estado) == (0.0, "en_proceso")


def test_minmax_constant_and_median_fill(spark):
    q = spark.createDataFrame([(5.0,), (5.0,), (None,)], "precio_total double")
    rows = P.normalize_prices(q).collect()
    assert [r.precio_total for r in rows] == [5.0, 5.0, 5.0] and {r.precio_norm for r in rows} == {0.0}


def test_rule_table_join_equals_rule_chain(spark):
    rnd = random.Random(3)
    names = ["Laptops X", "resmas A4", "Papel", "Resmas de papel", "Otros", None, "TONER"]
    rows = [(i, rnd.choice(names), float(rnd.choice([50, 500, 5e4, 2e5, 2e7, 2e8]))) for i in range(300)]
    q = spark.createDataFrame(rows, "i int, producto string, precio_total double")
    by_join = {r.i: r.precio_valido for r in P.price_check_by_rule_table(q, R.price_rule_table(spark)).collect()}
    by_chain = {r.i: r.v for r in q.select("i", R.price_in_range("precio_total", "producto").alias("v")).collect()}
    assert by_join == by_chain


def test_value_counts_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",), ("a",)], "x string")
    assert [(r.x, r.n) for r in P.value_counts(df, "x").collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_weights_standardize_folds(spark):
    df = spark.createDataFrame([(i, i % 4 == 0, 3.0, float(i)) for i in range(200)],
                               "k long, y boolean, const double, v double").withColumn("y", F.col("y").cast("int"))
    w = {r.clase: r.peso for r in C.class_weights(df, "y").collect()}
    assert abs(w[1] * 50 + w[0] * 150 - 200) < 1e-9
    tr, _, params = C.standardize(df, None, ["const", "v"])
    assert {r.const_esc for r in tr.collect()} == {0.0}
    assert abs(sum(r.v_esc for r in tr.collect())) < 1e-9
    folds = {r.fold for r in C.with_folds(df, "k").collect()}
    assert folds <= set(range(C.N_FOLDS)) and len(folds) == C.N_FOLDS
