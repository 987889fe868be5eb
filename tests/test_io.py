"""Sources and sinks: strict/tolerant CSV, versions, appends, predictions, retries."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cauce.sinks import writers as W
from cauce.sources import files as FS


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="cauce-io-"), name)


def test_strict_csv_fails_and_tolerant_keeps_schema(spark):
    path = _tmp("bad.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,x\nzz,y\n")
    with pytest.raises(Exception):
        FS.read_csv_strict(spark, path, "a int, b string").collect()
    tol = FS.read_csv_tolerant(spark, path, "a int, b string").collect()
    assert [r.a for r in tol] == [1, None]
    missing = FS.read_csv_tolerant(spark, _tmp("nope.csv"), "a int, b string")
    assert missing.count() == 0 and missing.columns == ["a", "b"]


def test_typed_text_trims_and_nulls(spark):
    path = _tmp("t.csv")
    with open(path, "w") as f:
        f.write("edad,uso,nombre\n 30 ,1.5,  ana \n,abc,\n")
    rows = FS.read_typed_text(spark, path, int_cols=("edad",), float_cols=("uso",)).collect()
    assert (rows[0].edad, rows[0].uso, rows[0].nombre) == (30, 1.5, "ana")
    assert (rows[1].edad, rows[1].uso, rows[1].nombre) == (None, None, None)


def test_versions_appends_and_if_empty(spark):
    base = _tmp("tbl")
    W.write_version(spark.range(3), base, "r1")
    W.write_version(spark.range(5), base, "r2")
    assert W.read_latest(spark, base).count() == 5
    app = _tmp("app")
    assert W.append_if_empty(spark.range(2), app, "a") is True
    assert W.append_if_empty(spark.range(7), app, "b") is False
    assert spark.read.parquet(app).count() == 2


def test_appends_are_idempotent_and_unreadable_tables_are_errors(spark):
    app = _tmp("idem")
    for _ in range(2):
        W.append(spark.range(3), app, "r1")
    W.append(spark.range(4), app, "r2")
    assert spark.read.parquet(app).count() == 7
    broken = _tmp("broken")
    os.makedirs(f"{broken}/run=a")
    with open(f"{broken}/run=a/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        W.append_if_empty(spark.range(2), broken, "b")
    doc = _tmp("doc")
    os.makedirs(doc)
    with open(f"{doc}/m.json", "w") as f:
        f.write("{broken")
    assert W.read_metrics_doc(spark, doc).count() == 0 and W.read_metrics_doc(spark, _tmp("none")).count() == 0


def test_export_is_refused_by_role(spark):
    df = spark.createDataFrame([(1, 22, 0.9)], "cliente_id long, edad int, prob_abandono double")
    for role in ("auditor", "retencion"):
        with pytest.raises(PermissionError):
            W.export(df, role, _tmp("export"))
    path = _tmp("export")
    W.export(df, "analista", path)
    assert spark.read.option("header", True).csv(path).first().edad == "18-24"


def test_prediction_records_with_text_ids(spark):
    df = spark.createDataFrame([("b", 0.7, "ALTO"), (None, 0.1, "BAJO"), ("a", 0.4, "MEDIO")],
                               "cliente_id string, prob_abandono double, segmento_riesgo string")
    got = [(r.fila, r.entidad_id, r.score) for r in W.prediction_records(df).orderBy("fila").collect()]
    assert got == [(1, "a", 0.4), (2, "b", 0.7), (3, "3", 0.1)]


def test_prediction_records_number_missing_ids(spark):
    df = spark.createDataFrame([(None, 0.7, "ALTO"), (5, 0.1, "BAJO"), (None, 0.4, "MEDIO")],
                               "cliente_id int, prob_abandono double, segmento_riesgo string")
    recs = {r.probabilidad: r.entidad_id for r in W.prediction_records(df).collect()}
    assert recs[0.1] == "5" and {recs[0.7], recs[0.4]} <= {"1", "2", "3"}
    no_id = spark.createDataFrame([(0.2, "BAJO"), (0.9, "ALTO")], "prob_abandono double, segmento_riesgo string")
    assert sorted(r.entidad_id for r in W.prediction_records(no_id).collect()) == ["1", "2"]
    base = _tmp("preds")
    W.write_predictions(W.prediction_records(no_id), base)
    assert spark.read.json(f"{base}/manifiesto").first().total == 2
    assert W.read_predictions(spark, base, limit=1).count() == 1


def test_a_read_that_fails_while_running_is_retried(spark):
    waits, src, path = [], _tmp("late.csv"), _tmp("landed")
    with open(src, "w") as f:
        f.write("a\nbad\n")

    def pause(seconds):  # the source is repaired between the attempts
        waits.append(seconds)
        if len(waits) == 2:
            with open(src, "w") as f:
                f.write("a\n1\n2\n")
    got = FS.land_with_retry(lambda: FS.read_csv_strict(spark, src, "a int"), path, sleep=pause)
    assert waits == [1.0, 2.0] and sorted(r.a for r in got.collect()) == [1, 2]


def test_retry_backoff_and_fallback():
    waits = []

    def boom():
        raise OSError("down")

    assert FS.with_retry(boom, sleep=waits.append, fallback=lambda: "cache") == "cache"
    assert waits == [1.0, 2.0]
    with pytest.raises(OSError):
        FS.with_retry(boom, sleep=lambda s: None)
    assert F is not None


def test_landed_bytes_equal_the_source(spark, tmp_path):
    import glob

    from cauce.sources.files import land_raw
    data = b"id,producto\r\n1,caf\xe9 latin-1\r\n\r\n2,ni\xc3\xb1o\n3,\x00\xff\rx\n"
    (tmp_path / "raw.csv").write_bytes(data)
    landed = land_raw(spark, str(tmp_path / "raw.csv"), str(tmp_path / "zone"))
    assert b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{landed}/part-*"))) == data
