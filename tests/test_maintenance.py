"""Insert-ignore, upsert, sequential ids, constraints and FK checks."""

from pyspark.sql import functions as F

from cauce.operators import maintenance as MT


def test_sequential_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 5000, 3).withColumn("k", (F.col("id") * 7) % 5001).select("k")
    out = MT.sequential_ids(df, ["k"], col="n").collect()
    got = sorted((r.n, r.k) for r in out)
    assert [n for n, _ in got] == list(range(1, len(got) + 1))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_insert_ignore(spark):
    target = spark.createDataFrame([(1, "A"), (2, "B")], "id int, rut string")
    inc = spark.createDataFrame([(3, "B"), (4, "C"), (5, "C"), (6, None)], "id int, rut string")
    out = sorted((r.id, r.rut) for r in MT.insert_ignore(target, inc, "rut", ["id"]).collect())
    assert out == [(1, "A"), (2, "B"), (4, "C")]


def test_upsert_replaces_and_stamps(spark):
    target = spark.createDataFrame([(1, 0.1, None), (2, 0.2, None)], "k int, p double, ts timestamp")
    src = spark.createDataFrame([(2, 0.9), (3, 0.5)], "k int, p double")
    out = {r.k: r for r in MT.upsert(target, src, "k", "ts").collect()}
    assert out[1].p == 0.1 and out[2].p == 0.9 and out[3].ts is not None and out[1].ts is None


def test_constraints_and_orphans(spark):
    spec = [MT.ColumnSpec("a", "int", nullable=False, unique=True), MT.ColumnSpec("b", "string", default="x")]
    df = spark.createDataFrame([(1, None), (1, "y"), (None, "z")], "a int, b string")
    rep = {(r.restriccion, r.columna): r.violaciones for r in MT.constraint_report(df, spec).collect()}
    assert rep == {("NOT NULL", "a"): 1, ("UNIQUE", "a"): 1}
    assert [r.b for r in MT.conform(df, spec).collect()] == ["x", "y", "z"]
    parent = spark.createDataFrame([(1,)], "id int")
    assert MT.orphans(df, "a", parent, "id").count() == 0


def test_row_numbers_hot_leading_value_and_nulls(spark):
    from cauce.operators import ordering as O
    # a third of the rows share the leading value; nulls in both columns
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 101 == 0, F.lit(None))
        .otherwise(F.col("id")).alias("a"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") * 13 % 3011).alias("b"))
    out = O.row_numbers(df, ["a", "b"], col="n", n_buckets=8)
    assert [(r.a, r.b) for r in out.orderBy("n").collect()] == [(r.a, r.b) for r in df.orderBy("a", "b").collect()]
    sizes = [r["count"] for r in O.with_buckets(df, ["a", "b"], 8).groupBy("_bkt").count().collect()]
    assert max(sizes) < 3000 / 3  # the hot value is split across buckets


def test_conform_expression_default(spark):
    spec = [MT.ColumnSpec("id", "int", nullable=False), MT.ColumnSpec("estado", "string", default="pendiente"),
            MT.ColumnSpec("ts", "timestamp", default="=current_timestamp()")]
    df = spark.createDataFrame([(1, None), (2, "completada")], "id int, estado string")
    out = MT.conform(df, spec).collect()
    assert [r.estado for r in out] == ["pendiente", "completada"] and all(r.ts is not None for r in out)
    assert MT.conform(df, spec).columns == ["id", "estado", "ts"]


def test_bounds_are_data_not_plan(spark):
    """Planning does not depend on the number of buckets, and the search equals counting the bounds below."""
    import time

    from cauce.operators import ordering as O
    rows = [(None if i % 7 == 0 else float("nan") if i % 11 == 0 else -0.0 if i % 13 == 0 else (i * 37 % 101) / 3, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b long").repartition(5)
    taken, plans = {}, {}
    for n in (64, 2048):
        bucketed = O.with_buckets(df, ["a", "b"], n)
        start = time.time()
        plans[n] = bucketed._jdf.queryExecution().optimizedPlan().toString()
        taken[n] = time.time() - start
        bounds = [O._order_key(b) for b in O.bucket_bounds(df, ["a", "b"], n)]
        got = bucketed.collect()
        assert len({r["_bkt"] for r in got}) > n * 0.6
        assert all(r["_bkt"] == sum(b < O._order_key((r["a"], r["b"])) for b in bounds) for r in got[::29])
    assert len(plans[2048]) < 2 * len(plans[64]) and taken[2048] < 5 * taken[64] + 1
