"""Streaming equals batch; churn models train, score and segment."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from cauce.operators import churn as C
from cauce.operators import procurement as P
from cauce.sources import tables as T
from cauce.streaming import quotes as S


def test_stream_best_quote_equals_batch(spark, sf_small):
    s = S.best_quote_stream(S.quote_stream(spark, sf_small, max_files_per_trigger=1))
    got = S.read_updates(spark, S.run_to_table(s, "t_best", "update"), "producto_id")
    exp = P.best_quote_per_product(T.quotes(spark, sf_small))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_running_tables_over_several_files_and_a_restart(spark, sf_small, tmp_path):
    """Three files in four micro-batches, the last after a restart from the checkpoint: the
    tables hold one row per key, equal to the batch result after each run."""
    lines = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    feed = tmp_path / "feed"
    feed.mkdir()

    def arrive(i):
        lines.filter(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(4)) == i).coalesce(1).write.parquet(f"{tmp_path}/part{i}")
        (name,) = [p for p in (tmp_path / f"part{i}").iterdir() if p.suffix == ".parquet"]
        name.rename(feed / f"lineitem-{i}.parquet")

    def check(root_best, root_counts):
        s = S.quote_stream(spark, str(feed), max_files_per_trigger=1)
        best = S.read_updates(spark, S.run_to_table(S.best_quote_stream(s), "b", "update", root_best), "producto_id")
        counts = S.read_updates(spark, S.run_to_table(S.supplier_counts_stream(s), "c", "update", root_counts), "proveedor_id")
        seen = T.quotes_from(spark.read.parquet(str(feed)))
        want = P.best_quote_per_product(seen)
        assert best.exceptAll(want).count() == 0 and want.exceptAll(best).count() == 0
        want = S.supplier_counts_stream(seen)
        assert counts.exceptAll(want).count() == 0 and want.exceptAll(counts).count() == 0
        return best

    roots = str(tmp_path / "best"), str(tmp_path / "counts")
    for i in range(3):
        arrive(i)
    check(*roots)
    arrive(3)
    best = check(*roots)  # a new query on the same checkpoint
    batches = spark.read.parquet(f"{roots[0]}/table").select("batch").distinct().count()
    assert batches == 4
    path = S.compact_updates(spark, f"{roots[0]}/table", "producto_id", "v1")
    assert spark.read.parquet(path).count() == best.count()


def test_compaction_every_second_batch(spark, sf_small, tmp_path):
    """Five files and a restart: a reader opens one version and at most one batch; older parts no longer matter."""
    import shutil
    lines = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    feed = tmp_path / "feed"
    feed.mkdir()
    root = str(tmp_path / "best")
    out = f"{root}/table"

    def run(files):
        for i in files:
            lines.filter(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(5)) == i).coalesce(1).write.parquet(f"{tmp_path}/p{i}")
            (name,) = [p for p in (tmp_path / f"p{i}").iterdir() if p.suffix == ".parquet"]
            name.rename(feed / f"lineitem-{i}.parquet")
        s = S.best_quote_stream(S.quote_stream(spark, str(feed), max_files_per_trigger=1))
        S.run_to_table(s, "b", "update", root, keys="producto_id", every=2)
        return P.best_quote_per_product(T.quotes_from(spark.read.parquet(str(feed))))

    def same(want):
        got = S.read_updates(spark, out, "producto_id")
        return got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

    assert same(run(range(3))) and S.pending_parts(spark, out) == (1, [2])
    want = run([3, 4])  # a new query on the same checkpoint
    assert same(want) and S.pending_parts(spark, out) == (3, [4])
    assert S.compact_batches(spark, out, "producto_id", 3).endswith("batch=3") and same(want)  # a retried batch
    (tmp_path / "best" / "table" / "batch=5").mkdir()  # a batch whose write died: no mark, not read
    shutil.copy(next((tmp_path / "best" / "table" / "batch=0").glob("*.parquet")), tmp_path / "best" / "table" / "batch=5")
    assert same(want) and S.pending_parts(spark, out) == (3, [4])


def test_training_imputes_with_train_statistics_and_saves_them(spark, sf_small, tmp_path):
    p = T.portfolio(spark, sf_small).withColumn("reclamos", F.when(F.col("cliente_id") % 6 != 0, F.col("reclamos")))
    models = {"Regresión Logística": LogisticRegression(maxIter=20, weightCol="peso", featuresCol="features", labelCol="label")}
    data = C.prepare(p, T.FEATURES, T.TARGET, "cliente_id")
    n, n_test = p.count(), data["test"].count()
    assert n_test == -(-n // 5) and data["train"].count() == n - n_test  # an exact split
    train = data["train"].join(p.select("cliente_id", F.col("reclamos").alias("raw")), "cliente_id").filter("raw IS NOT NULL")
    import numpy as np
    assert data["fills"] == {"reclamos": float(np.median([r.raw for r in train.collect()]))}
    r = C.train_models(p, T.FEATURES, T.TARGET, "cliente_id", models=models, data=data)["Regresión Logística"]
    scored = C.score(p, r["model"], T.FEATURES, r["params"], r["scaled"], r["fills"])
    assert scored.filter("prob_abandono IS NULL OR isnan(prob_abandono)").count() == 0
    C.save_model(r["model"], str(tmp_path / "m"), T.FEATURES, r["params"], r["scaled"], r["fills"])
    model, prep = C.load_model(str(tmp_path / "m"))
    again = C.score(p, model, prep["features"], prep["params"], prep["scaled"], prep["fills"])
    assert scored.exceptAll(again).count() == 0


def test_split_takes_large_and_text_keys(spark):
    df = spark.createDataFrame([((1 << 60) + i, f"k{i}", i % 2) for i in range(400)], "big long, text string, y int")
    for key in ("big", "text"):
        assert C.stratified_split(df, key, "y", exact=True).filter("es_test").count() == 80
        assert C.with_folds(df, key).select("fold").distinct().count() == 5


def test_grid_points_equal_forests_of_their_own(spark, sf_small, monkeypatch, tmp_path):
    """Leaf tables reproduce the forest's own probabilities, so its prefixes and depth cuts are forests too."""
    monkeypatch.setattr(C, "GRID_TREES", [5, 10])
    monkeypatch.setattr(C, "GRID_DEPTH", [2, None])
    data = C.prepare(T.portfolio(spark, sf_small), T.FEATURES, T.TARGET, "cliente_id")
    train, test = (C.assemble(T.FEATURES).transform(data[k]) for k in ("train", "test"))
    forest = C.RandomForestClassifier(numTrees=10, maxDepth=30, weightCol="peso", seed=1, leafCol="leaf").fit(train)
    recalls = C.grid_recalls(forest, test, str(tmp_path / "f"))
    got = forest.transform(test).filter("label = 1").agg(F.avg((F.col("prediction") == 1).cast("double"))).first()[0]
    assert recalls[(10, None)] == pytest.approx(got) and set(recalls) == {(5, 2), (5, None), (10, 2), (10, None)}
    table, _ = C.tune_forest(data, T.FEATURES, "cliente_id")[1:]
    assert table.count() == 2 * 2 * 3 and table.filter("recall_cv BETWEEN 0 AND 1").count() == 12


def test_churn_train_score(spark, sf_small):
    models = {"Árbol de Décision": C.DecisionTreeClassifier(maxDepth=5, weightCol="peso", seed=C.SEED,
                                                           featuresCol="features", labelCol="label")}
    res = C.train_models(T.portfolio(spark, sf_small), T.FEATURES, T.TARGET, "cliente_id", models=models)
    r = next(iter(res.values()))
    assert 0.5 <= r["metrics"]["roc_auc"] <= 1.0
    scored = C.score(T.portfolio(spark, sf_small), r["model"], T.FEATURES)
    bad = scored.filter(~(((F.col("prob_abandono") >= 0.6) & (F.col("segmento_riesgo") == "ALTO"))
                          | ((F.col("prob_abandono") < 0.6) & (F.col("segmento_riesgo") != "ALTO"))))
    # rounding to 4 decimals can only move a probability across 0.60 by < 5e-5
    assert bad.filter(F.abs(F.col("prob_abandono") - 0.6) > 1e-4).count() == 0
    with pytest.raises(ValueError):
        C.score(T.portfolio(spark, sf_small).drop("edad"), r["model"], T.FEATURES)


def test_continuous_start_processes_feed(spark, sf_small):
    import os
    import tempfile
    root = tempfile.mkdtemp(prefix="cauce-cont-")
    q = S.start(S.supplier_counts_stream(S.quote_stream(spark, sf_small)), os.path.join(root, "out"),
                os.path.join(root, "ckpt"), mode="complete", every="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(os.path.join(root, "out"))
    assert got.agg(F.sum("cotizaciones")).first()[0] == T.quotes(spark, sf_small).count()


def test_partitions_to_fit_in_grow_slower_than_the_rows(spark):
    """Small tables keep 10,000 rows a partition; large ones get larger partitions, not ever more tasks a job."""
    assert [C.fitting_partitions(n) for n in (0, 12_000, 72_000, 720_000, 4_320_000)] == [2, 2, 8, 24, 44]
    rows = C.sized_for_fitting(spark.range(300_000), "id")
    assert rows.rdd.getNumPartitions() == 24 and rows.count() == 300_000
    rows.unpersist()


def test_the_model_is_applied_once_for_all_metrics(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    seen = spark.sparkContext.accumulator(0)

    class Model:
        @staticmethod
        def transform(df):
            def vector(p):
                seen.add(1)
                return Vectors.dense([1 - p, p])
            return df.withColumn("probability", F.udf(vector, VectorUDT())("p")).withColumn("prediction", F.round("p"))

    test = spark.createDataFrame([(i % 3 == 0, (i * 37 % 100) / 100) for i in range(500)], "label boolean, p double")
    want = C.evaluate(Model.transform(test)).first()
    before = seen.value
    assert C.evaluated(Model, test) == want and seen.value - before == 500


def test_parts_of_a_forest_vote_together(spark, sf_small, monkeypatch, tmp_path):
    """Votes of parts add up to those of all their trees, and no fit of the grid has more trees than a part."""
    monkeypatch.setattr(C, "GRID_TREES", [5, 10])
    monkeypatch.setattr(C, "GRID_DEPTH", [None])
    monkeypatch.setattr(C, "GRID_MIN_LEAF", [4])
    monkeypatch.setattr(C, "GRID_TREES_AT_ONCE", 6)
    data = C.prepare(T.portfolio(spark, sf_small), T.FEATURES, T.TARGET, "cliente_id")
    train, test = (C.assemble(T.FEATURES).transform(data[k]) for k in ("train", "test"))
    first, second = (C.RandomForestClassifier(numTrees=n, maxDepth=30, weightCol="peso", seed=n, leafCol="leaf").fit(train) for n in (6, 4))
    rows = test.withColumn("row", F.col("cliente_id"))
    votes = C.grid_votes(first, rows, str(tmp_path / "a")).unionByName(C.grid_votes(second, rows, str(tmp_path / "b"), 6))
    p = {f.getNumTrees: f.transform(test).select("cliente_id", "label", C.probability_of_churn(test).alias("p")) for f in (first, second)}
    both = p[6].join(p[4].select("cliente_id", F.col("p").alias("q")), "cliente_id").filter("label = 1")
    want = both.agg(F.avg((F.col("p") * 6 + F.col("q") * 4 > 5).cast("double"))).first()[0]
    assert C.recalls_of_votes(votes)[(10, None)] == pytest.approx(want)
    fitted, real = [], C.RandomForestClassifier
    monkeypatch.setattr(C, "RandomForestClassifier", lambda **k: fitted.append(k["numTrees"]) or real(**k))
    C.tune_forest(data, T.FEATURES, "cliente_id")
    assert sorted(fitted[:-1]) == [4] * 5 + [6] * 5  # the last is the refitted best


def test_the_grid_is_fitted_on_all_rows(spark, monkeypatch):
    """The rows of class 1 are those with the 2,000 largest hashes of the key among 22,000: a bounded part lacks them."""
    monkeypatch.setattr(C, "GRID_TREES", [2, 4])
    monkeypatch.setattr(C, "GRID_DEPTH", [2, None])
    monkeypatch.setattr(C, "GRID_MIN_LEAF", [1])
    keys = [r[0] for r in spark.range(22_000).orderBy(F.xxhash64("id")).collect()]
    last = spark.createDataFrame([(k,) for k in keys[20_000:]], "id long")
    rows = spark.range(22_000).join(last.withColumn("label", F.lit(1.0)), "id", "left").na.fill(0.0, ["label"])
    train = rows.selectExpr("id", "label", "label + pmod(id, 10) / 20 AS x", "pmod(id, 3) AS z",
                            "IF(label = 1, 5.5D, 0.55D) AS peso").persist()
    best, table, found = C.tune_forest({"train": train}, ["x", "z"], "id")
    assert table.filter("recall_cv > 0.9").count() == 4 and found[3] > 0.9
    scored = best.transform(train).filter("label = 1")
    assert scored.filter("prediction = 1").count() > 1_800
    train.unpersist()


def _train_rows(spark, n=3000):
    """Rows with a fold, some without, missing values in ``x`` and weights by class."""
    a, b, noise = "pmod(xxhash64(id, 1), 37)", "pmod(xxhash64(id, 2), 5)", "pmod(xxhash64(id, 3), 50)"
    return spark.range(0, n, 1, 4).selectExpr(
        "id", f"CASE id % 20 WHEN 0 THEN NULL WHEN 1 THEN double('NaN') ELSE pow({a}, 1.5) END AS x", f"{b} AS z", "2.5D AS same",
        f"CAST({a} + 6 * {b} + {noise} > 60 AS DOUBLE) AS label", "IF(id % 50 = 7, NULL, CAST(pmod(xxhash64(id, 4), 5) AS INT)) AS fold",
    ).withColumn("peso", F.when(F.col("label") == 1, 1.3).otherwise(0.8))


def test_cells_hold_all_rows(spark):
    train, features = _train_rows(spark), ["x", "z", "same"]
    cells = C.held_cells(C.binned_cells(train, features, "peso", 32), features, "peso")
    want = {(int(r.label), 5 if r.fold is None else r.fold): r["n"] for r in train.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    assert {(i, f): int(cells.rows[i, f].sum()) for i in (0, 1) for f in range(6) if cells.rows[i, f].any()} == want
    top = cells.bins[0].max()  # missing values are above all others
    assert cells.rows[:, :, cells.bins[0] == top].sum() == train.filter("x IS NULL OR isnan(x)").count()
    assert len(set(map(tuple, cells.bins.T.tolist()))) == cells.bins.shape[1] and tuple(cells.weights) == (0.8, 1.3)


@pytest.mark.parametrize("leaf", [1, 9])
def test_a_tree_on_cells_is_spark_mls(spark, monkeypatch, leaf):
    """With every feature at every node and every row once, the tree is the one Spark ML grows on the bins."""
    import numpy as np

    from cauce.operators import forest as FO
    monkeypatch.setattr(FO, "chosen_features", lambda rngs, tree, n: np.ones((len(tree), n), dtype=bool))
    train, features = _train_rows(spark), ["x", "z"]
    cells = C.held_cells(C.binned_cells(train, features, "peso", 32), features, "peso")
    asked = np.arange(cells.bins.shape[1])
    nodes, (cut, end) = FO.grow(cells, [cells.rows.sum(axis=1)], asked, leaf, 5, [2, None], [np.random.default_rng(1)])
    binning = C.bucketizer(train, features, 32)
    binned = binning.transform(train).select(*[F.col(c).cast("int").alias(c) for c in binning.getOutputCols()], "label", "peso")
    tree = C.DecisionTreeClassifier(maxDepth=5, maxBins=64, minInstancesPerNode=leaf, weightCol="peso").fit(
        C.assemble(binning.getOutputCols()).transform(binned.na.fill(float(cells.bins[0].max()))))
    at = spark.createDataFrame([tuple(map(float, c)) for c in cells.bins.T], binning.getOutputCols())
    want = [r[0] for r in tree.transform(C.assemble(binning.getOutputCols()).transform(at)).select(C.vector_to_array("probability")[1]).collect()]
    assert np.allclose(nodes["p"][end], want) and (nodes["left"] < 0)[end].all() and tree.depth == 5
    assert int((~nodes["below"]).sum()) == tree.numNodes
    rows = cells.rows.sum(axis=(0, 1))
    assert np.array_equal(np.bincount(end, rows, len(nodes["p"]))[nodes["left"] < 0], (nodes["n0"] + nodes["n1"])[nodes["left"] < 0])
    assert cut.max() < 7 and np.array_equal(np.bincount(cut, rows, 7), np.bincount(cut, rows, 7) * (np.bincount(cut, minlength=7) > 0))


def test_what_is_grown_together_changes_no_tree(spark, monkeypatch):
    import numpy as np

    from cauce.operators import forest as FO
    train, features = _train_rows(spark), ["x", "z", "same"]
    cells = C.held_cells(C.binned_cells(train, features, "peso", 32), features, "peso")
    asked = np.flatnonzero(cells.rows[1, 2])

    def ends():
        return [np.concatenate(p) for p in zip(*[[nodes["p"][e] for e in end] for _, nodes, end in FO.grow_part(
            cells, 2, 2, 30, 6, 42, [3, None], asked)])]
    together = ends()
    monkeypatch.setattr(FO, "SLOTS", 1)
    assert all(np.array_equal(a, b) for a, b in zip(together, ends())) and len(together[0]) == 6 * len(asked)
    assert len({tuple(t) for t in together[1].reshape(6, -1).tolist()}) == 6  # no two trees have the same bag


def test_votes_of_cells_add_up_to_the_grid(spark, monkeypatch):
    """The recalls are those of the summed votes of all trees, whatever parts they are grown in; Spark ML's are near."""
    import numpy as np

    from cauce.operators import forest as FO
    monkeypatch.setattr(C, "GRID_TREES", [5, 10])
    monkeypatch.setattr(C, "GRID_DEPTH", [2, None])
    monkeypatch.setattr(C, "GRID_MIN_LEAF", [1, 8])
    monkeypatch.setattr(C, "GRID_TREES_AT_ONCE", 6)  # the second part has trees of both sizes
    train, features = _train_rows(spark).na.fill(5.0, ["x"]).persist(), ["x", "z", "same"]
    cells = C.held_cells(C.binned_cells(train, features, "peso", 32), features, "peso")
    table = C.grid_search(train, features)[1]
    got = {(r.num_trees, r.max_depth, r.min_leaf): r.recall_cv for r in table.collect()}
    assert len(got) == 8
    for leaf in (1, 8):
        recalls = {(n, d): [] for n in (5, 10) for d in (2, 30)}
        for fold in range(5):
            asked = np.flatnonzero(cells.rows[1, fold])
            trees = []
            for first, n in ((0, 6), (6, 4)):
                for _, nodes, (cut, end) in FO.grow_part(cells, fold, leaf, 30, n, C.SEED + first, [2, None], asked):
                    trees += list(zip(nodes["p"][cut].reshape(-1, len(asked)), nodes["p"][end].reshape(-1, len(asked))))
            for n, d in recalls:
                hit = sum(t[d == 30] for t in trees[:n]) > n / 2
                recalls[n, d].append(cells.rows[1, fold][asked][hit].sum() / cells.rows[1, fold].sum())
        for (n, d), r in recalls.items():
            assert got[n, d, leaf] == pytest.approx(sum(r) / 5)
    monkeypatch.setattr(C, "GRID_CELLS", 0)  # more cells than a task holds
    own = {(r.num_trees, r.max_depth, r.min_leaf): r.recall_cv for r in C.grid_search(train, features)[1].collect()}
    assert set(own) == set(got) and all(abs(own[k] - got[k]) < 0.1 for k in own if k[1] == 30)  # at depth 2 draws weigh more
    train.unpersist()


def test_the_grid_grows_on_cells_unless_they_are_too_many(spark, sf_small, monkeypatch):
    """No forest of the grid is fitted by Spark's jobs, a hundred a forest: only the best point is."""
    monkeypatch.setattr(C, "GRID_TREES", [2])
    monkeypatch.setattr(C, "GRID_DEPTH", [2])
    data = C.prepare(T.portfolio(spark, sf_small), T.FEATURES, T.TARGET, "cliente_id")
    fits, real = [], C.RandomForestClassifier.fit
    monkeypatch.setattr(C.RandomForestClassifier, "fit", lambda self, df: fits.append(df) or real(self, df))
    assert C.tune_forest(data, T.FEATURES, "cliente_id")[1].count() == 3 and len(fits) == 1
    data["train"].unpersist(), data["test"].unpersist()


def test_rows_to_evaluate_on_are_in_few_partitions(spark):
    """The metrics run some ten jobs a model over the test rows: these do not keep a task per partition of the input."""
    rows = spark.range(0, 3000, 1, 40).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 3 = 0 AS INT) AS y")
    data = C.prepare(rows, ["x"], "y", "id")
    assert data["test"].count() == 600 and data["test"].rdd.getNumPartitions() == C.fitting_partitions(600)
    data["train"].unpersist(), data["test"].unpersist()


def test_boosting_is_fitted_on_distinct_binned_rows(spark, monkeypatch):
    """Rows with equal bins and label are one weighted row, and the model is that of all rows."""
    x, z, noise = "pmod(xxhash64(id, 1), 50)", "CAST(sqrt(pmod(xxhash64(id, 2), 100)) AS INT)", "pmod(xxhash64(id, 3), 40)"
    rows = spark.range(0, 4000, 1, 5).selectExpr("id", f"pow({x}, 1.5) AS x", f"{z} AS z", "1.5D AS same",
                                                 f"CAST(({x} + 4 * {z} + {noise} > 55) AS DOUBLE) AS label")
    features = ["x", "z", "same"]
    est = C.GBTClassifier(maxIter=4, maxDepth=3, stepSize=0.1, seed=C.SEED, featuresCol="features", labelCol="label")
    want = est.fit(C.assemble(features).transform(rows))
    seen = []
    real = C.GBTClassifier.fit
    monkeypatch.setattr(C.GBTClassifier, "fit", lambda self, df: seen.append(df.count()) or real(self, df))
    model = C.train_models(rows, features, "label", "id", models={"g": est}, data={
        "train": rows, "test": rows, "params": {}, "fills": {}})["g"]["model"]
    assert len(seen) == 1 and seen[0] <= 32 * 10 * 2  # x has 50 values in 32 bins, z has 10
    wanted = want.transform(C.assemble(features).transform(rows)).select("id", C.vector_to_array("probability")[1].alias("p"))
    got = model.transform(rows).select("id", C.vector_to_array("probability")[1].alias("q"))
    assert wanted.join(got, "id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9


def test_thresholds_lie_between_values():
    assert C.thresholds([1.0, 1.0, 2.0, 5.0], 32) == [1.5, 3.5]
    assert C.thresholds([3.0] * 9, 32) == [] and C.thresholds([], 32) == []
    assert C.thresholds([float(i) for i in range(100)], 4) == [24.5, 49.5, 74.5]


def _counted_portfolio(spark, monkeypatch):
    """Counts the rows of the portfolio that are derived, and leaves the decision tree as only candidate."""
    seen, real, full = spark.sparkContext.accumulator(0), T.portfolio, C.candidate_models

    def age(x):
        seen.add(1)
        return x
    monkeypatch.setattr(T, "portfolio", lambda s, d: real(s, d).withColumn("edad", F.udf(age, "int")("edad")))
    monkeypatch.setattr(C, "candidate_models", lambda n: {k: m for k, m in full(n).items() if k == "Árbol de Decisión"})
    return seen


def test_a_persisted_table_stays_persisted_after_its_preparation(spark, sf_small):
    p = T.portfolio(spark, sf_small).persist()
    data = C.prepare(p, T.FEATURES, T.TARGET, "cliente_id")
    assert p.storageLevel.useMemory
    data["train"].unpersist(), data["test"].unpersist(), p.unpersist()
    data = C.prepare(p, T.FEATURES, T.TARGET, "cliente_id")
    assert not p.storageLevel.useMemory  # its own copy is released
    data["train"].unpersist(), data["test"].unpersist()


def test_training_derives_the_portfolio_once(spark, sf_small, monkeypatch):
    from cauce.plans import q_churn
    n = T.portfolio(spark, sf_small).count()
    seen = _counted_portfolio(spark, monkeypatch)
    monkeypatch.setattr(q_churn, "_CACHE", {})
    assert q_churn.agg_model_table_ml(spark, sf_small).count() == 1
    assert seen.value == n and not T.portfolio(spark, sf_small).storageLevel.useMemory


def test_the_churn_job_derives_the_portfolio_once(spark, sf_small, monkeypatch, tmp_path):
    from cauce.plans import jobs
    n = T.portfolio(spark, sf_small).count()
    seen = _counted_portfolio(spark, monkeypatch)
    assert jobs.run_churn(spark, sf_small, str(tmp_path), "r1").count() == 1
    assert seen.value == n and spark.read.parquet(f"{tmp_path}/clientes_scoreados/run=r1").count() == n
